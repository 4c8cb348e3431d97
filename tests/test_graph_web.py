from pyspark.sql import functions as F

from tessella.functions import web
from tessella.operators import catalog, graph

EDGE = "pos long, head string, rel string, tail string, score double, edge_id string, cite string"


def test_edge_rules(spark):
    rows = [
        (1, "a", "Part Of", "b", None, None, None), (2, "a", "part of", "b", 0.5, None, "c1"), (3, "a", "part_of", "b", 0.5, None, "c2"),
        (4, "x", "unknown_rel", "y", 0.9, None, None), (5, None, None, "z", 0.7, "7", None), (6, "l", "uses", "m", 0.1, None, None), (7, "n", "uses", "o", None, None, None),
    ]
    got = [(r.edge_id, r.head, r.rel, r.score, r.cite) for r in graph.filter_edges(spark.createDataFrame(rows, EDGE), 0.2).collect()]
    assert got == [("7", "?", "related_to", 0.7, None), ("a|part_of|b", "a", "part of", 0.5, "c1"), ("n|uses|o", "n", "uses", None, None)]


def test_structured_edges_need_an_allowed_relation(spark):
    rows = [(1, "a", None, "b", 0.9, None, None), (2, "a", "uses", "b", 0.5, None, None), (3, "a", "", "c", None, "k", None)]
    df = spark.createDataFrame(rows, EDGE)
    assert [r.edge_id for r in graph.filter_edges(df, form="dict").collect()] == ["a|uses|b"]
    assert [r.rel for r in graph.filter_edges(df).collect()] == ["related_to", "uses", "related_to"]
    more = df.withColumn("predicate", F.when(F.col("pos") == 1, F.lit("Part Of"))).withColumn("id", F.when(F.col("pos") == 2, F.lit("n2")))
    assert [(r.edge_id, r.rel) for r in graph.filter_edges(more, form="dict").collect()] == [("a|part_of|b", "Part Of"), ("n2", "uses")]
    assert graph.filter_edges(df, limit=0).count() == 3


def test_parse_edge(spark):
    lines = ["- A b -uses→ C d [score=0.75] [#edge:12]", "- A -has→ B", "nothing", None]
    got = [tuple(r.x) for r in spark.createDataFrame([(x,) for x in lines], "l string").select(graph.parse_edge(F.col("l")).alias("x")).collect()]
    assert got[0] == ("A b", "uses", "C d", 0.75, "12") and got[1] == ("A", "has", "B", None, None)
    assert got[2] == (None,) * 5 == got[3]


def test_graph_context(spark):
    schema = "k int, community_summaries array<struct<summary:string,level:int,community_id:int>>, programs array<string>, partners array<string>, audiences array<string>, edges array<struct<head:string,rel:string,tail:string,score:double,cite:string>>, anchors array<struct<name:string,type:string>>"
    rows = [(1, [(" s ", 1, 5), ("", 1, 6)], ["p"], None, [], [("h", None, "t", 0.456, "c")], [("n", None)]), (2, None, None, None, None, None, None)]
    got = {r.k: r.context for r in graph.graph_context(spark.createDataFrame(rows, schema), "k").collect()}
    assert got[1] == "[Сводка сообщества #1 (L1, id=5)]\ns\n\n[Структура]\n• Программы/проекты: p\n\n[Связи]\n- h -related_to→ t [score=0.46]\n   <c>\n\n[Якорные узлы] n (?)"
    assert got[2] == ""
    many = spark.createDataFrame([(1, None, None, None, None, [("h", "r", "t", None, "c")] * 5, None)], schema)
    assert graph.graph_context(many, "k", 2, cites=False).first().context == "[Связи]\n- h -r→ t\n- h -r→ t" and graph.graph_context(many, "k", limit=5).first().context == "[Свя:"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "u string").select(f(F.col("u"))).first()[0]


def test_urls(spark):
    assert one(spark, " HTTPS://A.b/C/?q=1#x", web.site_key) == "https://a.b/c"
    assert one(spark, "https://u@a.b:8/c", web.authority) == "u@a.b:8" and one(spark, "a.b", web.authority) is None
    assert one(spark, "https://drive.google.com/file/d/XY_1/view", web.drive_id) == "XY_1"
    assert one(spark, "https://drive.google.com/open?x=1&id=Z", web.drive_id) == "Z"
    assert one(spark, "https://a.b/x/y.PDF?z", web.file_name) == "y.PDF" and one(spark, "https://a.b/", web.file_name) == "file"
    assert one(spark, "https://a.b/x.PDF#z", web.is_download) and not one(spark, "https://a.b/pdf", web.is_download)
    assert one(spark, "https://a.b/x.MP4", web.is_media) and one(spark, None, web.is_download) is None
    assert one(spark, "confirm=ab_1&", web.confirm_token) == "ab_1"
    df = spark.createDataFrame([("https://a.b/c/d", "../e#f"), ("https://a.b", "http://[bad"), (None, None)], "b string, l string")
    assert [r[0] for r in df.select(web.resolve("b", "l")).collect()] == ["https://a.b/e", None, None]
    inner = spark.createDataFrame([("https://base.com/", "https://evilbase.com/"), ("https://base.com/", "/x"), (None, None)], "b string, l string")
    assert [r[0] for r in inner.select(web.is_internal(F.col("b"), F.col("l"))).collect()] == [True, False, False]


def test_html(spark):
    html = "<html><title> T </title><body><h1>A<b>b</b></h1><script>no()</script><p>text <a href='/x'>link</a><h4>n</h4><h3>C</h3></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    got = {r.page_id: r for r in catalog.html_catalog(df).collect()}
    assert got[1].title == "T" and got[1].headings == ["Ab", "C"] and [tuple(x) for x in got[1].links] == [("/x", "link", "text link n C")]
    assert "no()" not in got[1].text and got[2].text is None and got[3].headings == []


def test_json_and_lists(spark):
    assert one(spark, '["a", "", null, "b"]', web.coerce_files) == ["a", "b"]
    assert one(spark, "bad", web.coerce_files) == [] and one(spark, None, web.coerce_files) == []
    assert one(spark, '{"text": "", "question": "q"}', web.request_text) == "q"
    assert one(spark, "Итог: 1. раз 2. два", web.numbered_list) == "Итог:\n1) раз\n2) два"
    assert one(spark, "a\n\n\n\nb", web.numbered_list) == "a\n\nb"


def test_crawl_and_downloads(spark, as_rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c.mp4"), ("b", "d"), ("d", None)], "url string, link string")
    assert as_rows(catalog.crawl_order(spark.createDataFrame([("a",)], "url string"), edges)) == [("a", 0), ("b", 1), ("d", 2)]
    web_edges = spark.createDataFrame([("http://a/", "http://a/bad"), ("http://a/", "http://a/x"), ("http://a/bad", "http://a/never"), ("http://a/x", "http://a/bad/sub"), ("http://a/x", "http://a/y")], "url string, link string")
    start = spark.createDataFrame([("http://a/",), ("http://a/film.mp4",)], "url string")
    failed = spark.createDataFrame([("http://a/bad",)], "url string")
    assert as_rows(catalog.crawl_order(start, web_edges, failed=failed)) == [("http://a/", 0), ("http://a/bad", 1), ("http://a/x", 1), ("http://a/y", 2)]
    assert as_rows(catalog.crawl_order(start, web_edges, max_pages=2)) == [("http://a/", 0), ("http://a/bad", 1)]
    assert catalog.crawl_order(start, web_edges, max_depth=1).count() == 3
    chunks = spark.createDataFrame([(3, "c"), (1, "b"), (2, "a"), (4, ""), (5, None), (6, "a")], "id long, source string")
    assert [r.source for r in catalog.distinct_files(chunks).collect()] == ["a", "b", "c"] and [r.source for r in catalog.distinct_files(chunks, cap=2).collect()] == ["a", "b"]
    files = spark.createDataFrame([(1, "u1", "f1")], "resource_id long, download_url string, file_name string")
    asked = spark.createDataFrame([(1, "u1", "o"), (2, "u1", "o"), (2, "http://h/n.pdf", "o")], "resource_id long, download_url string, origin_url string")
    assert as_rows(catalog.new_downloads(asked, files)) == [(2, "o", "http://h/n.pdf", "n.pdf", False), (2, "o", "u1", "f1", True)]


def test_models_images_times(spark, as_rows):
    from tessella.functions import images, models, times

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "x" * 9_000)], "i int, t string")
    seen = df.select("i", models.language(F.col("t"), lambda t: ("long" if len(t) == 4_000 else "short", 0.9 if len(t) > 3 else 0.5)).alias("l"))
    assert as_rows(seen) == [(1, "unknown"), (2, "unknown"), (3, "unknown"), (4, "long")]
    assert {r[0] for r in df.select(models.language(F.col("t"))).collect()} == {"unknown"}
    assert as_rows(df.coalesce(1).select("i", models.embedded(F.col("t"), lambda ts: [[len(t)] for t in ts]))) == [(1, [3.0]), (2, None), (3, [0.0]), (4, [9000.0])]
    assert {r[0] for r in df.select(models.embedded(F.col("t"), lambda ts: 1 / 0)).collect()} == {None}
    jpeg = bytes.fromhex("ffd8ffe000104a46494600010100000100010000ffc0001108001000200301")
    gif = b"GIF89a" + bytes([5, 0, 6, 0])
    assert images.header_size(jpeg) == (32, 16, "jpeg") and images.header_size(gif) == (5, 6, "gif")
    assert images.header_size(b"BM" + bytes(16) + bytes([7, 0, 0, 0, 0xF8, 0xFF, 0xFF, 0xFF])) == (7, 8, "bmp")
    assert images.header_size(b"\xff\xd8\xff") == images.header_size(None) == images.header_size(images.PNG) == (None, None, None)
    assert times.utc_now().endswith("Z") and len(times.utc_now()) == 20


def test_identifiers_and_bodies(spark, as_rows):
    from tessella.operators import requests

    names = spark.createDataFrame([(" a_1 ",), ("1a",), ("a-b",), (None,), ("",), ("_",)], "n string")
    assert [r[0] for r in names.select(web.is_identifier(F.col("n"))).collect()] == [True, False, False, False, False, True]
    bodies = spark.createDataFrame([(1, '{"text": " hi "}', "application/json"), (2, "bad json", "application/json"), (3, "a=1&question=wo+ist%3F", None), (4, None, None), (5, "text=%ZZ", "form")], "i int, body string, content_type string")
    assert as_rows(requests.parsed(bodies).select("i", "text", "status")) == [(1, "hi", 200), (2, None, 400), (3, "wo ist?", 200), (4, None, 400), (5, None, 400)]
