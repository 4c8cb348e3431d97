import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import files, sinks
from tessella.streaming import ingest


def test_scan_and_extract(spark, tmp_path, as_rows):
    d = tmp_path / "scraped_site"
    d.mkdir()
    (d / "a.PDF").write_bytes(b"one")
    (d / "b.txt").write_bytes(b"two")
    (d / "c.docx").write_bytes(b"\xff")
    (tmp_path / "gigachat_materials").mkdir()
    assert [x.rsplit("/", 1)[1] for x in files.default_input_dirs(str(tmp_path))] == ["scraped_site", "gigachat_materials"]
    found = files.scan_files(spark, [str(d), str(tmp_path / "missing")])
    assert found.count() == 2
    got = files.extracted(found, lambda p, c: c.decode("ascii")).select(F.element_at(F.split("path", "/"), -1), "text", F.col("error").startswith("extract_failed"))
    assert as_rows(got) == [("a.PDF", "one", None), ("c.docx", None, True)]
    assert files.scan_files(spark, []).count() == 0


def test_lines(spark, tmp_path, as_rows):
    p = tmp_path / "e.jsonl"
    p.write_text('{"question": "q", "answer_ref": "a"}\n\n{"question": "r", "references": ["x"]}\n')
    assert as_rows(files.eval_lines(spark, str(p))) == [("q", [], "a"), ("r", ["x"], None)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"question": "q"}\nnot json\n')
    assert files.eval_lines(spark, str(bad), tolerant=True).select("question").collect()[0][0] == "q"
    with pytest.raises(Exception):
        files.eval_lines(spark, str(bad)).collect()
    t = tmp_path / "t.txt"
    t.write_text(" a \n\nb\n")
    assert as_rows(files.terms(spark, str(t))) == [("a",), ("b",)] and files.terms(spark, None).count() == 0
    sites = spark.createDataFrame([(1, "http://A.b/"), (2, "http://a.b"), (3, "http://c"), (4, " ")], "pos int, url string")
    assert as_rows(files.known_sites(sites)) == [("http://a.b", 1, "http://A.b/"), ("http://c", 3, "http://c")]
    md = spark.createDataFrame([("| a | b |",), ("|---|---|",), ("| 1 | 2 |",), ("| 1 |",), ("x",)], "value string")
    assert as_rows(files.markdown_table(md, ["a", "b"])) == [("1", "2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h", "t")], "hash string, clean string")
    p = str(tmp_path / "out")
    sinks.write_clean_texts(df, p)
    more = spark.createDataFrame([("h", "changed"), ("i", "added"), ("i", "added")], "hash string, clean string")
    sinks.write_clean_texts(more, p)
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [("h", "t"), ("i", "added")]
    sinks.write_clean_texts(df.withColumn("clean", F.lit("new")), p, overwrite=True)
    assert [tuple(r) for r in spark.read.parquet(p).collect()] == [("h", "new")]
    ids = spark.createDataFrame([(5, "k", "x", "late"), (2, "k", "x", "first")], "doc_id long, hash string, clean string, lang string")
    sinks.write_clean_texts(ids, str(tmp_path / "ids"))
    assert [r.lang for r in spark.read.parquet(str(tmp_path / "ids")).collect()] == ["first"]
    sinks.append(df, p)
    assert sinks.truncate(spark, p) == 2 and spark.read.parquet(p).count() == 0
    sinks.write_answers(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    cat = spark.createDataFrame([("a", "old"), ("b", None)], "file string, clean_text_hash string")
    new = spark.createDataFrame([("a", "p", "h", None)], "file string, clean_text_path string, clean_text_hash string, cleaned_at timestamp")
    assert sorted((r.file, r.clean_text_hash, r.clean_text_path) for r in sinks.clean_metadata(cat, new, "file").collect()) == [("a", "h", "p"), ("b", None, None)]


def test_report(tmp_path):
    a, b = sinks.write_report({"n": 12345, "terms": [{"t": "<x>", "n": 1}], "langs": {"ru": 2}}, str(tmp_path / "r"))
    assert json.load(open(a))["n"] == 12345
    page = open(b).read()
    assert "12 345" in page and "&lt;x&gt;" in page and "<x>" not in page
    told = {"documents": {"processed": 4, "total_candidates": 5, "unique": 3, "duplicates": 1, "duplicate_ratio": 0.25, "language_distribution": {"ru": 2, "de": 1}, "short_documents": 3, "long_documents": 0}, "errors_total": 1, "classification_summary": [{"field": f, "value": f"<{i}>", "total": i} for f in ("a", "b") for i in range(20)]}
    page = sinks.dashboard(told)
    assert "The main language is ru with 66.7%." in page and "1 files gave no text." in page and page.count("&lt;14&gt;") == 2 and "&lt;15&gt;" not in page
    assert sinks.percent(0.1234) == "12.3%" and sinks.percent(None) == "None" and sinks.grouped("x") == "x"
    assert sinks.grouped("12345.6") == "12 346" and sinks.grouped(12345.0, 2) == "12 345" and sinks.grouped(1234.567, 2) == "1 234.57" and sinks.grouped(True) == "True" and sinks.percent("0.5") == "50.0%"


def test_stream_of_new_contents(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "same", t), (2, "same ", t), (3, None, t), (4, "b", t)], "doc_id long, text string, added_at timestamp").write.parquet(src)
    stream = ingest.new_contents(spark.readStream.schema("doc_id long, text string, added_at timestamp").parquet(src))
    q = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.clean for r in spark.table("fresh").collect()) == ["b", "same"]


def test_stream_upsert_is_idempotent(spark, tmp_path):
    schema = "id long, question string, answer string, files array<string>, model string, embedding array<double>, created_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "q", "a", [], "m", [1.0], t), (2, "Q", "b", [], "m", None, t), (3, "", "c", [], "m", None, t)], schema).write.parquet(src)
    for c in ("c1", "c2"):  # the second run replays the batch into the same folder
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / c)).awaitTermination(120)
    got = ingest.cache_state(spark, out).collect()
    assert [(r.id, r.answer, r.embedding, r.versions) for r in got] == [(1, "b", [1.0], 2)]


def test_windowed_stats(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([("ok", t, 1.0), ("ok", t + dt.timedelta(minutes=10), 3.0), ("ok", t + dt.timedelta(days=1), 9.0)], "status string, created_at timestamp, duration_ms double").write.parquet(src)
    s = ingest.windowed_stats(spark.readStream.schema("status string, created_at timestamp, duration_ms double").parquet(src))
    q = s.writeStream.format("memory").queryName("wins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.requests, r.duration_mean, r.duration_max) for r in spark.table("wins").collect()][:1] == [(2, 2.0, 3.0)]


def test_sites_are_rewritten_and_folders_found(spark, tmp_path, as_rows):
    lines = spark.createDataFrame([(2, "http://b"), (1, "HTTP://a/"), (3, "http://A")], "pos int, url string")
    files.rewrite_known_sites(lines, str(tmp_path / "sites"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "sites")).collect()] == ["HTTP://a/", "http://b"]
    for kind in ("pages", "materials", "other"):
        (tmp_path / "root" / "d1" / kind).mkdir(parents=True)
        (tmp_path / "root" / "d1" / kind / "f.pdf").write_bytes(b"x")
    assert as_rows(files.site_folders(spark, str(tmp_path / "root")).groupBy("domain").count()) == [("d1", 2)]
    assert files.site_folders(spark, str(tmp_path / "none")).count() == 0


def test_table_over_jdbc(spark, small, as_rows):
    nation, where = spark.read.parquet(f"{small}/nation.parquet"), "jdbc:derby:memory:tessella;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    nation.write.format("jdbc").option("url", where).option("dbtable", "nation").options(**driver).mode("overwrite").save()
    got = files.sql_table(spark, where, "nation", **driver)
    assert as_rows(got.select("n_nationkey")) == as_rows(nation.select("n_nationkey"))


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tessella import session

    known = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)), master="spark://host:7077")
    with pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
    cut = session.cut_lineage(spark.range(3))
    path = cut._written
    assert cut.count() == 3 and session.path_exists(spark, path)
    session.release(cut, spark.range(1))
    assert not session.path_exists(spark, path)
    path = session.cut_lineage(spark.range(3))._written
    session.clear_shared(spark)
    assert not session.path_exists(spark, path) and session.cut_lineage(spark.range(2)).count() == 2
