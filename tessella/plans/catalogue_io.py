"""Queries that go through sources and sinks, caller-given models, web pages and requests, with the SQL each is held against.

What a query writes lies in a folder of its own below the shared folder. Models here are small functions that SQL can restate.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import images, models, text, times, web
from tessella.operators import cache, catalog, corpus, graph, indexing, requests, retrieval
from tessella.plans import answering, report
from tessella.plans.oracles import BASE, OVERLAP, STATE, clean, strip
from tessella.session import shared_folder, spread, table
from tessella.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
# Fixed value: a character of the range that answers must not hold.
HAN = "漢"


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/io-{uuid.uuid4().hex}"


def files_scan_hash(s, d):
    """Gold questions as files, one folder each; found again by scanning, with length and SHA-256 of their bytes."""
    where = _folder(s)
    table(s, d, "eval_set_gold_manual").select("item_id", "question").coalesce(1).write.partitionBy("item_id").text(where)
    found = files.scan_files(s, [where], (".txt",))
    return found.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).try_cast("bigint").alias("item_id"), "length", F.sha2("content", 256).alias("file_hash"))


def files_site_folders(s, d):
    """Files below <domain>/pages and <domain>/materials of a root, other folders left out."""
    where = _folder(s)
    for r in table(s, d, "region").where("r_name <> ''").select("r_name").distinct().collect():  # five rows
        for kind in ("pages", "materials", "other"):
            s.createDataFrame([(f"{r.r_name} {kind}",)], "value string").coalesce(1).write.text(f"{where}/{r.r_name}/{kind}")
    return files.site_folders(s, where).where("path like '%.txt'").groupBy("domain").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def files_eval_lines(s, d):
    """Gold items written as JSON lines and read again."""
    where = _folder(s)
    sinks.write_answers(table(s, d, "eval_set_gold_manual").select("question", F.col("refs").alias("references"), "answer_ref"), where)
    rows = files.eval_lines(s, where)
    return rows.select("question", F.array_join("references", "|", "<null>").alias("refs"), "answer_ref")


def files_terms(s, d):
    where = _folder(s)
    table(s, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" \n\n"))).write.text(where)
    return files.terms(s, where)


def files_known_sites(s, d):
    return files.known_sites(table(s, d, "scanned_pages").select(F.col("page_id").alias("pos"), F.col("page_url").alias("url")))


def files_markdown_table(s, d):
    line = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    rows = table(s, d, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.concat(line, F.lit(" x |"))).when(F.col("p_partkey") % 10 == 1, F.lit("|---|---|")).otherwise(line).alias("value"))
    return files.markdown_table(rows, ["name", "size"])


def sink_clean_texts_append(s, d):
    """Texts of every second document are stored first, all documents after; the second run adds what is new."""
    where, clean_docs = _folder(s), corpus.non_empty(corpus.cleaned(spread(table(s, d, "documents"))))
    sinks.write_clean_texts(clean_docs.where("doc_id % 2 = 0"), where)
    sinks.write_clean_texts(clean_docs, where)
    return s.read.parquet(where).select("hash", F.length("clean").cast("bigint").alias("chars"))


def sink_log_append_truncate(s, d):
    where, log = _folder(s), table(s, d, "events")
    for _ in range(2):
        sinks.append(log, where)
    removed = sinks.truncate(s, where)
    return s.read.parquet(where).agg(F.count(F.lit(1)).alias("left")).select(F.lit(removed).cast("bigint").alias("removed"), "left")


def sink_clean_metadata(s, d):
    """Pages with the clean-text columns of the records that know their file; old values where none does."""
    pages = table(s, d, "scanned_pages")
    known = table(s, d, "document_records").where("output_path is not null").select(F.col("content_hash").alias("clean_text_hash"), "output_path")
    new = pages.select("page_id", F.col("clean_text_hash").alias("h")).join(known.groupBy(F.col("clean_text_hash").alias("h")).agg(F.min("output_path").alias("p")), "h")
    cols = new.select("page_id", F.col("p").alias("clean_text_path"), F.lit(None).cast("string").alias("clean_text_hash"), F.lit(None).cast("timestamp").alias("cleaned_at"))
    return sinks.clean_metadata(pages.select("page_id", "clean_text_path", "clean_text_hash", "cleaned_at"), cols, "page_id").select("page_id", "clean_text_path", "clean_text_hash")


def sink_schema_union(s, d):
    """Records and documents as one table; columns that one side lacks are null."""
    return sinks.evolved(table(s, d, "document_records").select("source_path", "language"), table(s, d, "documents").select("source_path", "file_type"))


def sink_catalog_rows(s, d):
    """Page and link rows as a crawl stores them, counted by page."""
    pages = table(s, d, "scanned_pages")
    found = catalog.links(pages).select("page_id", F.col("link").alias("download_url"), F.lit("").alias("anchor_text"), F.lit("").alias("context_snippet"))
    page, link = sinks.catalog_rows(pages.where("page_id % 2 = 0"), found)
    n = link.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return page.join(n, "page_id", "left").select("page_id", "page_url", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def report_documents(s, d):
    """The ``documents`` part of the corpus report as rows."""
    told = report.corpus_report(table(s, d, "documents"), table(s, d, "document_records"))["documents"]
    names = ("total_candidates", "processed", "unique", "duplicates", "documents_with_non_ascii", "cleaned_with_output", "linked_clean_documents", "unlinked_clean_documents", "short_documents", "long_documents")
    return s.createDataFrame([(k, int(told[k])) for k in names], "key string, value bigint")


def limit_candidates(s, d):
    """Candidates are counted before the limit applies."""
    docs = table(s, d, "documents")
    taken = report.first_documents(docs, 100)
    return taken.agg(F.count(F.lit(1)).alias("taken"), F.max("doc_id").alias("last_id")).join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("total"))))


def corpus_error_rows(s, d):
    """Documents and gold answers that cleaning leaves empty."""
    gold = table(s, d, "eval_set_gold_manual").select((-F.col("item_id") - 1).alias("doc_id"), F.col("answer_ref").alias("text"), F.lit(None).cast("string").alias("lang"))
    return corpus.empty_after_clean(corpus.cleaned(spread(table(s, d, "documents").select("doc_id", "text", "lang").unionByName(gold))))


def non_blank_answers(s, d):
    return indexing.non_blank(table(s, d, "eval_set_gold_manual"), "answer_ref").select("item_id")


def cjk_marked(s, d):
    """Answers of every seventh row get a Han character put in; the detector finds just those."""
    rows = table(s, d, "cached_answers").where("answer is not null").select("id", F.when(F.col("id") % 7 == 0, F.concat("answer", F.lit(HAN))).otherwise(F.col("answer")).alias("a"))
    return rows.where(text.has_cjk(F.col("a"))).select("id")


def identifier_check(s, d):
    return table(s, d, "cached_answers").select("id", web.is_identifier(F.col("model")).alias("ok"))


def index_resume_by_hash(s, d):
    """Documents whose cleaned content no record has."""
    docs = corpus.non_empty(corpus.cleaned(spread(table(s, d, "documents")))).withColumnRenamed("hash", "content_hash")
    return indexing.not_yet_indexed(docs, table(s, d, "document_records").where("content_hash is not null"), "content_hash").select("doc_id")


def answer_previews(s, d):
    return answering.previews(table(s, d, "cached_answers").select(F.col("id").alias("ask_id"), "answer"))


def titles_escaped(s, d):
    return table(s, d, "scanned_pages").select("page_id", web.escaped(F.col("page_title")).alias("title"))


def numbers_grouped(s, d):
    return table(s, d, "orders").select("o_orderkey", web.grouped(F.col("o_totalprice"), 2).alias("price"), web.grouped(F.col("o_custkey") * 1000, 0).alias("customer"))


def links_resolved(s, d):
    rows = table(s, d, "scanned_pages").select("page_id", "page_url", F.explode(F.array_distinct(web.text_links(F.col("page_text")))).alias("link"))
    return spread(rows).select("page_id", "link", web.resolve("page_url", "link").alias("resolved"))


def confirm_tokens(s, d):
    return table(s, d, "events").select("event_id", web.confirm_token(F.concat(F.lit("<a href='/uc?confirm="), "event_type", F.lit("_"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit("'")).otherwise(F.lit("&id=1'")))).alias("token"))


def html_pages(s, d):
    """Pages written as HTML and parsed again: title, headings, text, links with anchor and snippet."""
    e = lambda c: web.escaped(F.coalesce(c, F.lit("")))
    html = F.concat(
        F.lit("<html><head><title>"), e("page_title"), F.lit("</title><style>h1 {}</style></head><body><h1>"), e("page_title"), F.lit("</h1><script>no()</script><div><p>see <a href=\""), e("page_url"),
        F.lit("\">"), e("pdf_file_name"), F.lit("</a> now</p><h4>no</h4><h2>two <b>parts</b></h2></div></body></html>"),
    )
    rows = catalog.html_catalog(spread(table(s, d, "scanned_pages")).select("page_id", html.alias("html"))).drop("html")
    link = F.get("links", F.lit(0))
    return rows.select("page_id", "title", F.array_join("headings", "|").alias("headings"), "text", link["href"].alias("href"), link["anchor"].alias("anchor"), link["snippet"].alias("snippet"))


def request_bodies(s, d):
    """Questions as JSON bodies and as forms, read by the request parser."""
    q = F.coalesce("question", F.lit(""))
    body = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.lit("").alias("text"), q.alias("question")))).otherwise(F.concat(F.lit("x=1&question="), F.url_encode(q)))
    rows = table(s, d, "cached_answers").select("id", body.alias("body"), F.when(F.col("id") % 2 == 0, "application/json").otherwise("form").alias("content_type"))
    return requests.parsed(rows).select("id", "text", F.col("status").cast("bigint").alias("status"))


def log_moments(s, d):
    at = F.col("ts").cast("timestamp")
    return table(s, d, "events").select("event_id", times.iso_utc(at).alias("iso"), times.epoch(at).alias("epoch"))


def image_sizes(s, d):
    """Sizes read from PNG headers, and the base64 of their content."""
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word("user_id"), word(F.col("event_id") + 1), F.lit("0806000000")))
    content = F.when(F.col("event_id") % 5 == 0, F.to_binary(F.lit("no image"), F.lit("utf-8"))).otherwise(png)
    rows = spread(table(s, d, "events")).select("event_id", content.alias("c"))
    return rows.select("event_id", images.image_size("c").alias("x"), images.png_base64(F.col("c")).alias("png")).select("event_id", "x.width", "x.height", "x.kind", "png")


def _script(t: str) -> tuple[str, float]:
    cyr, lat = len(re.findall("[а-яё]", t.lower())), len(re.findall("[a-z]", t.lower()))
    if not cyr + lat:
        raise ValueError("no letters")
    p = cyr / (cyr + lat)
    return ("cyrillic", p) if p >= 0.5 else ("latin", 1 - p)


def detected_scripts(s, d):
    """A caller's detector through the language function: its answer from 0.8 on, else unknown."""
    return spread(table(s, d, "documents")).select("doc_id", models.language(F.col("text"), _script).alias("script"))


def text_vectors(s, d):
    """A caller's embedder: length and number of spaces of each text."""
    return spread(table(s, d, "documents")).select("doc_id", models.embedded(F.col("text"), lambda ts: [[len(t), t.count(" ")] for t in ts]).alias("v")).select("doc_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


def _hits(s, d, k):
    gold = table(s, d, "eval_set_gold_manual").select(F.col("item_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text"))
    return gold, retrieval.overlap_top_k(table(s, d, "documents"), gold, k)


def rerank_pairs(s, d):
    """Hits ordered anew by a caller's pair scorer (length of the text beyond the question's); questions of odd ids break it and keep their order."""

    def score(question: str, texts: list[str]) -> list[float]:
        if len(question) % 2:
            raise ValueError("odd")
        return [len(t) - len(question) for t in texts]

    gold, hits = _hits(s, d, 10)
    rows = hits.join(gold.withColumnRenamed("text", "question"), "query_id").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.pair_reranked(rows, score).select("query_id", "doc_id", "new_rank")


def answer_eval_rows(s, d):
    """Evaluation rows of the gold items; vectors stand in by id."""
    gold, hits = _hits(s, d, 5)
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    at = lambda n, name: v.select((F.col("vec_id") - n).alias("query_id"), F.col("embedding").alias(name))
    items = table(s, d, "eval_set_gold_manual").select(F.col("item_id").alias("query_id"), "question", F.col("answer_ref").alias("answer"), "answer_ref")
    rows = items.join(at(0, "answer_vec"), "query_id", "left").join(at(1, "ref_vec"), "query_id", "left").join(at(2, "other"), "query_id", "left").withColumn("refs_vec", F.array_compact(F.array("ref_vec", "other")))
    docs = hits.join(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", "rank", "text")
    out = retrieval.answer_rows(rows, docs)
    return out.select("query_id", "question", "answer", F.round("ref_sim", 6).alias("ref_sim"), F.round("refs_sim", 6).alias("refs_sim"), F.col("refs_count").cast("bigint").alias("refs_count"), F.array_join("docs_sample", "|").alias("docs_sample"))


def crawl_frontier(s, d):
    """Breadth-first order over supplier numbers: n leads to 2n and 2n + 1."""
    k = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    known = k.select(name(F.col("k")).alias("link"))
    edges = k.select(name(F.col("k")).alias("url"), F.explode(F.array(name(F.col("k") * 2), name(F.col("k") * 2 + 1), F.lit("clip.mp4"))).alias("link")).join(known.unionByName(s.createDataFrame([("clip.mp4",)], "link string")), "link")
    return catalog.crawl_order(s.createDataFrame([("s1",)], "url string"), edges)


def catalog_new_downloads(s, d):
    pages = table(s, d, "scanned_pages").where("page_url is not null")
    have = pages.where("page_id % 2 = 0").select("resource_id", F.col("page_url").alias("download_url"), F.col("pdf_file_name").alias("file_name"))
    asked = pages.where("page_id % 3 = 0").select((F.col("resource_id") + F.col("page_id") % 2).alias("resource_id"), F.col("page_url").alias("download_url"), F.lit("o").alias("origin_url")).distinct()
    return catalog.new_downloads(asked, have)


def catalog_distinct_files(s, d):
    return catalog.distinct_files(table(s, d, "documents").select("doc_id", "source_path"), "source_path")


def graph_filter_structured(s, d):
    """Structured edges: a missing relation reads related_to and is not allowed; relation and key may stand under other names."""
    e = table(s, d, "events")
    rel = F.when(F.col("event_type") == "click", F.lit("uses")).when(F.col("event_type") == "view", F.lit(""))
    rows = e.select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("head"), rel.alias("rel"), F.when(F.col("event_type") == "purchase", F.lit("Part Of")).alias("predicate"), F.lit("t").alias("tail"), F.col("value").alias("score"), F.lit(None).cast("string").alias("edge_id"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"), F.lit(None).cast("string").alias("cite"))
    return graph.filter_edges(rows, 1.0, limit=None, form="dict").select("edge_id", "head", "rel", F.round("score", 6).alias("score"), "first_pos")


def graph_contexts(s, d):
    """Nested contexts by region: a summary, its nations as programs and anchors, and edges to them; three edges, without sources."""
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    r = table(s, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    score = F.when(F.col("r_regionkey") % 2 == 0, F.lit(0.5))
    ctx = r.select(
        "r_regionkey", F.array(F.struct(F.concat(F.lit(" "), "r_name").alias("summary"), F.col("r_regionkey").alias("level"), F.lit(None).cast("int").alias("community_id"))).alias("community_summaries"), F.col("names").alias("programs"), F.lit(None).cast("array<string>").alias("partners"),
        F.array().cast("array<string>").alias("audiences"), F.transform("names", lambda x: F.struct(x.alias("head"), F.lit("").alias("rel"), F.col("r_name").alias("tail"), score.alias("score"), F.lit("c").alias("cite"))).alias("edges"),
        F.transform("names", lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("type"))).alias("anchors"),
    )
    return graph.graph_context(ctx, "r_regionkey", 3, cites=False)


def log_history_columns(s, d):
    """The last rows of the log with all twelve columns."""
    e = table(s, d, "events")
    rows = e.select(
        F.col("event_id").alias("id"), times.iso_utc(F.col("ts").cast("timestamp")).alias("created_at"), F.when(F.col("event_id") % 2 == 0, "text").otherwise("image").alias("input_type"), F.lit("m").alias("model"),
        F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"), F.col("value").alias("duration_ms"), F.col("user_id").alias("text_len"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("token_count"), (F.col("user_id") * 2).alias("image_width"), (F.col("user_id") * 3).alias("image_height"), F.left("props", F.lit(200)).alias("response_preview"),
    )
    return requests.history(rows)


def log_image_stats(s, d):
    """Statistics with widths and heights, which only image requests have."""
    e = table(s, d, "events")
    image = F.col("event_id") % 3 == 0
    log = e.select(F.col("event_type").alias("status"), F.col("value").alias("duration_ms"), F.when(image, F.col("user_id") * 2).alias("image_width"), F.when(image, F.col("user_id") * 3 + 1).alias("image_height"))
    return requests.stats(log, ("status",)).select("status", "requests", "duration_p99", "image_width_mean", "image_width_p50", "image_height_p50")


def star_customers_without_urgent_orders(s, d):
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(s, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def cache_answer_states(s, d):
    """Answers of a state and where each asked question would be answered from (no generator is called)."""
    rows = table(s, d, "cached_answers")
    state = cache.upserted(cache.storable(cache.keyed(rows)))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("ask_id"), "question", "model", "embedding")
    exact = cache.exact_lookup(state, asked)
    return asked.join(exact, "ask_id", "left").select("ask_id", F.when(F.col("id").isNotNull(), "exact").otherwise("open").alias("origin"))


def cache_files(s, d):
    """Files of each stored answer, once each in order, from a list that names them twice."""
    rows = table(s, d, "cached_answers").withColumn("files", F.concat("files", F.array(F.lit("")), "files"))
    return cache.keyed(rows).select("id", F.array_join("files", "|").alias("files"))


NAMED = [
    files_scan_hash, files_site_folders, files_eval_lines, files_terms, files_known_sites, files_markdown_table, sink_clean_texts_append, sink_log_append_truncate, sink_clean_metadata, sink_schema_union,
    sink_catalog_rows, report_documents, limit_candidates, corpus_error_rows, non_blank_answers, cjk_marked, identifier_check, index_resume_by_hash, answer_previews, titles_escaped, numbers_grouped,
    links_resolved, confirm_tokens, html_pages, request_bodies, log_moments, image_sizes, detected_scripts, text_vectors, rerank_pairs, answer_eval_rows, crawl_frontier, catalog_new_downloads,
    catalog_distinct_files, graph_filter_structured, graph_contexts, log_history_columns, log_image_stats, star_customers_without_urgent_orders, cache_answer_states, cache_files,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


SQL = {
    "files_scan_hash": "select item_id, octet_length(encode(question))::bigint + 1 length, sha256(question || chr(10)) file_hash from (select item_id, question from eval_set_gold_manual)",
    "files_site_folders": "select r_name \"domain\", 2 files, 2 * length(r_name) + 18 bytes from region",
    "files_eval_lines": "select question, coalesce(array_to_string(list_transform(refs, lambda x: coalesce(x, '<null>')), '|'), '') refs, answer_ref from eval_set_gold_manual",
    "files_terms": "select trim(n_name) term from nation",
    "files_known_sites": r"""with k as (select page_id, page_url, regexp_replace(regexp_replace(lower(trim(page_url)), '[?#;].*$', ''), '/+$', '') site from scanned_pages where trim(page_url) <> '')
        select site, min(page_id) pos, arg_min(page_url, page_id) url from k group by 1""",
    "files_markdown_table": "select trim(p_name) \"name\", p_size::varchar size from part where p_partkey % 10 > 1",
    "sink_clean_texts_append": f"with {BASE} select h hash, length(t) chars from u",
    "sink_log_append_truncate": "select 2 * count(*) removed, 0::bigint \"left\" from events",
    "sink_clean_metadata": """with k as (select content_hash h, min(output_path) p from document_records where output_path is not null group by 1)
        select page_id, coalesce(p, clean_text_path) clean_text_path, clean_text_hash from scanned_pages left join k on h = clean_text_hash""",
    "sink_schema_union": "select source_path, language, null file_type from document_records union all select source_path, null, file_type from documents",
    "sink_catalog_rows": r"select page_id, page_url, coalesce(len(list_distinct(regexp_extract_all(page_text, '(https?://[^\s<>\"''=]+)', 1))), 0)::bigint links from scanned_pages where page_id % 2 = 0",
    "report_documents": rf"""with {BASE}, x as (select *, len(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\-]*[\p{{L}}\p{{N}}_]')) n, regexp_matches(t, '[^\x00-\x7F]') w from u),
        k as (select content_hash, max(output_path is not null) saved from document_records group by 1), l as (select saved from u join k on h = content_hash), v as (select count(*) linked, count(*) filter (where saved) saved from l)
        select 'total_candidates' "key", count(*) "value" from c union all select 'processed', count(*) from c union all select 'unique', count(*) from u union all select 'duplicates', sum(copies - 1)::bigint from u
        union all select 'documents_with_non_ascii', count(*) from x where w union all select 'cleaned_with_output', saved from v union all select 'linked_clean_documents', linked from v
        union all select 'unlinked_clean_documents', greatest(saved - linked, 0) from v union all select 'short_documents', count(*) from x where n <= 200 union all select 'long_documents', count(*) from x where n >= 4000""",
    "limit_candidates": "select count(*) taken, max(doc_id) last_id, (select count(*) from documents) total from (select doc_id from documents order by doc_id limit 100)",
    "corpus_error_rows": f"select doc_id, 'empty_after_clean' error from (select doc_id, text from documents union all select -item_id - 1, answer_ref from eval_set_gold_manual) where {clean('text')} = ''",
    "non_blank_answers": f"select item_id from eval_set_gold_manual where {strip('answer_ref')} <> ''",
    "cjk_marked": "select id from cached_answers where answer is not null and id % 7 = 0",
    "identifier_check": "select id, regexp_full_match(trim(coalesce(model, '')), '[A-Za-z_][A-Za-z0-9_]*') ok from cached_answers",
    "index_resume_by_hash": f"with {BASE} select doc_id from n where h not in (select content_hash from document_records where content_hash is not null)",
    "answer_previews": r"""with f as (select id, replace(coalesce(answer, ''), chr(10), ' ') f from cached_answers)
        select id ask_id, case when length(f) > 600 then left(f, 600) || '…' else f end preview, regexp_matches(f, '[\x{4E00}-\x{9FFF}]') "foreign" from f""",
    "titles_escaped": f"select page_id, {_escaped('page_title')} title from scanned_pages",
    "numbers_grouped": "select o_orderkey, replace(format('{:,.2f}', o_totalprice), ',', ' ') price, replace(format('{:,}', o_custkey * 1000), ',', ' ') customer from orders",
    "links_resolved": r"select page_id, link, regexp_replace(link, '#.*$', '') resolved from (select page_id, unnest(list_distinct(regexp_extract_all(page_text, '(https?://[^\s<>\"''=]+)', 1))) link from scanned_pages)",
    "confirm_tokens": "select event_id, case when event_id % 3 = 0 then null else event_type || '_' || user_id end token from events",
    "html_pages": """with p as (select page_id, coalesce(trim(page_title), '') t, coalesce(page_url, '') u, coalesce(pdf_file_name, '') f from scanned_pages)
        select page_id, t title, t || '|two parts' headings, concat_ws(chr(10), nullif(t, ''), nullif(t, ''), 'see', nullif(trim(f), ''), 'now', 'no', 'two', 'parts') "text", nullif(u, '') href, case when u <> '' then left(trim(f), 150) end anchor,
        case when u <> '' then left(concat_ws(' ', 'see', nullif(trim(f), ''), 'now'), 200) end snippet from p""",
    "request_bodies": f"select id, nullif({strip("coalesce(question, '')")}, '') \"text\", case when {strip("coalesce(question, '')")} = '' then 400 else 200 end::bigint status from cached_answers",
    "log_moments": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') iso, epoch_us(ts) / 1e6 epoch from events",
    "image_sizes": """with x as (select event_id, event_id % 5 > 0 ok, user_id, event_id + 1 h from events)
        select event_id, case when ok then user_id end::int width, case when ok then h end::int height, case when ok then 'png' end kind,
        case when ok then to_base64(unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(user_id), 8, '0') || lpad(hex(h), 8, '0') || '0806000000')) end png from x""",
    "detected_scripts": r"""with x as (select doc_id, lower(left(coalesce(text, ''), 4000)) t from documents), n as (select doc_id, len(regexp_extract_all(t, '[а-яё]')) c, len(regexp_extract_all(t, '[a-z]')) l from x)
        select doc_id, case when c + l = 0 then 'unknown' when c / (c + l) >= 0.8 then 'cyrillic' when c / (c + l) < 0.5 and 1 - c / (c + l) >= 0.8 then 'latin' else 'unknown' end script from n""",
    "text_vectors": "select doc_id, length(text)::double a, (length(text) - length(replace(text, ' ', '')))::double b from documents",
    "rerank_pairs": f"""with {OVERLAP}, z as (select query_id, doc_id, rank, length(coalesce(question, '')) q, length(coalesce(text, '')) n from h join documents using (doc_id) join eval_set_gold_manual on item_id = query_id where rank <= 10),
        y as (select *, row_number() over (partition by query_id order by case when q % 2 = 1 then 0 else -n end, rank) new_rank from z) select query_id, doc_id, new_rank::int new_rank from y where new_rank <= 5""",
    "answer_eval_rows": f"""with {OVERLAP}, f as (select query_id, string_agg(text, '|' order by rank) docs_sample from h join documents using (doc_id) where rank <= 3 group by 1),
        v as (select vec_id, embedding::double[] e from embeddings), x as (select item_id query_id, question, answer_ref answer, a.e a, r.e r, o.e o from eval_set_gold_manual left join v a on a.vec_id = item_id left join v r on r.vec_id = item_id + 1 left join v o on o.vec_id = item_id + 2)
        select query_id, question, answer, round(list_cosine_similarity(a, r), 6) ref_sim, round(greatest(list_cosine_similarity(a, r), list_cosine_similarity(a, o)), 6) refs_sim, (r is not null)::bigint + (o is not null)::bigint refs_count, coalesce(docs_sample, '') docs_sample from x left join f using (query_id)""",
    "crawl_frontier": """with recursive r(k, depth) as (select 1::bigint, 0 union all select s_suppkey, depth + 1 from r join supplier on s_suppkey in (2 * k, 2 * k + 1))
        select 's' || k url, depth::int depth from r""",
    "catalog_new_downloads": r"""with p as (select * from scanned_pages where page_url is not null), f as (select resource_id, page_url u, pdf_file_name n from p where page_id % 2 = 0),
        a as (select distinct resource_id + page_id % 2 resource_id, page_url u from p where page_id % 3 = 0), o as (select u, min(n) n from f group by 1)
        select a.resource_id, 'o' origin_url, a.u download_url, coalesce(n, nullif(string_split(regexp_replace(regexp_replace(a.u, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', ''), '/')[-1], ''), 'file') file_name, n is not null skipped
        from a left join o using (u) where not exists (select 1 from f where f.resource_id = a.resource_id and f.u = a.u)""",
    "catalog_distinct_files": "select distinct source_path from documents where coalesce(source_path, '') <> ''",
    "graph_filter_structured": """with e as (select event_id pos, 'u' || user_id head, case event_type when 'click' then 'uses' when 'purchase' then 'Part Of' else 'related_to' end rel, value score, case when event_id % 4 = 0 then 'e' || event_id end id from events),
        f as (select *, replace(lower(rel), ' ', '_') pred from e where rel <> 'related_to' and (score is null or score >= 1)), k as (select *, coalesce(id, head || '|' || pred || '|t') edge_id from f),
        b as (select *, row_number() over (partition by edge_id order by score desc nulls last, pos) n, min(pos) over (partition by edge_id) first_pos from k) select edge_id, head, rel, round(score, 6) score, first_pos from b where n = 1""",
    "graph_contexts": """with n as (select n_regionkey k, list(n_name order by n_name) names from nation group by 1)
        select r_regionkey, '[Сводка сообщества #1 (L' || r_regionkey || ', id=None)]' || chr(10) || r_name || chr(10) || chr(10) || '[Структура]' || chr(10) || '• Программы/проекты: ' || array_to_string(names[1:12], ', ') || chr(10) || chr(10)
        || '[Связи]' || chr(10) || array_to_string(list_transform(names[1:3], lambda x: '- ' || x || ' -related_to→ ' || r_name || case when r_regionkey % 2 = 0 then ' [score=0.50]' else '' end), chr(10)) || chr(10) || chr(10)
        || '[Якорные узлы] ' || array_to_string(list_transform(names, lambda x: x || ' (?)'), ', ') context from region join n on k = r_regionkey""",
    "log_history_columns": """select event_id id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') created_at, case when event_id % 2 = 0 then 'text' else 'image' end input_type, 'm' model, event_type status, case when event_type = 'error' then 'failed' end error,
        value duration_ms, user_id text_len, try_cast(json_extract_string(props, '$.k') as bigint) token_count, user_id * 2 image_width, user_id * 3 image_height, left(props, 200) response_preview from events order by event_id desc limit 200""",
    "log_image_stats": """select event_type status, count(*) requests, round(quantile_cont(value, 0.99), 6) duration_p99, round(avg(user_id * 2) filter (where event_id % 3 = 0), 6) image_width_mean,
        round(quantile_cont(user_id * 2, 0.5) filter (where event_id % 3 = 0), 6) image_width_p50, round(quantile_cont(user_id * 3 + 1, 0.5) filter (where event_id % 3 = 0), 6) image_height_p50 from events group by 1""",
    "star_customers_without_urgent_orders": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "cache_files": "select id, coalesce(array_to_string(list_transform(list_filter(range(1, len(files) + 1), lambda i: files[i] is not null and files[i] <> '' and list_position(files, files[i]) = i), lambda i: files[i]), '|'), '') files from cached_answers",
    "cache_answer_states": f"with {STATE} select a.id ask_id, case when exists (select 1 from g where g.question_hash = sha256(regexp_replace(lower({strip("coalesce(a.question, '')")}), '\\s+', ' ', 'g')) and g.model_key in (lower({strip("coalesce(a.model, '')")}), '')) then 'exact' else 'open' end origin from cached_answers a where a.id % 50 = 0",
}
