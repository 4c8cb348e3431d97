"""Named queries over whole tables, and the SQL each is held against.

Search queries take as query set every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text, web
from tessella.operators import cache, catalog, corpus, graph, indexing, requests, retrieval
from tessella.plans import catalogue_io
from tessella.plans.oracles import SQL, TERMS
from tessella.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
# How event types stand for predicates in the graph queries.
PREDICATES = {"click": "uses", "view": "Part Of", "purchase": "supports", "signup": "", "error": "broken_by"}


def _clean(s: SparkSession, d: str) -> DataFrame:
    return corpus.cleaned(spread(table(s, d, "documents")))


def _unique(s: SparkSession, d: str) -> DataFrame:
    return corpus.canonical(_clean(s, d))


def _measures(s: SparkSession, d: str) -> DataFrame:
    return corpus.unique_measures(_clean(s, d))


def corpus_clean_stats(s, d):
    docs = spread(table(s, d, "documents")).select(F.coalesce("text", F.lit("")).alias("t"), text.clean(F.coalesce("text", F.lit(""))).alias("c"))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("c") == "").alias("empty"), F.count_if(F.col("c") != F.col("t")).alias("changed"), F.sum(F.length("c")).alias("chars"))


def corpus_dedup_canonical(s, d):
    return corpus.canonical_ids(_clean(s, d)).select("doc_id", "hash", "copies")


def corpus_duplicate_groups(s, d):
    return corpus.duplicate_groups(_clean(s, d))


def corpus_language_share(s, d):
    return corpus.language_share(_measures(s, d))


def corpus_doc_lengths(s, d):
    return corpus.lengths(_measures(s, d))


def corpus_length_describe(s, d):
    return corpus.describe_all(_measures(s, d))


def corpus_vocabulary_top50(s, d):
    return corpus.top_terms(corpus.vocabulary(_unique(s, d)))


def corpus_lexical_diversity(s, d):
    return corpus.lexical_diversity(corpus.vocabulary(_unique(s, d)))


def corpus_tfidf_top50(s, d):
    return corpus.tfidf_top(_clean(s, d))


def _terms(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(t,) for t in TERMS], "term string")


def corpus_term_coverage(s, d):
    return corpus.term_coverage(corpus.vocabulary(_unique(s, d)), _terms(s))


def corpus_term_ratio(s, d):
    return corpus.coverage_ratio(corpus_term_coverage(s, d))


def corpus_term_sets(s, d):
    return corpus.term_sets(corpus.vocabulary(_unique(s, d)), _terms(s))


def corpus_chunks(s, d):
    return corpus.chunk_lengths(_measures(s, d))


def corpus_chunk_stats(s, d):
    return corpus.describe(corpus_chunks(s, d), "chunk_chars")


def corpus_quality_metrics(s, d):
    return corpus.quality_metrics(_clean(s, d), table(s, d, "document_records"))


def corpus_classification_summary(s, d):
    return corpus.classification_summary(table(s, d, "documents"), ("file_type", "lang", "source"))


def corpus_document_details(s, d):
    return corpus.document_details(_clean(s, d), table(s, d, "document_records"))


def catalog_record_links(s, d):
    return corpus.link_catalog(table(s, d, "document_records"), table(s, d, "documents"), table(s, d, "scanned_pages"))


def index_min_length_dedup(s, d):
    kept = indexing.min_length(spread(table(s, d, "documents")).select("doc_id", "source", "text"))
    return indexing.first_per_signature(kept, ("source",), "doc_id").select("doc_id", F.length("text").cast("bigint").alias("chars"))


def index_resume_antijoin(s, d):
    docs = table(s, d, "documents").select("doc_id", "source_path")
    return indexing.not_yet_indexed(docs, table(s, d, "document_records"), "source_path")


def index_replace_source(s, d):
    """Pages of the sites that sent documents give way to those documents."""
    old = table(s, d, "scanned_pages").select(F.col("page_id").alias("id"), F.coalesce(F.regexp_extract(F.lower("page_url"), r"^https?://(?:www\.)?([^/:]+)", 1), F.lit("")).alias("source"), F.lit("page").alias("kind"))
    new = table(s, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("document").alias("kind"))
    return indexing.replace_by_source(old, new)


def index_recursive_split(s, d):
    return indexing.split_chunks(spread(table(s, d, "documents")), "doc_id")


def _every_50(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 50 == 0)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def vector_topk_cosine(s, d):
    v = table(s, d, "embeddings")
    return _rounded(retrieval.top_k(v, _every_50(v, "vec_id"), 10), "score")


def vector_topk_indexed(s, d):
    """By cells; recall against the exact search is measured in the tests."""
    v = table(s, d, "embeddings")
    return _rounded(retrieval.indexed_top_k(v, _every_50(v, "vec_id"), 10), "score")


def vector_topk_l2(s, d):
    v = table(s, d, "embeddings")
    return _rounded(retrieval.top_k(v, _every_50(v, "vec_id"), retrieval.FETCH_K, "l2"), "score")


def vector_rerank(s, d):
    v = table(s, d, "embeddings")
    hits = retrieval.top_k(v, _every_50(v, "vec_id"), retrieval.FETCH_K, "l2")
    return _rounded(retrieval.rerank(hits, v), "rerank_score")


def vector_unique_hits(s, d):
    """Hits without repeated (label) signatures: the first of each label per query."""
    v = table(s, d, "embeddings")
    hits = retrieval.top_k(v, _every_50(v, "vec_id"), retrieval.FETCH_K).join(v.select("vec_id", "label"), "vec_id")
    return retrieval.unique_hits(hits, ("label",)).select("query_id", "vec_id", "label", "rank")


def retrieval_metrics_label(s, d):
    """Relevant: same label; references: all relevant candidates."""
    v = table(s, d, "embeddings")
    q = _every_50(v, "vec_id")
    hits = retrieval.top_k(v, q, 50)
    lab = v.select("vec_id", "label")
    found = hits.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").where("label = want")
    size = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_refs"))
    asked = q.join(size, "label").select(F.col("vec_id").alias("query_id"), "n_refs")
    return retrieval.evaluation(asked, found.select("query_id", F.col("vec_id").alias("ref_no"), "rank"))


def retrieval_metrics_text(s, d):
    gold = table(s, d, "eval_set_gold_manual")
    docs = table(s, d, "documents")
    refs = gold.select(F.col("item_id").alias("query_id"), F.posexplode("refs").alias("ref_no", "ref")).where(F.trim("ref") != "")
    hits = retrieval.overlap_top_k(docs, gold.select(F.col("item_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text")), 50)
    asked = gold.select(F.col("item_id").alias("query_id")).join(refs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_refs")), "query_id", "left")
    return retrieval.evaluation(asked.select("query_id", F.coalesce("n_refs", F.lit(0)).alias("n_refs")), retrieval.containment_matches(hits, docs, refs))


def _similarities(s, d):
    """Each vector as an answer: its neighbour by id as reference, the three neighbours as references."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    near = v.select(F.explode(F.array(*[F.col("vec_id") - i for i in (1, 2, 3)])).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("ref"))
    pairs = v.join(near, "vec_id").select("vec_id", (F.col("other") - F.col("vec_id")).alias("gap"), retrieval.cosine(F.col("embedding"), F.col("ref"), clamp=False).alias("sim"))
    return v.select("vec_id").join(pairs.groupBy("vec_id").agg(F.max(F.when(F.col("gap") == 1, F.col("sim"))).alias("ref_sim"), F.max("sim").alias("refs_sim")), "vec_id", "left")


def answer_similarity_summary(s, d):
    return retrieval.similarity_means(_similarities(s, d))


def similarity_histogram(s, d):
    return requests.histogram(_similarities(s, d), "ref_sim")


def number_summary(s, d):
    """Summary of a text column that holds a number in JSON."""
    return requests.summary(table(s, d, "events"), F.get_json_object("props", "$.k"))


def _cache(s, d):
    return cache.storable(cache.keyed(table(s, d, "cached_answers")))


def cache_keys(s, d):
    return cache.keyed(table(s, d, "cached_answers")).select("id", "question_normalized", "answer_normalized", "model_key", "question_hash", "answer_hash")


def cache_upsert_latest(s, d):
    state = cache.upserted(_cache(s, d))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return state.select("id", "question_hash", "model_key", "answer", "answer_hash", F.round(total, 6).alias("embedding_sum"), "versions")


def cache_exact_lookup(s, d):
    rows = table(s, d, "cached_answers")
    asked = _every_50(rows, "id").select(F.col("id").alias("ask_id"), "question", "model")
    return cache.exact_lookup(cache.upserted(_cache(s, d)), asked)


def cache_similar_lookup(s, d):
    rows = table(s, d, "cached_answers")
    asked = _every_50(rows, "id").select(F.col("id").alias("ask_id"), "model", "embedding")
    return _rounded(cache.similar_lookup(cache.upserted(_cache(s, d)), asked), "similarity")


def context_build(s, d):
    gold = table(s, d, "eval_set_gold_manual").select(F.col("item_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text"))
    docs = table(s, d, "documents")
    return retrieval.context(retrieval.overlap_top_k(docs, gold, retrieval.TOP_K), docs, "source")


def _log(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("event_type").alias("status"), F.col("value").alias("duration_ms"), F.col("user_id").alias("text_len"), F.get_json_object("props", "$.k").try_cast("bigint").alias("token_count"))


def log_history_200(s, d):
    return requests.history(_log(s, d)).select("id", "status", "duration_ms", "text_len", "token_count")


def log_stats(s, d):
    return requests.stats(_log(s, d))


def log_stats_by_status(s, d):
    return requests.stats(_log(s, d), ("status",))


def request_lengths(s, d):
    return requests.request_rows(table(s, d, "cached_answers"))


def pages_url_normalize(s, d):
    return catalog.url_columns(table(s, d, "scanned_pages"))


def pages_domain_counts(s, d):
    return catalog.domain_counts(table(s, d, "scanned_pages"))


def pages_headings(s, d):
    return catalog.headings(table(s, d, "scanned_pages"))


def pages_titles(s, d):
    return catalog.titles(table(s, d, "scanned_pages"))


def pages_links(s, d):
    return catalog.links(table(s, d, "scanned_pages"))


def page_file_names(s, d):
    return table(s, d, "scanned_pages").select("page_id", web.safe_file_name(F.coalesce("page_title", "page_url")).alias("safe_name"))


def _edges(s, d):
    e = table(s, d, "events")
    rel = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])[F.col("event_type")]
    score = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 100)
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("head"), rel.alias("rel"), F.get_json_object("props", "$.k").alias("tail"), score.alias("score"), F.lit(None).cast("string").alias("edge_id"), F.concat(F.lit(" event "), F.col("event_id").cast("string")).alias("cite"))


def graph_edge_filter(s, d):
    return graph.filter_edges(_edges(s, d), 0.1).select("edge_id", "head", "rel", "tail", F.round("score", 6).alias("score"))


def graph_edge_best(s, d):
    return graph.filter_edges(_edges(s, d), 0.1, limit=None).select("edge_id", "rel", F.round("score", 6).alias("score"), "first_pos")


def graph_edge_parse(s, d):
    e = table(s, d, "events")
    line = F.concat(F.lit("- u"), F.col("user_id").cast("string"), F.lit(" -"), F.col("event_type"), F.lit("→ k"), F.get_json_object("props", "$.k"), F.lit(" [score="), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("] [#edge:"), F.col("event_id").cast("string"), F.lit("]"))
    return e.select("event_id", graph.parse_edge(line).alias("x")).select("event_id", "x.*")


def graph_context(s, d):
    return graph.edge_context(graph.filter_edges(_edges(s, d), 0.1))


def list_normalize(s, d):
    rows = table(s, d, "cached_answers").where("answer is not null")
    return rows.select("id", web.numbered_list(F.col("answer")).alias("answer"))


def files_coerce(s, d):
    rows = table(s, d, "cached_answers").select("id", F.to_json("files").alias("j"))
    return rows.select("id", F.array_join(web.coerce_files(F.col("j")), "|").alias("files"))


def word_overlap_scores(s, d):
    """Containment or word overlap of each gold item's references with its answer."""
    gold = table(s, d, "eval_set_gold_manual").select("item_id", "answer_ref", F.explode("refs").alias("r"))
    return gold.groupBy("item_id").agg(F.round(F.max(retrieval.overlap_score(F.col("answer_ref"), F.col("r"))), 6).alias("score"))


def star_revenue(s, d):
    o, li, c, n = (table(s, d, t) for t in ("orders", "lineitem", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


NAMED = [
    corpus_clean_stats, corpus_dedup_canonical, corpus_duplicate_groups, corpus_language_share, corpus_doc_lengths, corpus_length_describe,
    corpus_vocabulary_top50, corpus_lexical_diversity, corpus_tfidf_top50, corpus_term_coverage, corpus_term_ratio, corpus_term_sets, corpus_chunks, corpus_chunk_stats,
    corpus_quality_metrics, corpus_classification_summary, corpus_document_details, catalog_record_links, index_min_length_dedup, index_resume_antijoin,
    index_replace_source, index_recursive_split, vector_topk_cosine, vector_topk_indexed, vector_topk_l2, vector_rerank, vector_unique_hits, retrieval_metrics_label, retrieval_metrics_text,
    answer_similarity_summary, similarity_histogram, number_summary, cache_keys, cache_upsert_latest, cache_exact_lookup, cache_similar_lookup, context_build,
    log_history_200, log_stats, log_stats_by_status, request_lengths, pages_url_normalize, pages_domain_counts, pages_headings, pages_titles, pages_links, page_file_names,
    graph_edge_filter, graph_edge_best, graph_edge_parse, graph_context, list_normalize, files_coerce, word_overlap_scores, star_revenue,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED} | catalogue_io.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | catalogue_io.SQL
