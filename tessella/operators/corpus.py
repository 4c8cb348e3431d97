"""Corpus statistics: cleaning, exact duplicates, vocabulary, TF-IDF, coverage, quality metrics.

Every function takes and returns DataFrames. ``docs`` has doc_id, text and lang; the order of
documents is that of doc_id. Null text counts as empty. Empty tables give empty results, and
metrics over nothing are 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import CHUNK, OVERLAP, clean, content_hash, has_non_ascii, term_counts, tokenize
from tessella.operators.quantiles import profile
from tessella.session import cut_lineage

SHORT_TOKENS, LONG_TOKENS = 200, 4000
TOP_TERMS, TFIDF_FEATURES, TFIDF_MIN_DF = 50, 2000, 2
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
# Groups of equal contents up to which their hashes are broadcast (about 100 bytes each); beyond it that join is shuffled.
BROADCAST_GROUPS = 500_000


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, lang, cleaned text and its content hash."""
    kept = docs.select("doc_id", "lang", clean(F.coalesce("text", F.lit(""))).alias("clean"))
    return kept.withColumn("hash", content_hash(F.col("clean")))


def non_empty(clean_docs: DataFrame) -> DataFrame:
    return clean_docs.where("clean <> ''")


def empty_after_clean(clean_docs: DataFrame) -> DataFrame:
    """(doc_id, error) of the documents that cleaning left empty."""
    return clean_docs.where("clean = ''").select("doc_id", F.lit("empty_after_clean").alias("error"))


def canonical_ids(clean_docs: DataFrame) -> DataFrame:
    """(hash, doc_id, copies): the first document of each content; only ids and hashes are shuffled."""
    return non_empty(clean_docs).groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def canonical(clean_docs: DataFrame) -> DataFrame:
    """One row per content, that of its first document (hash, doc_id, lang, clean); no text is shuffled."""
    return firsts(non_empty(clean_docs).select("hash", "doc_id", "lang", "clean"))


def firsts(rows: DataFrame) -> DataFrame:
    """The rows (hash, doc_id, ...) of the first document of each content.

    Contents that occur once pass; of the others the row of the first document is kept, against the hashes of the repeated contents only.
    Rows that repeat a document id with its content count once.
    """
    once = rows.groupBy("hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    multi = once.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("copies"), F.max("n").alias("same")).where("copies > 1")
    multi = cut_lineage(multi)
    groups, same = multi.agg(F.count(F.lit(1)), F.max("same")).first()
    known = multi.select("hash", "first_id")
    if groups <= BROADCAST_GROUPS:
        known = F.broadcast(known)
    kept = rows.join(known, "hash", "left").where("first_id is null or first_id = doc_id").select(*rows.columns)
    return kept if (same or 1) == 1 else kept.dropDuplicates(["hash"])


def measured(clean_docs: DataFrame) -> DataFrame:
    """(hash, doc_id, lang, copies, chars, tokens, chunks, non_ascii) of each content, the empty one too, in one pass; no text leaves the scan."""
    text = F.col("clean")
    chars = F.length(text)
    per = clean_docs.select(
        "hash", "doc_id", "lang", chars.cast("bigint").alias("chars"), F.size(tokenize(text)).cast("bigint").alias("tokens"),
        F.when(chars > 0, 1 + F.greatest(F.lit(0), F.ceil((chars - CHUNK) / F.lit(float(CHUNK - OVERLAP))))).otherwise(0).cast("bigint").alias("chunks"), has_non_ascii(text).alias("non_ascii"),
    )
    same = [F.max(c).alias(c) for c in ("chars", "tokens", "chunks", "non_ascii")]
    one = per.groupBy("hash").agg(F.min(F.struct("doc_id", "lang")).alias("f"), F.count(F.lit(1)).alias("copies"), *same)
    return one.select("hash", "f.doc_id", "f.lang", "copies", "chars", "tokens", "chunks", "non_ascii")


def unique_measures(clean_docs: DataFrame) -> DataFrame:
    """``measured`` of the contents that are not empty."""
    return measured(clean_docs).where("chars > 0")


def duplicate_groups(clean_docs: DataFrame, top: int = 10, examples: int = 5) -> DataFrame:
    """The largest groups of equal content: canonical id, duplicates (without it), the first few duplicates.

    Groups are counted without being gathered; examples are taken for the top groups only.
    """
    groups = canonical_ids(clean_docs).where("copies > 1").orderBy(F.desc("copies"), "doc_id").limit(top)
    member = non_empty(clean_docs).select("hash", F.col("doc_id").alias("dup")).join(F.broadcast(groups), "hash").where("dup > doc_id")
    w = Window.partitionBy("hash").orderBy("dup")
    few = member.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= examples)
    few = few.groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dup")), lambda x: x.cast("string")), ",").alias("examples"))
    return groups.join(few, "hash").select("doc_id", (F.col("copies") - 1).alias("duplicates"), "examples")


def duplicate_rows(clean_docs: DataFrame) -> DataFrame:
    """(doc_id, first_id) of every document whose content an earlier one has."""
    first = canonical_ids(clean_docs).where("copies > 1").select("hash", F.col("doc_id").alias("first_id"))
    return non_empty(clean_docs).select("hash", "doc_id").join(first, "hash").where("doc_id <> first_id").select("doc_id", "first_id")


def language_share(unique: DataFrame) -> DataFrame:
    """(lang, docs, share) over unique documents."""
    counts = unique.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("docs"))
    total = counts.agg(F.sum("docs").alias("total"))
    return counts.join(F.broadcast(total)).select("lang", "docs", F.round(F.col("docs") / F.col("total"), 6).alias("share"))


def lengths(unique: DataFrame) -> DataFrame:
    """(doc_id, chars, tokens, chunks, non_ascii) of ``unique_measures``."""
    return unique.select("doc_id", "chars", "tokens", "chunks", "non_ascii")


def _described(rows: DataFrame, *first) -> DataFrame:
    names = [f"p{round(x * 100)}" for x in QUANTILES]
    return rows.select(*first, "n", "min", "max", F.round("mean", 6).alias("mean"), *[F.round(F.col("q")[i], 6).alias(x) for i, x in enumerate(names)])


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, max, mean and quantiles by linear interpolation; no row for no values."""
    return _described(profile(df, (column,), QUANTILES))


def describe_all(rows: DataFrame, columns: tuple[str, ...] = ("chars", "tokens", "chunks")) -> DataFrame:
    """``describe`` of several columns in one pass, one row each."""
    return _described(profile(rows, columns, QUANTILES), "measure")


def vocabulary(unique: DataFrame) -> DataFrame:
    """(term, freq) over all tokens; map-side counts go before the shuffle."""
    return unique.select(F.explode(tokenize(F.col("clean"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def top_terms(vocab: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    return vocab.orderBy(F.desc("freq"), "term").limit(top)


def lexical_diversity(vocab: DataFrame) -> DataFrame:
    row = vocab.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"))
    return row.select("types", "tokens", F.round(F.coalesce(F.col("types") / F.nullif("tokens", F.lit(0)), F.lit(0.0)), 6).alias("diversity"))


def tfidf_top(clean_docs: DataFrame, top: int = TOP_TERMS, features: int = TFIDF_FEATURES, min_df: int = TFIDF_MIN_DF) -> DataFrame:
    """(term, score): mean TF-IDF over the different contents.

    Raw counts, smooth idf ln((1 + n) / (1 + df)) + 1, rows scaled to length one after the vocabulary is cut to the
    ``features`` terms of the highest corpus frequency (ties by term). A document's terms are counted where it is read and written as one row;
    the second pass knows the ``features`` weights and leaves one sum per term and task.
    """
    every = cut_lineage(non_empty(clean_docs).select("hash", "doc_id", term_counts(F.col("clean")).alias("x")).select("hash", "doc_id", "x.terms", "x.n"))
    tf = firsts(every).select("terms", "n")
    each = tf.select(F.explode(F.arrays_zip("terms", "n")).alias("x")).select(F.col("x.terms").alias("term"), "x.n")
    kept = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf")).where(F.col("df") >= min_df)
    total = tf.count()
    rows = kept.orderBy(F.desc("cf"), "term").limit(features).collect()
    idf = {r["term"]: float(np.log((1 + total) / (1 + r["df"])) + 1) for r in rows}
    shared = clean_docs.sparkSession.sparkContext.broadcast((list(idf), {t: i for i, t in enumerate(idf)}, np.array(list(idf.values()))))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, at, weight = shared.value
        sums = np.zeros(len(names))
        for pdf in it:
            for terms, n in zip(pdf["terms"], pdf["n"], strict=True):
                hit = [(at[t], c) for t, c in zip(terms, n, strict=True) if t in at]
                if hit:
                    i, c = map(np.array, zip(*hit, strict=True))
                    w = c * weight[i]
                    sums[i] += w / np.sqrt((w * w).sum())
        if sums.any():
            yield pd.DataFrame({"term": np.array(names, dtype=object)[sums > 0], "s": sums[sums > 0]})

    score = tf.mapInPandas(run, "term string, s double").groupBy("term").agg((F.sum("s") / max(total, 1)).alias("score"))
    return score.orderBy(F.desc(F.round("score", 9)), "term").limit(top).select("term", F.round("score", 6).alias("score"))


def term_coverage(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, hits, present) per listed term in lower case; repeated terms count each time in ``hits``."""
    listed = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("listed"))
    return listed.join(vocab, "term", "left").select("term", "listed", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"), F.col("freq").isNotNull().alias("present"))


def coverage_ratio(coverage: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("present"), F.col("listed")).otherwise(0))
    return coverage.agg(F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"), F.coalesce(hit, F.lit(0)).alias("present")).select(
        "listed", "present", F.round(F.coalesce(F.col("present") / F.nullif("listed", F.lit(0)), F.lit(0.0)), 6).alias("ratio")
    )


def term_sets(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """Listed terms as present (semi join) and missing (anti join)."""
    listed = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    return listed.join(vocab, "term", "left_semi").select("term", F.lit("present").alias("state")).unionByName(listed.join(vocab, "term", "left_anti").select("term", F.lit("missing").alias("state")))


def chunk_lengths(unique: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, chunk_chars) of the fixed windows; ``unique`` has doc_id, chars and chunks."""
    step = CHUNK - OVERLAP
    rows = unique.where("chunks > 0").select("doc_id", "chars", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.least(F.lit(CHUNK), F.col("chars") - F.col("chunk_no") * step).cast("bigint").alias("chunk_chars"))


def quality_metrics(clean_docs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(metric, value): the corpus quality metrics in one row set; every ratio over nothing is 0.0.

    ``records`` (content_hash, output_path) give saved and linked texts; without them both are 0. The texts are read twice:
    for the measures of each content, and for the different terms (equal contents add none, so all documents serve).
    """
    return metrics_of(corpus_counts(clean_docs, records))


def metrics_of(row: DataFrame) -> DataFrame:
    """(metric, value) from the row of ``corpus_counts``."""
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    gap = F.greatest(F.col("saved") - F.col("linked"), F.lit(0))
    values = {
        "duplicate_ratio": ratio("duplicates", "processed"), "error_rate": ratio("errors", "processed"),
        "clean_text_coverage": ratio("linked", "unique"), "clean_text_linked_ratio": ratio("linked", "saved"),
        "metadata_gap_ratio": F.coalesce(gap / F.nullif(F.col("saved"), F.lit(0)), F.lit(0.0)),
        "short_doc_ratio": ratio("short", "unique"), "long_doc_ratio": ratio("long", "unique"),
        "avg_tokens_per_document": ratio("tokens", "unique"), "avg_chars_per_document": ratio("chars", "unique"),
        "avg_chunks_per_document": ratio("chunks", "unique"), "avg_tokens_per_chunk": ratio("tokens", "chunks"),
        "lexical_diversity": ratio("types", "tokens"), "dominant_language_share": ratio("dominant", "unique"),
        "unique_token_count": F.col("types"), "largest_duplicate_group": F.coalesce("largest", F.lit(0)), "non_ascii_ratio": ratio("non_ascii", "unique"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v.cast("double"), 6).alias("value")) for k, v in values.items()])
    return row.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")


def corpus_counts(clean_docs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row of the counts behind the quality metrics."""
    every = cut_lineage(measured(clean_docs))
    full = F.col("chars") > 0
    row = every.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("processed"), F.coalesce(F.sum(F.when(~full, F.col("copies"))), F.lit(0)).alias("errors"), F.count_if(full).alias("unique"),
        F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.sum("chunks").alias("chunks"), F.count_if(full & (F.col("tokens") <= SHORT_TOKENS)).alias("short"),
        F.count_if(full & (F.col("tokens") >= LONG_TOKENS)).alias("long"), F.count_if("non_ascii").alias("non_ascii"),
        F.sum(F.when(full, F.col("copies") - 1)).alias("duplicates"), F.max(F.when(full & (F.col("copies") > 1), F.col("copies"))).alias("largest"),
    )
    unique = every.where(full)
    lang = unique.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).count().agg(F.max("count").alias("dominant"))
    types = non_empty(clean_docs).select(F.explode(tokenize(F.col("clean"))).alias("term")).distinct().agg(F.count(F.lit(1)).alias("types"))
    if records is None:
        link = unique.limit(1).agg(F.lit(0).alias("saved"), F.lit(0).alias("linked"))
    else:
        known = records.groupBy(F.col("content_hash").alias("hash")).agg(F.max(F.col("output_path").isNotNull()).alias("saved"))
        link = unique.select("hash").join(known, "hash").agg(F.count_if("saved").alias("saved"), F.count(F.lit(1)).alias("linked"))
    for one in (lang, types, link):  # frames of one row
        row = row.join(F.broadcast(one))
    return row


def classification_summary(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(field, value, total) of several columns in one pass; null counts as 'unknown'."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("total"))


def document_details(clean_docs: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, hash, chars, tokens, linked): unique documents with a mark whether a record knows their content."""
    known = records.select(F.col("content_hash").alias("hash"), F.lit(True).alias("linked")).distinct()
    return unique_measures(clean_docs).join(known, "hash", "left").select("doc_id", "hash", "chars", "tokens", F.coalesce("linked", F.lit(False)).alias("linked"))


def link_catalog(records: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_id, link, linked_id): the file of the record's path, else the first page of its file name."""
    file = files.select("source_path", F.col("doc_id").alias("file_id"))
    page = pages.where("pdf_file_name is not null").groupBy(F.col("pdf_file_name").alias("file_name")).agg(F.min("page_id").alias("page_id"))
    rec = records.select("record_id", "source_path", F.element_at(F.split("source_path", "/"), -1).alias("file_name"))
    both = rec.join(file, "source_path", "left").join(page, "file_name", "left")
    link = F.when(F.col("file_id").isNotNull(), "file").when(F.col("page_id").isNotNull(), "page").otherwise("none")
    return both.select("record_id", link.alias("link"), F.coalesce("file_id", "page_id").alias("linked_id"))
