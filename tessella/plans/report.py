"""Corpus report: small aggregates gathered into one dict, written as JSON and HTML; lists that grow with the corpus as tables beside it.

``python -m tessella.plans.report [--documents PATH | --input-dirs DIR ...] [--records PATH] [--terms-file FILE] [--output-dir DIR] [--report-dir DIR] [--max-files N] [--overwrite] [--no-output-text] [--log-level LEVEL]``

Without documents and folders the default input folders of the working directory are read.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.models import language
from tessella.functions.times import utc_now
from tessella.operators import corpus
from tessella.session import cut_lineage, ensure_importable, spread
from tessella.sources import files, readers, sinks

ERROR_SAMPLES = 10
# How the metrics are shown (label, format, digits).
SHOWN = {
    "duplicate_ratio": ("Duplicates", "percent", 2), "error_rate": ("Errors", "percent", 2), "clean_text_coverage": ("Has saved text", "percent", 2),
    "clean_text_linked_ratio": ("Linked of saved", "percent", 2), "metadata_gap_ratio": ("Saved without link", "percent", 2), "short_doc_ratio": ("Short documents", "percent", 1),
    "long_doc_ratio": ("Long documents", "percent", 1), "avg_tokens_per_document": ("Tokens per document", "number", 1), "avg_chars_per_document": ("Characters per document", "number", 1),
    "avg_chunks_per_document": ("Chunks per document", "number", 2), "avg_tokens_per_chunk": ("Tokens per chunk", "number", 1), "lexical_diversity": ("Lexical diversity", "number", 4),
    "dominant_language_share": ("Share of the main language", "percent", 1), "unique_token_count": ("Different tokens", "integer", 0), "largest_duplicate_group": ("Largest group of copies", "integer", 0),
    "non_ascii_ratio": ("Documents with non-ASCII", "percent", 1),
}


def shown(metric: str, value: float) -> str:
    _, kind, digits = SHOWN[metric]
    return sinks.percent(value, digits) if kind == "percent" else sinks.grouped(round(value) if kind == "integer" else float(value), digits)


def first_documents(docs: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` documents by id; none means all."""
    return docs if n is None else docs.orderBy("doc_id").limit(n)


# What the metrics mean.
LEGEND = {
    "duplicate_ratio": "copies of an earlier document, of all processed", "error_rate": "files that gave no text, of all processed", "clean_text_coverage": "unique documents that a record knows",
    "clean_text_linked_ratio": "known documents, of those saved", "metadata_gap_ratio": "saved documents that no record knows", "short_doc_ratio": f"at most {corpus.SHORT_TOKENS} tokens",
    "long_doc_ratio": f"at least {corpus.LONG_TOKENS} tokens", "lexical_diversity": "different tokens, of all tokens", "dominant_language_share": "documents in the most frequent language",
}


def folder_documents(spark: SparkSession, dirs: list[str], detect=None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, path, text, lang) of the readable files below ``dirs``, ids in the order of paths, and (path, error) of the others."""
    found = files.scan_files(spark, dirs)
    read = cut_lineage(files.extracted(spread(found), readers.text_of).orderBy("path").withColumn("doc_id", F.monotonically_increasing_id()))
    return read.where("error is null").select("doc_id", "path", "text", language(F.col("text"), detect).alias("lang")), read.where("error is not null").select("path", "error")


def corpus_report(docs: DataFrame, records: DataFrame | None = None, terms: DataFrame | None = None, max_files: int | None = None, failed: DataFrame | None = None, output_dir: str | None = None, report_dir: str | None = None) -> dict:
    """The report of a corpus; ``total_candidates`` counts before ``max_files`` applies.

    ``failed`` (path, error) are files that could not be read. Only aggregates of bounded size reach the driver: single rows, top lists and
    counts by language or class. Duplicates, document details and errors are written as JSON lines below ``report_dir``, where one is given.
    """
    bad = 0 if failed is None else failed.count()
    total = docs.count() + bad
    taken = first_documents(docs, max_files)
    clean = cut_lineage(corpus.cleaned(spread(taken)))
    unique = cut_lineage(corpus.unique_measures(clean))
    texts = cut_lineage(corpus.canonical(clean))
    vocab = cut_lineage(corpus.vocabulary(texts))
    row = cut_lineage(corpus.corpus_counts(clean, records))
    counts = row.first().asDict()
    metrics = {r["metric"]: r["value"] for r in corpus.metrics_of(row).collect()}
    described = {r["measure"]: {k: v for k, v in r.asDict().items() if k != "measure"} for r in corpus.describe_all(unique).collect()}
    listed = terms if terms is not None else docs.sparkSession.createDataFrame([], "term string")
    coverage = corpus.term_coverage(vocab, listed)
    place = F.col("path") if "path" in docs.columns else F.col("doc_id").cast("string")
    errors = corpus.empty_after_clean(clean).join(taken.select("doc_id", place.alias("path")), "doc_id").select("path", "error")
    errors = errors if failed is None else errors.unionByName(failed)
    present = [c for c in ("content_type", "education_level", "audience", "purpose", "file_type", "source") if c in docs.columns]
    rows = lambda df: [r.asDict() for r in df.collect()]
    processed = counts["processed"] + bad
    if bad:  # files without text count as processed and as errors
        metrics["duplicate_ratio"] = round((counts["duplicates"] or 0) / processed, 6)
        metrics["error_rate"] = round((counts["errors"] + bad) / processed, 6)
    details = {}
    if report_dir:
        known = records if records is not None else docs.sparkSession.createDataFrame([], "content_hash string")
        lists = {"document_details": corpus.document_details(clean, known), "duplicates": corpus.duplicate_rows(clean), "errors": errors}
        for name, df in lists.items():
            details[name] = os.path.join(report_dir, name)
            df.write.mode("overwrite").json(details[name])
    return {
        "generated_at_utc": utc_now(),
        "documents": {
            "total_candidates": total, "processed": processed, "unique": counts["unique"], "duplicates": counts["duplicates"] or 0, "duplicate_ratio": metrics["duplicate_ratio"],
            "language_distribution": {r["lang"]: r["docs"] for r in corpus.language_share(unique).orderBy(F.desc("docs"), "lang").collect()},
            "documents_with_non_ascii": counts["non_ascii"], "cleaned_with_output": counts["saved"], "linked_clean_documents": counts["linked"],
            "unlinked_clean_documents": max(counts["saved"] - counts["linked"], 0), "short_documents": counts["short"], "long_documents": counts["long"],
            "char_stats": described.get("chars", {}), "token_stats": described.get("tokens", {}), "chunk_count_stats": described.get("chunks", {}),
            "chunk_size_stats": next(iter(rows(corpus.describe(corpus.chunk_lengths(unique), "chunk_chars"))), {}),
        },
        "quality_metrics": [{"metric": k, "label": SHOWN[k][0], "value": v, "shown": shown(k, v)} for k, v in metrics.items()],
        "legend": LEGEND,
        "top_terms": rows(corpus.top_terms(vocab)),
        "tfidf_top_features": rows(corpus.tfidf_top(texts)),
        "term_coverage": corpus.coverage_ratio(coverage).first().asDict() | {"missing": sorted(r["term"] for r in coverage.where("not present").collect())},
        "top_duplicate_groups": rows(corpus.duplicate_groups(clean)),
        "errors_total": counts["errors"] + bad,
        "error_samples": rows(errors.orderBy("path").limit(ERROR_SAMPLES)),
        "output_dir": output_dir,
        "dashboard_path": os.path.join(report_dir, "eda_dashboard.html") if report_dir else None,
        "db_available": records is not None,
        "classification_summary": rows(corpus.classification_summary(taken, tuple(present)).orderBy("field", F.desc("total"), "value")) if present else [],
    } | details


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--documents")
    p.add_argument("--input-dirs", nargs="*")
    p.add_argument("--records")
    p.add_argument("--terms-file")
    p.add_argument("--output-dir", default="processed_eda_data")
    p.add_argument("--report-dir", default="analysis/reports")
    p.add_argument("--max-files", type=int)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--no-output-text", action="store_true")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ensure_importable(spark)
    spark.sparkContext.setLogLevel({"WARNING": "WARN", "CRITICAL": "FATAL"}.get(a.log_level, a.log_level))
    docs, failed = (spark.read.parquet(a.documents), None) if a.documents else folder_documents(spark, a.input_dirs if a.input_dirs else files.default_input_dirs(os.getcwd()))
    output = None if a.no_output_text else a.output_dir
    report = corpus_report(docs, spark.read.parquet(a.records) if a.records else None, files.terms(spark, a.terms_file), a.max_files, failed, output, a.report_dir)
    if output:
        sinks.write_clean_texts(corpus.canonical(corpus.cleaned(first_documents(docs, a.max_files))), output, a.overwrite)
    sinks.write_report(report, a.report_dir)
    return report


if __name__ == "__main__":
    main()
