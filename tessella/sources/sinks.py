"""Sinks: clean texts, log, answers, catalog, report files."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import path_exists


def write_clean_texts(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One row per content hash; contents that are stored already stay as they are, new ones are added. ``overwrite`` replaces the table.

    Of rows with one hash that of the least doc_id is kept, where there is such a column.
    """
    if "doc_id" in df.columns:
        df = df.join(df.groupBy("hash").agg(F.min("doc_id").alias("doc_id")), ["hash", "doc_id"], "left_semi").select(*df.columns)
    df = df.dropDuplicates(["hash"])
    if not overwrite and path_exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select("hash").distinct(), "hash", "left_anti").select(*df.columns)
    df.write.mode("overwrite" if overwrite else "append").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate(spark: SparkSession, path: str) -> int:
    """Replace a parquet table by an empty one of the same schema; the number of rows it had."""
    old = spark.read.parquet(path)
    n = old.count()
    old.sparkSession.createDataFrame([], old.schema).write.mode("overwrite").parquet(path)
    return n


def write_answers(df: DataFrame, path: str) -> None:
    """Answer rows as JSON lines, one object a question; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def catalog_rows(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for the page and the link table: pages as crawled, and the links of stored pages under the page's id."""
    page = pages.select("page_id", "resource_id", "page_url", "page_title", "pdf_file_name", "headings", "page_text")
    return page, links.join(pages.select("page_id"), "page_id").select("page_id", "download_url", "anchor_text", "context_snippet")


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def clean_metadata(catalog: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """The catalog with clean_text_path, clean_text_hash and cleaned_at of ``cleaned``, old values where it has none."""
    cols = ["clean_text_path", "clean_text_hash", "cleaned_at"]
    new = cleaned.select(key, *[F.col(c).alias(f"new_{c}") for c in cols])
    have = [c for c in cols if c in catalog.columns]
    out = catalog.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) if c in have else F.col(f"new_{c}") for c in cols}).drop(*[f"new_{c}" for c in cols])


def _number(x) -> float | None:
    """What reads as a number; booleans do not."""
    if isinstance(x, bool):
        return None
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def grouped(n, digits: int = 0) -> str:
    """Number with spaces between thousands, whole numbers without decimals; numeric text counts as a number, anything else is echoed."""
    x = _number(n)
    if x is None:
        return str(n)
    return f"{round(x):,}".replace(",", " ") if digits <= 0 or x.is_integer() else f"{x:,.{digits}f}".replace(",", " ")


def percent(x, digits: int = 1) -> str:
    n = _number(x)
    return str(x) if n is None else f"{n * 100:.{max(0, digits)}f}%"


def write_report(report: dict, folder: str) -> tuple[str, str]:
    """``eda_report.json`` and ``eda_dashboard.html`` of a dict of small aggregates."""
    os.makedirs(folder, exist_ok=True)
    paths = os.path.join(folder, "eda_report.json"), os.path.join(folder, "eda_dashboard.html")
    with open(paths[0], "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, default=str)
    with open(paths[1], "w", encoding="utf-8") as f:
        f.write(dashboard(report))
    return paths


def _table(name: str, rows: list, limit: int) -> str:
    cell = lambda v: f"<td>{html.escape(grouped(v) if isinstance(v, int) else str(v))}</td>"
    rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
    cols = list(rows[0]) if rows else ["value"]
    body = "".join("<tr>" + "".join(cell(r.get(c)) for c in cols) + "</tr>" for r in rows[:limit])
    return f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in cols)}</tr>{body}</table>"


def summary_points(report: dict) -> list[str]:
    """Sentences on the corpus: size, duplicates, main language, term coverage, errors, records."""
    d, out = report.get("documents", {}), []
    if d:
        out.append(f"{grouped(d['processed'])} of {grouped(d['total_candidates'])} candidates were read, {grouped(d['unique'])} of them are different.")
        if d["duplicates"]:
            out.append(f"{grouped(d['duplicates'])} are copies ({percent(d['duplicate_ratio'], 2)}).")
        if d["language_distribution"]:
            name, n = max(d["language_distribution"].items(), key=lambda x: x[1])
            out.append(f"The main language is {name} with {percent(n / max(d['unique'], 1))}.")
        out.append(f"{grouped(d['short_documents'])} are short, {grouped(d['long_documents'])} long.")
    if report.get("term_coverage", {}).get("listed"):
        out.append(f"{percent(report['term_coverage']['ratio'])} of the listed terms occur.")
    if report.get("errors_total"):
        out.append(f"{grouped(report['errors_total'])} files gave no text.")
    if report.get("db_available"):
        out.append(f"{grouped(d.get('linked_clean_documents', 0))} are known to the records, {grouped(d.get('unlinked_clean_documents', 0))} saved ones are not.")
    return out


def dashboard(report: dict, rows: int = 15) -> str:
    """Summary, cards for single values, tables of the first ``rows`` entries for lists and nested parts; classes by field; all text escaped."""
    cards, tables = [], []

    def show(name: str, value) -> None:
        if isinstance(value, dict) and any(isinstance(v, dict | list) for v in value.values()):
            for k, v in value.items():
                show(f"{name}: {k}" if isinstance(v, dict | list) else k, v)
        elif isinstance(value, dict):
            tables.append(_table(name, [{"key": k, "value": v} for k, v in value.items()], max(rows, len(value)) if name.endswith("_stats") else rows))
        elif name == "classification_summary":
            for field in dict.fromkeys(r["field"] for r in value):
                tables.append(_table(f"{name}: {field}", [{k: v for k, v in r.items() if k != "field"} for r in value if r["field"] == field], rows))
        elif isinstance(value, list):
            tables.append(_table(name, value, max(rows, len(value)) if name == "quality_metrics" else rows))
        else:
            cards.append(f"<div class='card'><h2>{html.escape(name)}</h2><p>{html.escape(grouped(value) if isinstance(value, int) else str(value))}</p></div>")

    for name, value in report.items():
        show(name, value)
    points = "".join(f"<li>{html.escape(p)}</li>" for p in summary_points(report))
    return f"<!doctype html><meta charset='utf-8'><title>Corpus report</title><body><ul>{points}</ul>{''.join(cards)}{''.join(tables)}</body>"
