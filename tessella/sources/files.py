"""Sources: office files, JSON lines, term lists, site lists, markdown tables, SQL tables.

Missing folders are skipped; a missing single file is an error, as it is asked for by name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.web import site_key
from tessella.session import cut_lineage, path_exists
from tessella.sources.readers import pages_of

# Document kinds, the default input folders and their prefix.
EXTENSIONS = (".pdf", ".docx", ".pptx")
DEFAULT_DIRS, DIR_PREFIX = ("scraped_site", "gigachat_materials"), "gigachat_"
EVAL_SCHEMA = "question string, references array<string>, answer_ref string"
FILES = "base_dir string, path string, length bigint, content binary"


def default_input_dirs(root: str) -> list[str]:
    """Existing default folders and those with the prefix, each once."""
    named = [d for d in DEFAULT_DIRS if os.path.isdir(os.path.join(root, d))]
    more = sorted(d for d in (os.listdir(root) if os.path.isdir(root) else []) if d.startswith(DIR_PREFIX) and os.path.isdir(os.path.join(root, d)))
    return [os.path.join(root, d) for d in dict.fromkeys(named + more)]


def scan_files(spark: SparkSession, dirs: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """base_dir, path, length, content of all files under ``dirs`` whose suffix matches, case aside.

    Content is read only where a plan uses it.
    """
    out = spark.createDataFrame([], FILES)
    for d in dirs:
        if path_exists(spark, d):
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(d)
            kept = found.where(F.lower("path").rlike(rf"({'|'.join(e.replace('.', chr(92) + '.') for e in extensions)})$"))
            out = out.unionByName(kept.select(F.lit(d).alias("base_dir"), "path", "length", "content"))
    return out


def site_folders(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("pages", "materials"), extensions: tuple[str, ...] = (*EXTENSIONS, ".txt")) -> DataFrame:
    """Files below ``root/<domain>/<kind>``, with their domain; the root is on any file system Spark knows."""
    pattern = f"{root.rstrip('/')}/*/{{{','.join(kinds)}}}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    files = scan_files(spark, sorted(x.getPath().toString() for x in found) if found else [], extensions)
    return files.withColumn("domain", F.element_at(F.split("base_dir", "/"), -2))


def extracted(files: DataFrame, extract: Callable[[str, bytes], str]) -> DataFrame:
    """path, file_hash, text, error: ``extract`` is given by the caller; a raised error goes to the error column."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((extract(p, bytes(c)), None))
                except Exception as e:  # a file that cannot be read is a result, not a failure
                    rows.append((None, f"extract_failed: {e}"))
            yield pd.DataFrame({"path": pdf["path"], "file_hash": pdf["file_hash"], "text": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return files.select("path", "content", F.sha2("content", 256).alias("file_hash")).mapInPandas(run, "path string, file_hash string, text string, error string")


def loaded_pages(files: DataFrame) -> DataFrame:
    """path, file_hash, page, text, error: a row for each page that is not blank; a file that cannot be read gives one row with its error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for p, h, c in zip(pdf["path"], pdf["file_hash"], pdf["content"], strict=True):
                try:
                    rows += [(p, h, i, t, None) for i, t in pages_of(p, bytes(c))]
                except Exception as e:  # a file that cannot be read is a result, not a failure
                    rows.append((p, h, None, None, f"extract_failed: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "file_hash", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content", F.sha2("content", 256).alias("file_hash")).mapInPandas(run, "path string, file_hash string, page int, text string, error string")


def eval_lines(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Questions with references ([] where missing) and answer; ``tolerant`` drops malformed lines, else they raise."""
    df = spark.read.schema(EVAL_SCHEMA).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return df.withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def terms(spark: SparkSession, path: str | None) -> DataFrame:
    """Stripped non-empty lines; no path gives no terms."""
    if path is None:
        return spark.createDataFrame([], "term string")
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''")


def known_sites(lines: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """First spelling of each site, in the order of first appearance."""
    return lines.where(F.trim(url) != "").groupBy(site_key(F.col(url)).alias("site")).agg(F.min(pos).alias("pos"), F.min_by(url, pos).alias("url"))


def rewrite_known_sites(lines: DataFrame, path: str, url: str = "url", pos: str = "pos") -> DataFrame:
    """``known_sites`` written as a text file of one address a line, in order; the list is short, so one task writes it."""
    sites = cut_lineage(known_sites(lines, url, pos))
    sites.orderBy("pos").coalesce(1).select("url").write.mode("overwrite").text(path)
    return sites


def markdown_table(lines: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """Rows of a pipe table with exactly these columns; heading, rule and ragged lines are dropped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(value), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim(value).startswith("|") & ~F.trim(value).rlike(r"^\|[\s:\-|]+\|?$")).select(cells.alias("c")).where(F.size("c") == len(columns))
    return rows.where(F.col("c") != F.array(*map(F.lit, columns))).select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def sql_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table over JDBC; filters and columns are pushed down. Partitioning options split the read."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()
