"""Request log: history, statistics, numeric summaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import py_strip
from tessella.functions.web import request_text
from tessella.operators.quantiles import profile

HISTORY = 200


def history(log: DataFrame, n: int = HISTORY) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


# What is told of each measure.
MEASURES = {"duration_ms": ("duration", True, (0.5, 0.95, 0.99)), "text_len": ("text_len", True, (0.5,)), "token_count": ("token_count", True, ()), "image_width": ("image_width", True, (0.5,)), "image_height": ("image_height", False, (0.5,))}
QS = (0.5, 0.95, 0.99)


def stats(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, means and linear percentiles; nulls are passed over, no values give null. Columns the log lacks give null as well."""
    have = tuple(c for c in MEASURES if c in log.columns)
    told = profile(log, have, QS, by, log.count())  # of a table, its metadata tell
    cell = lambda c, v: F.round(F.max(F.when(F.col("measure") == c, v)), 6)
    cells = []
    for c, (name, mean, qs) in MEASURES.items():
        cells += [cell(c, F.col("mean")).alias(f"{name}_mean")] * mean + [cell(c, F.col("q")[QS.index(x)]).alias(f"{name}_p{round(x * 100)}") for x in qs]
    count = log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))
    wide = told.groupBy(*by).agg(*cells)
    names = [x for x in wide.columns if x not in by]
    if not by:
        return count.join(F.broadcast(wide), how="left").select("requests", *names)  # one row each
    wide = wide.withColumnsRenamed({b: f"_{b}" for b in by})
    on = [count[b].eqNullSafe(wide[f"_{b}"]) for b in by]
    return count.join(wide, on, "left").select(*by, "requests", *names)


def parsed(bodies: DataFrame, body: str = "body", kind: str = "content_type") -> DataFrame:
    """``bodies`` with text and status: the ``text`` or ``question`` of a JSON body or of a form; 400 where there is none."""
    raw = F.col(body)
    form = F.str_to_map(F.coalesce(raw, F.lit("")), F.lit("&"), F.lit("="))
    field = lambda k: F.nullif(F.try_url_decode(F.replace(form[k], F.lit("+"), F.lit("%20"))), F.lit(""))
    text = F.when(F.contains(F.coalesce(kind, F.lit("")), F.lit("json")), request_text(raw)).otherwise(F.coalesce(field("text"), field("question")))
    return bodies.withColumn("text", F.nullif(py_strip(text), F.lit(""))).withColumn("status", F.when(F.col("text").isNull(), 400).otherwise(200))


def request_rows(cached: DataFrame) -> DataFrame:
    """Log rows of cached questions: lengths of the stripped text, model with default, preview of the answer."""
    text = py_strip(F.coalesce("question", F.lit("")))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return cached.select("id", F.length(text).cast("bigint").alias("text_len"), F.size(words).cast("bigint").alias("token_count"), F.coalesce(F.nullif("model", F.lit("")), F.lit("deepseek")).alias("model"), F.left("answer", F.lit(200)).alias("response_preview"))


def summary(df: DataFrame, value: Column) -> DataFrame:
    """mean, median and sample deviation of what parses as a number."""
    v = df.select(value.try_cast("double").alias("v"))
    return v.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.round(F.stddev_samp("v"), 6).alias("std"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n) of equal-width bins between the least and the largest value; a single value falls into bin 0."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
