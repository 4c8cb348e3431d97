"""Exact quantiles by linear interpolation, without gathering a group's values in one task.

Values are counted first (added up before the shuffle). Few different values are interpolated from their counts directly. Many are
parted into bins at approximate quantiles; the bins' sums tell which bins hold the wanted ranks, and only those are ordered.
Nulls are passed over; a measure without values has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage, release

# Different (group, measure, value) rows up to which one aggregation takes them all; beyond it they are parted into bins.
DIRECT_ROWS = 1_000_000
BINS = 128


def value_counts(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, measure, value, n) of several numeric columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*by, F.explode(pairs).alias("_x")).select(*by, "_x.measure", "_x.value").where("value is not null")
    return rows.groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: tuple[str, ...], quantiles: tuple[float, ...], by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """(by, measure, n, min, max, mean, q) with ``q`` the quantiles in the given order.

    ``rows`` is the number of rows where the caller knows it; if it bounds the different values low enough, they are not written first.
    """
    counts = value_counts(df, columns, by)
    few = rows is not None and rows * len(columns) <= DIRECT_ROWS
    counts = counts if few else cut_lineage(counts)
    keys = [*by, "measure"]
    base = [F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")]
    if few or counts.count() <= DIRECT_ROWS:
        return counts.groupBy(*keys).agg(*base, F.percentile("value", F.array(*map(F.lit, quantiles)), F.col("n")).alias("q"))
    out = counts.groupBy(*keys).agg(*base)
    return out.join(_by_rank(counts, out, keys, quantiles), _same(out, keys), "left").select(*[out[c] for c in out.columns], "q")


def _same(left: DataFrame, keys: list[str], mark: str = "k_"):
    """Null-safe equality of the keys with their renamed copies."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(mark + k))
    return on


def _by_rank(counts: DataFrame, totals: DataFrame, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """(k_ keys, q) by picking the values of the two ranks next to each quantile."""
    renamed = [F.col(k).alias("k_" + k) for k in keys]
    ends = counts.groupBy(*keys).agg(F.percentile_approx("value", [i / BINS for i in range(1, BINS)], 10_000).alias("ends")).select(*renamed, "ends")
    binned = counts.join(F.broadcast(ends), _same(counts, keys)).withColumn("bin", F.size(F.filter("ends", lambda e: e < F.col("value"))))
    binned = cut_lineage(binned.select(*keys, "value", "n", "bin"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows a group
    bins = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(w)).select(*keys, "bin", (F.col("upto") - F.col("m")).alias("before"), "upto")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * q).alias("k")) for i, q in enumerate(quantiles)])).alias("x")
    rank = totals.select(*renamed, at).select(*["k_" + k for k in keys], "x.i", "x.k")
    rank = rank.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("k"), F.ceil("k")))))
    wanted = bins.join(rank, _same(bins, keys)).where("before <= rank and rank < upto").select(*["k_" + k for k in keys], F.col("bin").alias("k_bin"), "before", "i", "k", "rank")
    held = wanted.select(*["k_" + k for k in keys], "k_bin", "before").distinct()
    v = Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one bin's values
    part = binned.join(F.broadcast(held), _same(binned, [*keys, "bin"]))
    part = part.withColumn("upto", F.col("before") + F.sum("n").over(v)).select(*keys, "bin", "value", (F.col("upto") - F.col("n")).alias("from"), "upto")
    hit = part.join(F.broadcast(wanted), _same(part, [*keys, "bin"])).where("`from` <= rank and rank < upto")
    value = hit.groupBy(*["k_" + k for k in keys], "i", "k").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    value = value.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") - F.floor("k")))
    out = cut_lineage(value.groupBy(*["k_" + k for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q")))
    release(binned)
    return out
