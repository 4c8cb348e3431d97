"""Mixing sources to target shares by Sainte-Laguë apportionment of equal-token blocks.

Blocks of the mix go one by one to the source of the highest quotient share / (2 * blocks + 1) whose
cap (``max_repeats`` times its tokens) is not yet reached. A source's blocks are whole passes over all
its documents plus a rest, and the rest is apportioned to the source's shards by their tokens in the
same way. Within a shard documents follow in seeded order until the shard's quota is filled.

Shards hold about ``SHARD_DOCS`` documents, so no window covers a whole source, however large. The
driver sees one row per (source, shard), never a document.

The report gives each source's wanted share (its target over those of the sources that can take part) and the deviation of the actual one.
A source's tokens differ from its quota by less than one block (the rest that is no whole block) and half a document a shard
(a document is taken if its middle lies within the quota).

Defined results: documents of a source without target, of null source or without tokens are not
used; a target without documents gets nothing and is reported; repeated targets add up their shares
and take the larger cap; a null or negative share counts 0, a null cap 1. Without ``total_tokens`` the mix is
the largest in which the sources that have documents can keep their relative shares.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.tokens import bpe_path, with_token_counts
from tessella.session import cut_lineage, spread

SHARD_DOCS = 100_000
BLOCKS = 20_000
SEED = 17


def sainte_lague(weights: list[float], caps: list[int], blocks: int) -> list[int]:
    """Blocks for each party; parties at their cap are passed over, ties go to the earlier one."""
    won = [0] * len(weights)
    heap = [(-w, i) for i, (w, c) in enumerate(zip(weights, caps, strict=True)) if w > 0 and c > 0]
    heapq.heapify(heap)
    for _ in range(blocks):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def _targets(targets: DataFrame) -> DataFrame:
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    return targets.where("source is not null").groupBy("source").agg(F.sum(share).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))


def sized_documents(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, ord, shard) of the documents that can be used."""
    tokenizer = tokenizer or f"bpe:{bpe_path()}"
    used = docs.select("doc_id", "source", "text").join(_targets(targets).select("source"), "source", "left_semi")
    sized = with_token_counts(spread(used), "doc_id", "text", tokenizer, keep=("source",)).where("n_tokens > 0")
    sized = cut_lineage(sized.withColumn("ord", F.xxhash64(F.lit(seed), "doc_id")))
    shards = sized.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SHARD_DOCS))).alias("shards"))
    return sized.join(shards, "source").withColumn("shard", F.pmod(F.col("ord"), F.col("shards")).cast("int")).drop("shards")


def quotas(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Per source and per (source, shard): the apportioned tokens."""
    shard = sized.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).orderBy("source", "shard").toPandas()
    goal = _targets(targets).orderBy("source").toPandas()
    have = shard.groupby("source")[["tokens", "docs"]].sum()
    goal = goal.join(have, on="source").fillna({"tokens": 0, "docs": 0}).astype({"tokens": "int64", "docs": "int64"})
    can = goal[(goal["tokens"] > 0) & (goal["target_share"] > 0) & (goal["max_repeats"] > 0)]
    if total_tokens is None:
        share = can["target_share"] / can["target_share"].sum()
        total_tokens = int((can["max_repeats"] * can["tokens"] / share).min()) if len(can) else 0
    total_tokens = min(total_tokens, int((can["max_repeats"] * can["tokens"]).sum()))
    block = max(1, total_tokens // BLOCKS)
    caps = (goal["max_repeats"].astype("int64") * goal["tokens"] // block).tolist()
    goal["quota"] = [q * block for q in sainte_lague(goal["target_share"].tolist(), caps, total_tokens // block)]
    goal["passes"] = (goal["quota"] // goal["tokens"].where(goal["tokens"] > 0, 1)).astype("int64")
    goal["rest"] = goal["quota"] - goal["passes"] * goal["tokens"]
    shard["quota"] = 0
    for s, part in shard.groupby("source"):
        row = goal[goal["source"] == s].iloc[0]
        rest = sainte_lague(part["tokens"].tolist(), (part["tokens"] // block + 1).tolist(), int(row["rest"]) // block)
        shard.loc[part.index, "quota"] = [r * block for r in rest]
    return goal, shard


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, repeats) and the report by source."""
    spark = docs.sparkSession
    sized = sized_documents(docs, targets, tokenizer, seed)
    goal, shard = quotas(sized, targets, total_tokens)
    q = shard.merge(goal[["source", "passes"]], on="source") if len(shard) else shard.assign(passes=0)
    q = spark.createDataFrame(q[["source", "shard", "quota", "passes"]], "source string, shard int, quota bigint, passes bigint") if len(q) else spark.createDataFrame([], "source string, shard int, quota bigint, passes bigint")
    # The window is bounded by SHARD_DOCS.
    w = Window.partitionBy("source", "shard").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("n_tokens").over(w)).join(q, ["source", "shard"])
    extra = (F.col("upto") * 2 - F.col("n_tokens") < F.col("quota") * 2).cast("bigint")
    chosen = placed.withColumn("repeats", F.col("passes") + extra).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    chosen = cut_lineage(chosen)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    plan = _plan(spark, goal)
    total = got.agg(F.sum("used_tokens").alias("total"))
    report = plan.join(got, "source", "left").join(F.broadcast(total), how="left")  # one row
    used = F.coalesce("used_tokens", F.lit(0))
    report = report.select(
        "source", "target_share", "max_repeats", "docs", "available_tokens", "quota_tokens",
        used.alias("used_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "wanted_share", F.coalesce(used / F.col("total"), F.lit(0.0)).alias("actual_share"),
    )
    return chosen, report.withColumn("deviation", F.col("actual_share") - F.col("wanted_share"))


def _plan(spark, goal: pd.DataFrame) -> DataFrame:
    """The apportionment by source, one row per target."""
    able = goal["target_share"].where((goal["tokens"] > 0) & (goal["max_repeats"] > 0), 0.0)
    goal = goal.assign(wanted=able / able.sum() if able.sum() else 0.0)
    rows = goal[["source", "target_share", "max_repeats", "docs", "tokens", "quota", "wanted"]]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, docs bigint, available_tokens bigint, quota_tokens bigint, wanted_share double")


def apportioned(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = None, seed: int = SEED) -> DataFrame:
    """The apportionment alone: source, target_share, max_repeats, docs, available_tokens, quota_tokens, wanted_share."""
    return _plan(docs.sparkSession, quotas(sized_documents(docs, targets, tokenizer, seed), targets, total_tokens)[0])
