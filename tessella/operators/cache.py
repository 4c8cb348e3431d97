"""Question-answer cache: upsert history, exact lookup with model fallback, nearest stored question.

Rows arrive in the order of id. Null questions count as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import content_hash, model_key, squeeze
from tessella.functions.vectors import cosine, filled

THRESHOLD, SCAN = 0.92, 200


def distinct_files(files: Column) -> Column:
    """Different non-empty names in order of first appearance; null gives none."""
    return F.array_distinct(F.filter(F.coalesce(files, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def keyed(rows: DataFrame) -> DataFrame:
    """Normalised texts, their hashes, the model key and the different files, computed anew from question, answer, model and files."""
    q, a = squeeze(F.col("question")), squeeze(F.col("answer"))
    return rows.withColumns({"question_normalized": q, "answer_normalized": a, "model_key": model_key(F.col("model")), "question_hash": content_hash(q), "answer_hash": content_hash(a)} | ({"files": distinct_files(F.col("files"))} if "files" in rows.columns else {}))


def storable(rows: DataFrame) -> DataFrame:
    """Rows that an upsert accepts: neither question nor answer empty."""
    return rows.where((F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))


def upserted(rows: DataFrame) -> DataFrame:
    """State after all rows: per (question_hash, model_key) the first id, the last row's values, the last known embedding."""
    last = F.max_by(F.struct("question", "answer", "files", "model", "answer_hash", "created_at"), "id")
    state = rows.groupBy("question_hash", "model_key").agg(
        F.min("id").alias("first_id"), last.alias("l"), F.max_by("embedding", F.when(F.size("embedding") > 0, F.col("id"))).alias("embedding"), F.count(F.lit(1)).alias("versions")
    )
    return state.select(F.col("first_id").alias("id"), "question_hash", "model_key", "l.*", "embedding", "versions")


def exact_lookup(state: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, id): the entry of the asked question and model; else that of the question without model."""
    want = asked.select("ask_id", content_hash(squeeze(F.col("question"))).alias("question_hash"), model_key(F.col("model")).alias("want"))
    hit = want.join(state.select("question_hash", "model_key", "id", "created_at"), "question_hash").where((F.col("model_key") == F.col("want")) | (F.col("model_key") == ""))
    best = F.max_by("id", F.struct((F.col("model_key") == F.col("want")).alias("same"), "created_at", "id"))
    return hit.groupBy("ask_id").agg(best.alias("id"))


def similar_lookup(state: DataFrame, asked: DataFrame, threshold: float = THRESHOLD, scan: int = SCAN) -> DataFrame:
    """(ask_id, id, similarity): the nearest of the ``scan`` newest entries of the asked or no model, above the threshold.

    The window is part of the semantics: it is kept per model key, so the compared side has ``scan`` rows a model at most;
    of entries equally near the newest wins.
    """
    entry = state.withColumn("embedding", filled(F.col("embedding"))).where("embedding is not null").select("id", "model_key", "embedding", "created_at")
    keys = asked.select(model_key(F.col("model")).alias("want")).distinct()
    own = keys.join(entry, F.col("want") == F.col("model_key"))
    w0 = Window.partitionBy("model_key").orderBy(F.desc("created_at"), F.desc("id"))
    blank = entry.where("model_key = ''").withColumn("rn", F.row_number().over(w0)).where(F.col("rn") <= scan).drop("rn")
    scope = own.unionByName(keys.where("want <> ''").join(F.broadcast(blank)))  # ``scan`` rows
    w = Window.partitionBy("want").orderBy(F.desc("created_at"), F.desc("id"))
    scope = scope.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= scan)
    ask = asked.select("ask_id", model_key(F.col("model")).alias("want"), F.col("embedding").alias("q"))
    pairs = ask.join(scope, "want").withColumn("similarity", cosine(F.col("q"), F.col("embedding")))
    best = F.max_by(F.struct("id", "similarity"), F.struct("similarity", "created_at", "id"))
    return pairs.where(F.col("similarity") > threshold).groupBy("ask_id").agg(best.alias("b")).select("ask_id", "b.id", "b.similarity")
