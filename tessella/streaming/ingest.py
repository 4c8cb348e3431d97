"""Streaming forms: append of new contents once, upsert of cache rows, windowed request statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.text import clean, content_hash
from tessella.operators.cache import keyed, storable, upserted


def new_contents(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Each cleaned content once within the watermark on added_at; its state is bounded by ``late``."""
    hashed = docs.withColumn("clean", clean(F.coalesce("text", F.lit("")))).where("clean <> ''").withColumn("hash", content_hash(F.col("clean")))
    return hashed.withWatermark("added_at", late).dropDuplicatesWithinWatermark(["hash"])


def windowed_stats(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, mean and largest duration per status and window of created_at."""
    w = F.window("created_at", window)
    return log.withWatermark("created_at", late).groupBy(w, "status").agg(F.count(F.lit(1)).alias("requests"), F.avg("duration_ms").alias("duration_mean"), F.max("duration_ms").alias("duration_max"))


def upsert_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append cache rows by micro-batch; ``cache_state`` folds them. A batch that is run again writes to its own folder again."""

    def write(batch: DataFrame, number: int) -> None:
        storable(keyed(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_state(spark, path: str) -> DataFrame:
    return upserted(spark.read.parquet(path))
