"""Chunk index: minimum length, signature duplicates, resumed and replacing loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.splitting import recursive_chunks
from tessella.functions.text import py_strip

MIN_LENGTH = 30


def min_length(df: DataFrame, text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """Rows whose stripped text has at least ``least`` characters, with the text stripped."""
    return df.withColumn(text, py_strip(F.col(text))).where(F.length(text) >= least)


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(py_strip(F.col(text)) != "")


def first_per_signature(df: DataFrame, key: tuple[str, ...], pos: str, text: str = "text") -> DataFrame:
    """The first row (least ``pos``) of each key and text; a null key part counts as the text 'None'.

    Only the signature and ``pos`` are shuffled; rows come back by a join on ``pos``, which must be unique.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in key]
    firsts = df.select(pos, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)], F.md5(text).alias("sig")).alias("s")).groupBy("s").agg(F.min(pos).alias(pos))
    return df.join(firsts.select(pos), pos, "left_semi")


def not_yet_indexed(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key).distinct(), key, "left_anti")


def replace_by_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """Old rows of sources that ``new`` does not have, and all new rows; a null source never matches."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def split_chunks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk_no, chunk) of the recursive splitter."""
    return non_blank(df, text).select(key, F.posexplode(recursive_chunks(F.col(text))).alias("chunk_no", "chunk"))
