"""Bounded samples for fitting classifiers."""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = 1 << 40
# Characters that one text may bring to a fit; see ``drawn_passages``.
FIT_CHARS = 50_000
_PASSAGE = re.compile(r"\S.*?(?:[.!?…](?=\s)|\n|\Z)", re.S)


def drawn(df: DataFrame, key: Column, most: int) -> Column:
    """Whether a row is among about ``most`` (a tenth more at most, but for chance) drawn by hash of ``key``; all are if there are fewer.

    The rows are counted first and then judged where they lie, so neither a sort nor any task's or the
    driver's share grows with the table.
    """
    n = df.count()
    return F.lit(True) if n <= most else F.pmod(F.xxhash64(key, F.lit(29)), F.lit(_SPAN)) < int(_SPAN * 1.05 * most / n)


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows that ``drawn`` picks."""
    return df.where(drawn(df, key, most))


def in_order(rows: list, *names: str) -> list:
    """Collected rows ordered by the named columns, nulls first, so that a fit does not depend on the order of tasks."""
    return sorted(rows, key=lambda r: [(r[n] is not None, r[n] if r[n] is not None else 0) for n in names])


def drawn_passages(text: str | None, most: int) -> str | None:
    """The text if it has at most ``most`` characters, else whole sentences or lines drawn by hash over its whole length, in their order.

    A single sentence longer than ``most`` is passed over.
    """
    if text is None or len(text) <= most:
        return text
    parts = [m.group() for m in _PASSAGE.finditer(text)]
    order = sorted(range(len(parts)), key=lambda i: xxhash.xxh32_intdigest(f"{i}:{len(parts)}"))
    kept, size = [], 0
    for i in order:
        if size + len(parts[i]) <= most:
            kept.append(i)
            size += len(parts[i])
    return "\n".join(parts[i] for i in sorted(kept))


def fit_text(text: Column, most: int = FIT_CHARS) -> Column:
    """``drawn_passages`` where the text lies; shorter texts don't leave the JVM's row for it."""

    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: drawn_passages(t, most))

    return F.when(F.length(text) <= most, text).otherwise(cut(F.when(F.length(text) > most, text)))
