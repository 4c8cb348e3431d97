"""Models the caller gives: language detectors, embedders. All run in Arrow batches; a failing call gives no value, not a failed job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are looked at, least probability, and the name of no answer.
SNIPPET, LEAST, UNKNOWN = 4_000, 0.8, "unknown"


def language(text: Column, detect: Callable[[str], tuple[str, float]] | None = None) -> Column:
    """The language that ``detect`` (text -> name, probability) finds in the first ``SNIPPET`` characters, ``unknown`` below ``LEAST``,
    without a detector, on an error and for null or empty text."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if detect is None or not t:
                return UNKNOWN
            try:
                name, p = detect(t)
            except Exception:  # a text the detector cannot judge
                return UNKNOWN
            return name if p >= LEAST else UNKNOWN

        return s.map(one)

    return run(F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET))


def embedded(text: Column, encode: Callable[[list[str]], list]) -> Column:
    """Vectors of a batch of texts by ``encode``; null text and failed batches give null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        known = [t for t in s if t is not None]
        try:
            found = iter([[float(x) for x in v] for v in encode(known)]) if known else iter(())
            return pd.Series([next(found) if t is not None else None for t in s], dtype=object)
        except Exception:  # the model is the caller's; its failure costs this batch its vectors
            return pd.Series([None] * len(s), dtype=object)

    return run(text)
