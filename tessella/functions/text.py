"""Text functions of the corpus pipeline: cleaning, tokens, chunks, keys.

Column functions stay in the JVM; NFKC has no Spark builtin, so ``clean`` is an Arrow UDF.
Null text counts as null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes of the text definitions.
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}][{WORD}\-]*[{WORD}]"
TOKEN3 = rf"[{WORD}][{WORD}\-]+[{WORD}]"
SPACE = r"[\s\x1c-\x1f]"

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_BLANKS = re.compile(r"[^\S\n]+")
_BEFORE_NEWLINE = re.compile(r"\s+\n")
_MANY_NEWLINES = re.compile(r"\n{3,}")
_TOKEN = re.compile(r"\b\w[\w\-]+\b")
_TOKEN3 = re.compile(r"\w[\w\-]+\w")
# Length and overlap of the fixed windows.
CHUNK, OVERLAP = 600, 120


def clean_text(text: str | None) -> str:
    """Normal form of a document; null gives the empty string."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _CONTROL.sub(" ", text.replace("﻿", " "))
    text = _MANY_NEWLINES.sub("\n\n", _BEFORE_NEWLINE.sub("\n", _BLANKS.sub(" ", text)))
    return "\n".join(line.rstrip() for line in text.split("\n")).strip()


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@F.pandas_udf(T.StringType())
def clean(text: pd.Series) -> pd.Series:
    return text.map(clean_text)


# Marked so that no filter on the result is pushed below it, which would clean every text twice.
clean = clean.asNondeterministic()
TERMS = T.StructType().add("terms", T.ArrayType(T.StringType())).add("n", T.ArrayType(T.IntegerType()))


@F.pandas_udf(TERMS)
def term_counts(text: pd.Series) -> pd.DataFrame:
    """Different tokens of three or more word characters in lower case, and how often each stands."""
    rows = [Counter(_TOKEN3.findall(t.lower())) if t else {} for t in text]
    return pd.DataFrame({"terms": [list(c) for c in rows], "n": [list(c.values()) for c in rows]})


def tokenize(c: Column) -> Column:
    """Lower-case tokens of two or more word characters, inner hyphens kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def tokenize3(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN3), F.lit(0))


def chunk(c: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Fixed windows; a text no longer than ``size`` is one chunk, an empty text none."""
    step = max(size - overlap, 1)
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(float(step)))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))
    return F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def squeeze(c: Column) -> Column:
    """Question key text: stripped, lower case, single spaces; null gives ''."""
    return F.regexp_replace(F.lower(py_strip(F.coalesce(c, F.lit("")))), rf"(?U){SPACE}+", " ")


def model_key(c: Column) -> Column:
    return F.lower(py_strip(F.coalesce(c, F.lit(""))))


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def has_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{4E00}-\x{9FFF}]")


def chop(c: Column, n: int) -> Column:
    """At most ``n`` characters; a longer text ends in ':'."""
    if n <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit(":"))).otherwise(c)
