"""Token budget: exact token counts of every record's text, rolled up by slice.

Default tokenizer is the project's own pair: ``clean_text`` followed by the token pattern of
``functions.text``. A public byte-level BPE can be named instead (``bpe:FILE``); its rank file is shipped to the workers.

Oversized texts are cut only where the tokenizer is proven not to look across (``cut_text``), in any script:

* own tokens: between a space, line end, punctuation mark or symbol and a letter or digit, where NFKC of the two
  characters together is NFKC of each and makes no token character of the first. No token holds the first, the cleaning
  rules act on runs of white space and never remove one between two tokens, and NFKC composes across no such place.
* byte-level BPE: its split pattern has no look-behind, so any place where one of its matches must end will do: before a
  single space between two other characters, and between a mark other than an apostrophe and a letter or digit.

A text without such a place (one token, or one piece of the split) stays whole. Every text is read once: short ones are
counted there, long ones leave as chunks, which are spread over the workers by (id, chunk number).

Defined results: null text counts 0 tokens; a record without any text row has null tokens.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import clean_text, tokens_of
from tessella.session import spread

TOKENIZERS = os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers")
OWN = "own"
CHUNK_CHARS = 65_536
# Fixed value: the split pattern published with the rank files.
BPE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OWN_PLACE = re.compile(r"(?<=[^\w\-])(?=[^\W_])")
_BPE_PLACE = re.compile(r"(?<=\S)(?= \S)|(?<=[^\s\w'])(?=[^\W_])")
_encoders: dict = {}


def ship(spark: SparkSession, path: str) -> None:
    """Send a file to every worker, once."""
    if not any(f.rsplit("/", 1)[-1] == os.path.basename(path) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)


def _shipped(path: str) -> str:
    """Where the worker has the file; the path itself outside Spark."""
    try:
        there = SparkFiles.get(os.path.basename(path))
    except Exception:  # no session in this process
        return path
    return there if os.path.exists(there) else path


def encoder(path: str):
    """Tokenizer of a rank file, loaded once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(_shipped(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=BPE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def bpe_path(name: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def count_tokens(texts: list[str | None], tokenizer: str = OWN) -> list[int]:
    if tokenizer == OWN:
        return [len(tokens_of(clean_text(t))) for t in texts]
    enc = encoder(tokenizer.removeprefix("bpe:"))
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


@lru_cache(4_096)
def _independent(before: str, after: str) -> bool:
    """Nothing of the own tokenizer crosses from ``before`` to ``after``."""
    x, y = (unicodedata.normalize("NFKC", c) for c in (before, after))
    plain = before == "\n" or unicodedata.category(before)[0] in "PSZ" and not unicodedata.combining(before)
    return plain and not any(c.isalnum() or c in "-_" for c in x) and y[0].isalnum() and unicodedata.normalize("NFKC", before + after) == x + y


def _place(text: str, at: int, tokenizer: str) -> int | None:
    """The first proven place at ``at`` or later."""
    if tokenizer != OWN:
        m = _BPE_PLACE.search(text, at)
        return m.start() if m else None
    return next((m.start() for m in _OWN_PLACE.finditer(text, at) if _independent(text[m.start() - 1], text[m.start()])), None)


def cut_text(text: str, size: int, tokenizer: str = OWN) -> list[str]:
    """Parts of about ``size`` characters whose token counts sum to that of the whole."""
    parts, start = [], 0
    while len(text) - start > size:
        end = _place(text, start + max(size, 1), tokenizer)
        if end is None:
            break
        parts.append(text[start:end])
        start = end
    return [*parts, text[start:]]


PARTS = T.ArrayType(T.StructType().add("n", T.LongType()).add("chunk", T.StringType()))


def with_token_counts(df: DataFrame, key: str, text: str, tokenizer: str = OWN, size: int = CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, ``keep`` columns, n_tokens) for every row of ``df``; ``key`` must be unique.

    Texts up to ``size`` characters are counted where they are read and leave as a number; longer ones leave as chunks.
    """
    if tokenizer != OWN:
        ship(df.sparkSession, tokenizer.removeprefix("bpe:"))

    @F.pandas_udf(PARTS)
    def read(s: pd.Series) -> pd.Series:
        short = [t is None or len(t) <= size for t in s]
        n = iter(count_tokens([t for t, k in zip(s, short, strict=True) if k], tokenizer))
        return pd.Series([[{"n": next(n), "chunk": None}] if k else [{"n": None, "chunk": c} for c in cut_text(t, size, tokenizer)] for t, k in zip(s, short, strict=True)])

    @F.pandas_udf(T.LongType())
    def counted(s: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(s.tolist(), tokenizer), dtype="int64")

    cols = list(dict.fromkeys([key, *keep]))
    parts = df.select(*cols, F.posexplode(read(F.col(text))).alias("_no", "_p")).select(*cols, "_no", "_p.n", "_p.chunk")
    parts = parts.repartition(F.col(key), F.col("_no")).withColumn("n", F.coalesce("n", F.lit(0)) + counted("chunk"))
    return parts.groupBy(*cols).agg(F.sum("n").alias("n_tokens"))


def site_of(url: Column) -> Column:
    """Host in lower case without user, port and leading ``www.``; null or hostless gives null."""
    rest = F.regexp_replace(F.lower(F.regexp_replace(url, r"(?U)\A\s+|\s+\z", "")), r"\A[a-z][a-z0-9+.\-]*:", "")
    host = F.regexp_extract(rest, r"\A(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.\z", ""), r"\Awww\.", ""), F.lit(""))


def record_tokens(records: DataFrame, documents: DataFrame, pages: DataFrame, tokenizer: str = OWN) -> DataFrame:
    """One row per record: record_id, tokens (stored), language, n_tokens (exact), source, domain.

    A record's text is the document of its ``source_path``, else the pages of its file name and
    content hash (equal texts; the count of any of them holds). A repeated record keeps its row.
    """
    doc = spread(documents.where(F.col("source_path").isNotNull()))
    doc_n = with_token_counts(doc, "source_path", "text", tokenizer, keep=("source",)).withColumnRenamed("source", "doc_source")
    page = pages.where(F.col("clean_text_hash").isNotNull() & F.col("pdf_file_name").isNotNull())
    page = spread(page.withColumn("site", site_of(F.col("page_url"))))
    page_n = with_token_counts(page, "page_id", "page_text", tokenizer, keep=("pdf_file_name", "clean_text_hash", "site"))
    page_n = page_n.groupBy("pdf_file_name", "clean_text_hash").agg(F.max("n_tokens").alias("page_tokens"), F.min("site").alias("site"))
    rec = records.select("record_id", "source_path", "content_hash", "tokens", "language")
    rec = rec.join(doc_n.withColumnRenamed("n_tokens", "doc_tokens"), "source_path", "left")
    rec = rec.withColumn("file_name", F.when(F.col("doc_tokens").isNull(), F.element_at(F.split("source_path", "/"), -1)))
    on = (F.col("file_name") == F.col("pdf_file_name")) & (F.col("content_hash") == F.col("clean_text_hash"))
    rec = rec.join(page_n, on, "left")
    source = F.when(F.col("doc_tokens").isNotNull(), F.col("doc_source")).otherwise(F.col("site"))
    return rec.select(
        "record_id",
        F.col("tokens").cast("bigint").alias("tokens"),
        "language",
        F.coalesce("doc_tokens", "page_tokens").alias("n_tokens"),
        F.when(F.col("doc_tokens").isNotNull(), F.lit("documents")).when(F.col("page_tokens").isNotNull(), F.lit("scanned_pages")).alias("origin"),
        F.coalesce(source, F.lit("unknown")).alias("domain"),
    )


def unreliable_counts(counted: DataFrame) -> DataFrame:
    """Records whose stored count is null, with or without a text, or off by more than a tenth of the exact count."""
    off = F.abs(F.col("tokens") - F.col("n_tokens")) * 10 > F.col("n_tokens")
    return counted.where(F.col("tokens").isNull() | off).select("record_id").distinct()


def language_slice(c: Column) -> Column:
    """Two-letter slice name of a stored label; missing labels share one slice."""
    # Three-letter codes of the project's languages.
    three = {"rus": "ru", "eng": "en", "ukr": "uk", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr"}
    base = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"([a-z]+)", 1)
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in three.items() for x in kv])[base], base)
    return F.when(named.isin("", "unknown", "und"), F.lit("unknown")).otherwise(named)


def token_totals(counted: DataFrame) -> DataFrame:
    """Exact totals by origin, language and domain, with their roll-ups ('*' marks all)."""
    dims = ["origin", "lang", "domain"]
    base = counted.where(F.col("n_tokens").isNotNull()).select("origin", language_slice(F.col("language")).alias("lang"), "domain", "n_tokens")
    sums = base.groupBy(*dims).agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("n_tokens"))
    cube = sums.groupingSets([[F.col(d) for d in s] for s in (dims, ["origin"], ["lang"], ["domain"], [])], *dims)
    return cube.agg(F.sum("records").alias("records"), F.sum("n_tokens").alias("total_tokens")).select(*[F.coalesce(d, F.lit("*")).alias(d) for d in dims], "records", "total_tokens")
