"""Evaluation passages inside training documents, by a distributed positional inverted index.

Postings (term, document, variant, position) are stored for the terms of the evaluation items.
Every run of ``n`` consecutive words of an item is a phrase; its rarest term in the corpus is its
anchor. The anchor's postings give candidate places, shifted by the anchor's offset; a place holds the
phrase if the offset-adjusted postings of all its terms meet there. Only documents that hold some
anchor are posted, which drops no match, since a match needs its anchor.

Words are compared after NFKC and without case, punctuation, spacing and invisible characters. A word broken by a hyphen
at a line end is read both ways, as one word (variant 1) and as two (variant 0).
Null or empty texts hold nothing; items of fewer than ``n`` words cannot leak; repeated items each count; rows without an id are passed over.

The items are the held-out set. Their runs pass through the driver in blocks of ``BLOCK_RUNS``, each broadcast by itself
and held against all documents, so any number of items, and items of any length, give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import WORDS, rejoined, visible, word_hashes
from tessella.session import cut_lineage, spread

BLOCK_RUNS = 250_000
# Words and places that are worked on at a time in a task; they bound memory, not the result.
BATCH_WORDS, PLACES = 200_000, 200_000


def item_words(text: str | None) -> list[str]:
    return WORDS.findall(visible(text).lower()) if text else []


def variants(text: str | None) -> list[list[str]]:
    """Word lists of a document: as it stands, and with words joined that a line end broke."""
    if not text:
        return []
    text = visible(text).lower()
    joined = rejoined(text)
    return [WORDS.findall(text)] + ([WORDS.findall(joined)] if joined != text else [])


def phrases(items: DataFrame, n: int = 8, most: int | None = None) -> Iterator[pd.DataFrame]:
    """(item_id, phrase, term, off): the different n-word runs of the items' texts, in blocks of at most ``most`` runs.

    ``phrase`` numbers the runs through all blocks.
    """
    most = most or BLOCK_RUNS
    ids, runs, held, number = [], [], 0, 0

    def block() -> pd.DataFrame:
        m = np.concatenate(runs)
        phrase = np.arange(number, number + len(m))
        return pd.DataFrame({"item_id": np.repeat(np.concatenate(ids), n), "phrase": np.repeat(phrase, n), "term": m.ravel(), "off": np.tile(np.arange(n, dtype=np.int32), len(m))})

    for row in items.select("item_id", "question", "answer_ref", "refs").where("item_id is not null").toLocalIterator():
        hashed = [word_hashes(item_words(t)) for t in (row["question"], row["answer_ref"], *(row["refs"] or []))]
        own = [np.lib.stride_tricks.sliding_window_view(h, n) for h in hashed if len(h) >= n]
        own = np.unique(np.concatenate(own), axis=0) if own else np.empty((0, n), dtype=np.int64)
        while len(own):
            part, own = own[: most - held], own[most - held :]
            ids.append(np.full(len(part), row["item_id"]))
            runs.append(part)
            held += len(part)
            if held == most:
                yield block()
                number += held
                ids, runs, held = [], [], 0
    if held:
        yield block()


def _vocabulary(spark, terms: np.ndarray):
    return spark.sparkContext.broadcast(np.unique(terms))


def _has(sorted_terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_terms, h)
    at[at == len(sorted_terms)] = 0
    return sorted_terms[at] == h


def document_frequency(docs: DataFrame, vocabulary) -> DataFrame:
    """(term, df) over all documents, for the terms of the vocabulary; added up before the shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = vocabulary.value
        count = np.zeros(len(terms), dtype=np.int64)
        for pdf in it:
            for t in pdf["text"]:
                for words in variants(t)[:1]:
                    h = np.unique(word_hashes(words))
                    count[np.searchsorted(terms, h[_has(terms, h)])] += 1
        yield pd.DataFrame({"term": terms[count > 0], "n": count[count > 0]})

    return docs.select("text").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def postings(docs: DataFrame, vocabulary, anchors) -> DataFrame:
    """(term, doc_id, variant, pos) of vocabulary terms, in documents that hold an anchor term."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, needed = vocabulary.value, anchors.value
        for pdf in it:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                for v, words in enumerate(variants(t)):
                    h = word_hashes(words)
                    if len(h) and _has(needed, h).any():
                        pos = np.flatnonzero(_has(terms, h))
                        out.append(pd.DataFrame({"term": h[pos], "doc_id": d, "variant": np.int32(v), "pos": pos.astype("int32")}))
            if out:
                yield pd.concat(out)

    return docs.select("doc_id", "text").mapInPandas(run, "term bigint, doc_id bigint, variant int, pos int")


def _anchored(docs: DataFrame, runs: pd.DataFrame, per_phrase: int = 1):
    """The vocabulary and the anchors (the ``per_phrase`` rarest terms) of a block of runs."""
    vocabulary = _vocabulary(docs.sparkSession, runs["term"].to_numpy())
    df = document_frequency(docs, vocabulary).toPandas()  # at most one row per evaluation term of the block
    runs["df"] = runs["term"].map(dict(zip(df["term"], df["df"], strict=True))).fillna(0)
    # A word joined at a line end may have no count, so a term of frequency 0 is an anchor like any other.
    anchor = runs.sort_values(["phrase", "df", "off"]).drop_duplicates(["phrase", "term"]).groupby("phrase").head(per_phrase)
    columns = ["item_id", "phrase", "term", "off"]
    return vocabulary, anchor[columns]


def _block_places(docs: DataFrame, runs: pd.DataFrame, n: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary, anchor = _anchored(docs, runs)
    posted = cut_lineage(postings(docs, vocabulary, _vocabulary(spark, anchor["term"].to_numpy())))
    columns = ["item_id", "phrase", "term", "off"]
    terms, anchors = (spark.createDataFrame(pa.Table.from_pandas(x[columns], preserve_index=False)) for x in (runs, anchor))
    place = posted.join(anchors, "term").select("item_id", "phrase", "doc_id", "variant", (F.col("pos") - F.col("off")).alias("start"))
    want = place.where("start >= 0").join(terms.select("phrase", "term", "off"), "phrase")
    want = want.withColumn("pos", F.col("start") + F.col("off"))
    met = want.join(posted, ["doc_id", "variant", "term", "pos"])
    same = ["doc_id", "item_id", "phrase", "variant", "start"]
    return met.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select(*same)


def _over_blocks(docs: DataFrame, items: DataFrame, n: int, work, schema: str) -> DataFrame:
    """Union of ``work(docs, runs, n)`` over the blocks of runs."""
    docs, found = spread(docs.select("doc_id", "text").where("doc_id is not null")), None
    for runs in phrases(items, n):
        part = work(docs, runs, n)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def phrase_places(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, item_id, phrase, variant, start): every place where an n-word run of an item stands."""
    return _over_blocks(docs, items, n, _block_places, "doc_id bigint, item_id bigint, phrase bigint, variant int, start int")


def leaked(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    return phrase_places(docs, items, n).select("doc_id", "item_id").distinct()


def _loose_runs(terms: np.ndarray, runs: pd.DataFrame, anchor: pd.DataFrame, n: int):
    """(item, own, first, anchored): per run its item and its different terms as places in ``terms`` (-1 for repeats);
    the runs anchored by term t are anchored[first[t] : first[t + 1]]."""
    own = np.sort(np.searchsorted(terms, runs["term"].to_numpy()).astype(np.int32).reshape(-1, n), axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
    at = np.searchsorted(terms, anchor["term"].to_numpy())
    anchored = (anchor["phrase"].to_numpy() - anchor["phrase"].min())[np.argsort(at, kind="stable")].astype(np.int32)
    return runs["item_id"].to_numpy()[::n], own, np.searchsorted(np.sort(at), np.arange(len(terms) + 1)), anchored


def _loose_hits(term: np.ndarray, pos: np.ndarray, own: np.ndarray, first: np.ndarray, anchored: np.ndarray, n: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(posting, run, matched): runs with ``least`` terms or more within ``n`` words of the posting of one of their anchors.

    ``term`` and ``pos`` are postings in order of position. A place is tried first on 64 bits that sum up its window, which
    can only add terms, then on the positions themselves.
    """
    if not len(pos):
        return
    size = int(pos[-1]) + 1
    window = np.zeros(size + 2 * n, dtype=np.uint64)
    bits = np.uint64(1) << (term & 63).astype(np.uint64)
    for k in range(2 * n + 1):
        window[pos + k] |= bits
    window = window[pos + n]
    span = size + n + 1
    key = np.sort(term.astype(np.int64) * span + pos)
    count = first[term + 1] - first[term]
    ends = np.cumsum(count)
    a = 0
    while a < len(pos):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + PLACES)))
        c = count[a:b]
        posting = np.repeat(np.arange(a, b), c)
        run = anchored[np.arange(len(posting)) + np.repeat(first[term[a:b]] - (np.cumsum(c) - c), c)]
        near = window[posting]
        m = np.zeros(len(posting), dtype=np.int8)
        for j in range(n):
            t = own[run, j]
            m += (t >= 0) & ((near >> (t & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        posting, run = posting[m >= least], run[m >= least]
        m = np.zeros(len(posting), dtype=np.int64)
        for j in range(n):
            t = own[run, j].astype(np.int64)
            at = np.searchsorted(key, t * span + pos[posting] - n)
            at[at == len(key)] = 0
            m += (t >= 0) & (np.abs(key[at] - t * span - pos[posting]) <= n)
        yield posting[m >= least], run[m >= least], m[m >= least]
        a = b


def near_matches(docs: DataFrame, items: DataFrame, n: int = 8, least: int = 6) -> DataFrame:
    """(doc_id, item_id, matched): places where at least ``least`` of a run's ``n`` terms stand within one window of 2n words.

    The window lies around a place of one of the run's n - least + 1 rarest terms, of which a match cannot lack all;
    order and gaps are free. A block's runs are broadcast, and a document's postings are
    intersected in the task that reads it, so only matches are shuffled.
    """
    near = _over_blocks(docs, items, n, lambda d, runs, n: _block_near(d, runs, n, least), "doc_id bigint, item_id bigint, matched bigint")
    return near.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def _block_near(docs: DataFrame, runs: pd.DataFrame, n: int, least: int) -> DataFrame:
    vocabulary, anchor = _anchored(docs, runs, n - least + 1)
    loose = docs.sparkSession.sparkContext.broadcast(_loose_runs(vocabulary.value, runs, anchor, n))

    def matches(ids: list, hashes: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        item, own, first, anchored = loose.value
        terms = vocabulary.value
        size = np.array([len(h) for h in hashes])
        h = np.concatenate(hashes)
        pos = np.flatnonzero(_has(terms, h))
        number = np.repeat(np.arange(len(ids)), size)[pos]
        term = np.searchsorted(terms, h[pos])
        for posting, run, m in _loose_hits(term, pos + number * (n + 1), own, first, anchored, n, least):  # no window reaches into the next text
            if len(m):
                out = pd.DataFrame({"doc": number[posting], "item_id": item[run], "matched": m})
                out = out.groupby(["doc", "item_id"], as_index=False)["matched"].max()
                yield out.assign(doc_id=[ids[i] for i in out["doc"]])[["doc_id", "item_id", "matched"]]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids, hashes, total = [], [], 0
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                for words in variants(t):
                    ids.append(d)
                    hashes.append(word_hashes(words))
                    total += len(words)
                if total > BATCH_WORDS:
                    yield from matches(ids, hashes)
                    ids, hashes, total = [], [], 0
            if total:
                yield from matches(ids, hashes)

    return docs.mapInPandas(run, "doc_id bigint, item_id bigint, matched bigint")
