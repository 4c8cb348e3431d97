"""Text repeated across the pages of one site, found by content-defined chunking.

Text is cut where a rolling hash over its last 8 characters hits a fixed pattern, so the same passage gives the same chunks
wherever it stands. Per site the different pages of each chunk are counted (added up before the shuffle, so a hot
site or chunk never gathers in one task); a chunk that stands on too many of the site's pages is repeated.

* ``repeated_lines`` answers by line: line ends cut as well, so a line has chunks of its own. A line that is repeated excessively
  has only excessively repeated chunks; lines whose longest chunk is not among those are dropped, the rest are counted
  exactly by (site, line key).
* ``repeated_passages`` chunks across line ends: white space of any kind is one space, digits are 0, case is dropped.
* ``without_repeats`` takes both out of each page: whole repeated lines, and runs of repeated chunks of ``MIN_CUT`` characters
  or more that stand on half of the site's pages, wherever in a line they begin; shorter or rarer runs are phrases and stay.

Defined results: a null text or address adds nothing to the counts of lines, but a page with
an address and null text counts as a row of its site; blank lines have no key; repeated lines
of a page count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokens import site_of
from tessella.llm.words import mix
from tessella.session import cut_lineage, spread

WINDOW = 8
# One cut in 32 characters within lines, in 16 across them, where a chunk's edges are all that a cut leaves.
CUT_MASK, PASSAGE_MASK = 0x1F, 0x0F
MIN_ROWS, MIN_SHARE = 5, 0.1
MIN_CUT = 80
# A passage within lines must stand on so large a share of the site's pages: at a tenth, stock phrases of the sentences would go too.
PASSAGE_SHARE = 0.5
# Up to so many repeated chunks or keys (8 bytes each) are broadcast; beyond it the joins are shuffled, with the same result.
BROADCAST_ROWS = 1_000_000
# Pages of a site that meet its keys in one task of the shuffled join.
SALT_ROWS = 20_000
_DIGITS = re.compile(r"\d+")
_B = 0x100000001B3
_slice = 500


def line_key(line: str) -> str:
    """White space collapsed and trimmed, runs of digits as 0, lower case."""
    return _DIGITS.sub("0", " ".join(line.split())).lower()


def line_key_col(line: Column) -> Column:
    white = r"[\s\x1c-\x1f\x85]+"
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, rf"(?U){white}", " "), r"\A | \z", ""), r"\p{Nd}+", "0"))


def _chunks(chars: np.ndarray, part: np.ndarray, mask: int = CUT_MASK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, hash, length) of the chunks of ``chars``; ``part`` numbers the texts, which are chunked apart."""
    n = len(chars)
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if n else np.empty(0, np.int64)
    within = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    scrambled = mix(chars.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        rolling = np.zeros(n, dtype=np.uint64)
        for k in range(min(WINDOW, n)):
            term = scrambled[: n - k] * np.uint64(pow(_B, k, 1 << 64))
            rolling[k:] += np.where(within[k:] >= k, term, np.uint64(0))
        cut = (mix(rolling) & np.uint64(mask)) == 0
        first = within == 0
        first[1:] |= cut[:-1]
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, n))
        local = np.arange(n) - np.repeat(at, length)
        power = np.ones(int(length.max(initial=1)), dtype=np.uint64)
        for k in range(1, len(power)):
            power[k] = power[k - 1] * np.uint64(_B)
        hashed = mix(np.add.reduceat(scrambled * power[local], at) + length.astype(np.uint64)) if len(at) else np.empty(0, np.uint64)
    return at, hashed, length


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the number of the text of each."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return chars, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))


def chunk_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line index, chunk hash, chunk length) of all chunks of the given non-empty lines."""
    chars, line = _chars(lines)
    at, hashed, length = _chunks(chars, line)
    return line[at], hashed, length


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """White space and digits by code point."""
    every = [chr(i) for i in range(0x110000)]
    return np.array([c.isspace() for c in every]), np.array([c.isdecimal() for c in every])


def chunk_pages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, begin, end, length) of the chunks of whole texts, across line ends; begin and end are places in the text."""
    chars, page = _chars([t.replace("İ", "i").lower() for t in texts])  # the only letter whose lower case is longer
    white, digit = (k[chars] for k in _kinds())
    kept = np.ones(len(chars), dtype=bool)
    kept[1:] = ~((page[1:] == page[:-1]) & (white[1:] & white[:-1] | digit[1:] & digit[:-1]))
    at = np.flatnonzero(kept)
    plain = np.where(white, np.uint32(32), np.where(digit, np.uint32(48), chars))[at]
    first, hashed, length = _chunks(plain, page[at], PASSAGE_MASK)
    size = np.bincount(page, minlength=len(texts))
    start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(texts) else size
    begin = at[first] if len(first) else np.empty(0, np.int64)
    end = np.append(begin[1:], len(chars)) if len(begin) else begin
    of = page[begin]
    return of, hashed, begin - start[of], end - start[of], length


def page_lines(text: str | None) -> list[str]:
    """Different non-empty line keys of a page, in order of first appearance."""
    return [k for k in dict.fromkeys(map(line_key, text.split("\n"))) if k] if text else []


def _batches(it: Iterator[pd.DataFrame]):
    """(site hashes, page number of each line, lines, chunk arrays), some hundred pages at a time."""
    for pdf in it:
        for lo in range(0, len(pdf), _slice):
            part = pdf.iloc[lo : lo + _slice]
            per_page = [page_lines(t) for t in part["page_text"]]
            lines = list(dict.fromkeys(k for p in per_page for k in p))
            if lines:
                number = {k: i for i, k in enumerate(lines)}
                page = np.repeat(np.arange(len(part)), [len(p) for p in per_page])
                ids = np.fromiter((number[k] for p in per_page for k in p), dtype=np.int64, count=len(page))
                yield part, lines, page, ids, chunk_lines(lines)


def _chunk_counts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of the batch per (site, chunk)."""
    for part, lines, page, ids, (of, hashed, _) in _batches(it):
        first = np.searchsorted(of, np.arange(len(lines)))
        many = np.searchsorted(of, np.arange(len(lines)), side="right") - first
        reps = many[ids]
        at = np.repeat(first[ids] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        site = part["site_h"].to_numpy()[page].repeat(reps)
        rows = pd.DataFrame({"p": page.repeat(reps), "site_h": site, "chunk": hashed[at].view(np.int64)}).drop_duplicates()
        yield rows.groupby(["site_h", "chunk"], sort=False).size().reset_index(name="n")


def _anchored_lines(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of the batch per (site, line key), with the line's longest chunk."""
    for part, lines, page, ids, (of, hashed, length) in _batches(it):
        order = np.lexsort((-length, of))
        anchor = hashed[order][np.searchsorted(of[order], np.arange(len(lines)))].view(np.int64)
        rows = pd.DataFrame({"i": page, "id": ids, "site_h": part["site_h"].to_numpy()[page], "site": part["site"].to_numpy()[page]})
        rows = rows.groupby(["site_h", "site", "id"], sort=False).size().reset_index(name="n")
        yield pd.DataFrame({"site_h": rows["site_h"], "site": rows["site"], "chunk": anchor[rows["id"]], "line_key": [lines[i] for i in rows["id"]], "n": rows["n"]})


def _passage_counts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of the batch per (site, chunk across lines)."""
    for pdf in it:
        for lo in range(0, len(pdf), _slice):
            part = pdf.iloc[lo : lo + _slice]
            of, hashed, *_ = chunk_pages([t or "" for t in part["page_text"]])
            rows = pd.DataFrame({"p": of, "site_h": part["site_h"].to_numpy()[of], "chunk": hashed.view(np.int64)}).drop_duplicates()
            yield rows.groupby(["site_h", "chunk"], sort=False).size().reset_index(name="n")


def repeated_chunks(pages: DataFrame, rows_per_site: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, count=_chunk_counts) -> DataFrame:
    """(site_h, chunk, n) of the chunks that stand on too many pages of their site."""
    counts = pages.select("site_h", "page_text").mapInPandas(count, "site_h bigint, chunk bigint, n bigint")
    counts = counts.groupBy("site_h", "chunk").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)
    return counts.join(rows_per_site.select("site_h", "site_rows"), "site_h").where(F.col("n") >= F.col("site_rows") * min_share).select("site_h", "chunk", "n")


def _sited(pages: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(site, site_h, page_text and more columns) of pages with an address, and (site_h, site, site_rows)."""
    sited = pages.select(site_of(F.col("page_url")).alias("site"), "page_text", *more).where("site is not null")
    sited = spread(sited.withColumn("site_h", F.xxhash64("site")))
    return sited, cut_lineage(sited.groupBy("site_h", "site").agg(F.count(F.lit(1)).alias("site_rows")))


def repeated_lines(pages: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, line_key, n_pages, site_rows) of the lines repeated excessively within a site."""
    sited, rows = _sited(pages)
    chunks = cut_lineage(repeated_chunks(sited, rows, min_rows, min_share).select("site_h", "chunk"))
    if chunks.count() <= BROADCAST_ROWS:
        chunks = F.broadcast(chunks)
    lines = sited.mapInPandas(_anchored_lines, "site_h bigint, site string, chunk bigint, line_key string, n bigint")
    lines = lines.join(chunks, ["site_h", "chunk"], "left_semi").groupBy("site", "line_key").agg(F.sum("n").alias("n_pages"))
    found = lines.join(rows.select("site", "site_rows"), "site")
    return found.where((F.col("n_pages") >= min_rows) & (F.col("n_pages") >= F.col("site_rows") * min_share))


def repeated_passages(pages: DataFrame, min_rows: int = MIN_ROWS, min_share: float = PASSAGE_SHARE) -> DataFrame:
    """(site_h, chunk) of the chunks across line ends that are repeated excessively within a site."""
    sited, rows = _sited(pages)
    return repeated_chunks(sited, rows, min_rows, min_share, _passage_counts).select("site_h", "chunk")


def _key_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def _joint(site: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a site and a chunk or line key."""
    with np.errstate(over="ignore"):
        return mix(mix(site) * np.uint64(_B) + key.view(np.uint64)).view(np.int64)


def _repeat_keys(lines: DataFrame, passages: DataFrame) -> DataFrame:
    """(site_h, key): both kinds of repeats as numbers; line keys are hashed apart from chunks."""

    @F.pandas_udf("bigint")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series([_key_hash(k) for k in keys], dtype="int64")

    of_lines = lines.select(F.xxhash64("site").alias("site_h"), hashed("line_key").alias("key"))
    return of_lines.unionByName(passages.select("site_h", F.col("chunk").alias("key"))).distinct()


def cut_pages(texts: list[str | None], hit) -> list[tuple[str | None, int, int]]:
    """(kept text, removed lines, removed characters) of each text; ``hit(text numbers, keys)`` tells which keys are repeats there."""
    plain = [t or "" for t in texts]
    lines = [t.split("\n") for t in plain]
    keys = {x: line_key(x) for p in lines for x in p}
    number = {x: _key_hash(k) if k else 0 for x, k in keys.items()}
    of = np.repeat(np.arange(len(texts)), [len(p) for p in lines])
    drop = hit(of, np.fromiter((number[x] for p in lines for x in p), dtype=np.int64, count=len(of))) & np.fromiter((keys[x] != "" for p in lines for x in p), dtype=bool, count=len(of))
    drop = np.split(drop, np.cumsum([len(p) for p in lines])[:-1])
    page, hashed, begin, end, length = chunk_pages(plain)
    again = hit(page, hashed.view(np.int64))
    cuts: dict[int, list[tuple[int, int]]] = {}
    i = 0
    for i, j in _runs(page, again):
        if length[i:j].sum() >= MIN_CUT:
            cuts.setdefault(int(page[i]), []).append((int(begin[i]), int(end[j - 1])))
    out = []
    for k, t in enumerate(texts):
        if t is None or not drop[k].any() and k not in cuts:
            out.append((t, 0, 0))
            continue
        kept, at, gone = [], 0, 0
        for x, d in zip(lines[k], drop[k], strict=True):
            rest = x
            for a, b in reversed(cuts.get(k, ())):
                a, b = max(a - at, 0), min(b - at, len(x))
                if a < b:
                    rest = rest[:a] + rest[b:]
            at += len(x) + 1
            if d or rest != x and not rest.strip():
                gone += 1
            else:
                kept.append(rest if rest == x else rest.strip())
        text = "\n".join(kept)
        out.append((text, gone, len(t) - len(text)))
    return out


def _runs(page: np.ndarray, again: np.ndarray) -> list[tuple[int, int]]:
    """(first, beyond) of the stretches of repeated chunks within a page."""
    if not len(page):
        return []
    edge = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (again[1:] != again[:-1])))
    return [(a, b) for a, b in zip(edge, np.append(edge[1:], len(page)), strict=True) if again[a]]


def without_repeats(pages: DataFrame, lines: DataFrame, passages: DataFrame) -> DataFrame:
    """(page_id, kept_text, removed_lines, removed_chars): each page without its site's repeated lines and passages.

    Pages without address are kept whole, pages without an id are passed over; null text stays null. Where the repeats are too many for a broadcast, pages meet the keys of their
    site in salted groups of ``SALT_ROWS``, so a hot site is no hot task; a site has at most 1 / ``MIN_SHARE`` times as many keys as a page.
    """
    schema = "page_id bigint, kept_text string, removed_lines int, removed_chars int"
    keys = cut_lineage(_repeat_keys(lines, passages))
    src = pages.where("page_id is not null").select("page_id", "page_text", F.xxhash64(F.coalesce(site_of(F.col("page_url")), F.lit(""))).alias("site_h"))

    def frame(part: pd.DataFrame, hit) -> pd.DataFrame:
        rows = cut_pages(part["page_text"].tolist(), hit)
        return pd.DataFrame({"page_id": part["page_id"], "kept_text": [r[0] for r in rows], "removed_lines": [r[1] for r in rows], "removed_chars": [r[2] for r in rows]})

    if keys.count() <= BROADCAST_ROWS:
        found = keys.toPandas()
        shared = pages.sparkSession.sparkContext.broadcast(np.unique(_joint(found["site_h"].to_numpy(np.int64), found["key"].to_numpy(np.int64))))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for pdf in it:
                for lo in range(0, len(pdf), _slice):
                    part = pdf.iloc[lo : lo + _slice]
                    site = part["site_h"].to_numpy(np.int64)

                    def hit(of: np.ndarray, key: np.ndarray, site=site) -> np.ndarray:
                        return _among(known, _joint(site[of], key))

                    yield frame(part, hit)

        return spread(src).mapInPandas(run, schema)

    salts = src.groupBy("site_h").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SALT_ROWS))).cast("int").alias("salts"))
    left = src.join(salts, "site_h").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.col("salts")).cast("int")).drop("salts")
    right = keys.join(salts, "site_h").select("site_h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key")

    def meet(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        known = np.unique(own["key"].to_numpy(np.int64))
        return pd.concat([frame(part.iloc[lo : lo + _slice], lambda of, key: _among(known, key)) for lo in range(0, max(len(part), 1), _slice)])

    return left.groupBy("site_h", "salt").cogroup(right.groupBy("site_h", "salt")).applyInPandas(meet, schema)


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x
