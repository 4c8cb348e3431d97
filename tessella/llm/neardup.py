"""Near-duplicate pages by covering locality-sensitive hashing.

A page is the set of its different three-word sequences. Each of ``groups`` independent sketches
holds 10 min-hash symbols of that set. The bit masks over the 10 positions are the non-zero
codewords of a linear [10, 3] code with minimum weight 5: two sketches that differ in at most 2
positions have, since 2 linear conditions on 3 bits always leave a non-zero solution, a codeword
that avoids all differing positions, so they agree on every position of that mask and share a
bucket. Every pair within that radius therefore collides, without chance. A mask keeps 5 positions or more, so
unlike pages hardly ever share a bucket. Pairs further apart than the radius in every group may
still collide in single masks. Colliding pairs are checked exactly.

A pair of similarity s is missed if no group brings it together: with 16 groups 0.7 % of pairs at s = 0.60, 0.2 % at
0.62, 0.06 % at 0.65 (simulated). Sketches are kept as one byte of each symbol: equal symbols stay equal, and
unequal ones that become equal only add candidates.

Equal sets are folded into one representative before bucketing, so a huge group of copies costs
one entry per bucket. ``similar_pairs`` writes all pairs of rows, as its result requires; ``representative_pairs`` has the
pairs between different texts and the membership; ``page_groups`` has one row per page and links a bucket's members
to one centre, so a template with very many slightly different pages costs one check a page and bucket, not one a pair.
Buckets are worked on in blocks of ``BLOCK`` members, so no task ever holds more of a hot one.

Pages of fewer than three words have an empty set and are similar to nothing. Null text likewise. Rows without an id are passed over; a row
that repeats an id with its text counts once in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import WORDS, mix, shingle_hashes, word_hashes
from tessella.session import cut_lineage, release, spread

# Fixed value: generator columns of a [10, 3] code with minimum weight 5, one 3-bit column per position.
COLUMNS = (1, 1, 2, 2, 3, 4, 4, 5, 6, 7)
BITS, WIDTH, RADIUS = 3, 10, 2
MASKS = 2**BITS - 1
GROUPS = 16
# Keys that a task of the bucket shuffle gets about, whatever number of shuffle partitions the session has set.
TASK_KEYS = 500_000
# Members of a bucket or copies of a text that meet in one block; layout only, every pair of blocks is worked on.
BLOCK = 512
# Ids of this many candidate pages are broadcast (8 bytes each) to fetch their texts; beyond it the join is shuffled.
BROADCAST_IDS = 4_000_000


def masks() -> np.ndarray:
    """(7, 10) boolean: position i belongs to mask v if the parity of v & COLUMNS[i] is odd."""
    return np.array([[bin(v & c).count("1") % 2 for c in COLUMNS] for v in range(1, MASKS + 1)], dtype=bool)


def page_shingles(text: str | None, n: int) -> np.ndarray:
    return shingle_hashes(word_hashes(WORDS.findall(text.lower())), n) if text else np.empty(0, dtype=np.uint64)


def sketch(sh: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One min-hash symbol (a byte) per seed; multiplication of already scrambled values by odd 32-bit seeds."""
    low = np.full(len(seeds), np.iinfo(np.uint32).max, dtype=np.uint32)
    sh = (sh >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(sh), 8192):
            low = np.minimum(low, (seeds[:, None] * sh[None, i : i + 8192]).min(axis=1))
    return (low >> np.uint32(8)).astype(np.uint8)


def seeds_for(groups: int) -> np.ndarray:
    return (mix(np.arange(1, groups * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def bucket_keys(sk: np.ndarray, groups: int) -> np.ndarray:
    """(rows, groups * MASKS) keys: for each group and mask a hash of the kept symbols."""
    m = masks()
    pos = mix(np.arange(1, groups * WIDTH + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        sym = mix((sk.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ pos[None, :])
        out = []
        for g in range(groups):
            part = sym[:, g * WIDTH : (g + 1) * WIDTH]
            for v in range(len(m)):
                out.append(mix(part[:, m[v]].sum(axis=1, dtype=np.uint64) + np.uint64(g * MASKS + v + 1)))
    return np.stack(out, axis=1).view(np.int64)


def _index(df: DataFrame, id_col: str, text: str, words: int, groups: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The source, membership rows (set_id, n, id), representatives (set_id, n, rep, copies, sk) and shared buckets (key, rep, centre, size)."""
    seeds = seeds_for(groups)

    def sketches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids, sets, sks, sizes = [], [], [], []
            for i, t in zip(pdf[id_col], pdf[text], strict=True):
                sh = page_shingles(t, words)
                if len(sh):
                    ids.append(i)
                    with np.errstate(over="ignore"):
                        sets.append(int(mix(sh).sum(dtype=np.uint64)) - (1 << 63))
                    sizes.append(len(sh))
                    sks.append(sketch(sh, seeds).tobytes())
            yield pd.DataFrame({"id": np.array(ids, dtype="int64"), "set_id": np.array(sets, dtype="int64"), "n": np.array(sizes, dtype="int32"), "sk": sks})

    def buckets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                sk = np.frombuffer(b"".join(pdf["sk"]), dtype=np.uint8).reshape(len(pdf), -1)
                keys = bucket_keys(sk, groups)
                yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(pdf["rep"].to_numpy(), keys.shape[1])})

    src = spread(df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text)).where(F.col(id_col).isNotNull()))
    rows = cut_lineage(src.mapInPandas(sketches, "id bigint, set_id bigint, n int, sk binary"))
    reps = rows.groupBy("set_id", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sk").alias("sk"))
    reps = cut_lineage(reps)
    # The keys are shuffled once: counting the buckets and dropping those of one page both read that shuffle.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() * groups * MASKS // TASK_KEYS))
    keyed = spread(reps.select("rep", "sk")).mapInPandas(buckets, "key bigint, rep bigint").repartition(tasks, "key")
    sizes = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut_lineage(keyed.join(sizes.hint("shuffle_hash"), "key").hint("rebalance"))  # a small part of the keys, so few files
    return src, rows.drop("sk"), reps, shared


def _blocked(left: DataFrame, right: DataFrame, key: str, most: int = BLOCK) -> DataFrame:
    """Rows of ``left`` (key, a, ...) and ``right`` (key, b, ...) that meet in a key; both hold the key's ``size``.

    A key of more than ``most`` rows is parted into blocks on both sides and every block meets every block, so the
    join's unit is a pair of blocks, however hot the key.
    """
    parts = F.greatest(F.ceil(F.col("size") / F.lit(float(most))), F.lit(1)).cast("int")
    own = lambda c: F.pmod(F.xxhash64(c), parts).cast("int")
    each = F.explode(F.sequence(F.lit(0), parts - 1))
    x = left.withColumn("_l", own("a")).withColumn("_r", each).drop("size")
    y = right.withColumn("_r", own("b")).withColumn("_l", each).drop("size")
    return x.join(y, [key, "_l", "_r"]).drop("_l", "_r")


def _bucket_pairs(shared: DataFrame) -> DataFrame:
    """Different pairs (a, b) with a < b that share a bucket."""
    left, right = (shared.select("key", F.col("rep").alias(c), "size") for c in "ab")
    return _blocked(left, right, "key").where("a < b").select("a", "b").distinct()


def _linked(src: DataFrame, reps: DataFrame, pairs: DataFrame, id_col: str, text: str, words: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs whose exact similarity reaches ``threshold``."""
    info = reps.select("rep", "n", "sk")
    near = pairs.join(info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sk").alias("ska")), "a")
    near = near.join(info.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("skb")), "b")
    near = near.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    near = cut_lineage(_sketch_filter(near, threshold).select("a", "b"))
    return _verified(src, id_col, text, near, words, threshold)


def representative_pairs(df: DataFrame, id_col: str = "page_id", text: str = "page_text", threshold: float = 0.6, words: int = 3, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of representatives whose exact similarity reaches ``threshold``, and the membership (rep, id, copies)."""
    src, rows, reps, shared = _index(df, id_col, text, words, groups)
    return _linked(src, reps, _bucket_pairs(shared), id_col, text, words, threshold), _membership(rows, reps)


def _membership(rows: DataFrame, reps: DataFrame) -> DataFrame:
    return rows.select("set_id", "n", "id").join(reps.select("set_id", "n", "rep", "copies"), ["set_id", "n"]).select("rep", "id", "copies")


def similar_pairs(df: DataFrame, id_col: str = "page_id", text: str = "page_text", threshold: float = 0.6, words: int = 3, groups: int = GROUPS) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of rows, copies included, whose exact similarity reaches ``threshold``."""
    found, member = representative_pairs(df, id_col, text, threshold, words, groups)
    return _expanded(found, member.where("copies > 1"))


def _sketch_filter(near: DataFrame, threshold: float, slack: float = 0.25) -> DataFrame:
    """Drop pairs whose share of equal symbols lies ``slack`` (six deviations) below the threshold."""

    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    return near.where(agree("ska", "skb") >= threshold - slack)


def _verified(src: DataFrame, id_col: str, text: str, near: DataFrame, words: int, threshold: float) -> DataFrame:
    """Exact similarity of the candidate pairs; texts are fetched only for pages in some candidate."""

    def exact(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            cache: dict = {}
            out = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                x, y = (cache[i] if i in cache else cache.setdefault(i, page_shingles(t, words)) for i, t in ((a, ta), (b, tb)))
                both = len(np.intersect1d(x, y, assume_unique=True))
                s = both / (len(x) + len(y) - both)
                if s >= threshold:
                    out.append((a, b, s))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    ids = near.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    if near.count() * 2 <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # so only the texts of candidates are shuffled
    texts = src.join(ids, id_col, "left_semi")
    pairs = near.join(texts.select(F.col(id_col).alias("a"), F.col(text).alias("ta")), "a")
    pairs = pairs.join(texts.select(F.col(id_col).alias("b"), F.col(text).alias("tb")), "b")
    return pairs.select("a", "b", "ta", "tb").mapInPandas(exact, "a bigint, b bigint, similarity double")


def _expanded(found: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of rows from pairs of representatives, and the pairs among copies of one set (``member``: rep, id, copies)."""
    ma, mb = (member.select(F.col("rep").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
    pairs = found.join(ma, "a", "left").join(mb, "b", "left")
    pairs = pairs.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"), "similarity")
    left, right = (member.select("rep", F.col("id").alias(c), F.col("copies").alias("size")) for c in "ab")
    same = _blocked(left, right, "rep").where("a < b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("similarity"))
    every = pairs.unionByName(same)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def components(edges: DataFrame) -> DataFrame:
    """(u, g): for every node of the edges (a, b) the least node it is connected with.

    Labels spread along edges and along the labels themselves until nothing changes, however long the chains. Each
    round is a written table, the one before is deleted; the driver sees one number a round.
    """
    links = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    label = cut_lineage(links.groupBy("u").agg(F.least("u", F.min("v")).alias("g")))
    while True:
        best = links.join(label.select(F.col("u").alias("v"), F.col("g").alias("h")), "v").groupBy("u").agg(F.min("h").alias("h"))
        step = label.join(best, "u", "left").select("u", F.col("g").alias("old"), F.least("g", "h").alias("g"))
        up = label.select(F.col("u").alias("g"), F.col("g").alias("root"))
        step = cut_lineage(step.join(up, "g", "left").select("u", F.least("g", "root").alias("g"), "old"))
        changed = not step.where("g <> old").isEmpty()
        release(label)
        label = step
        if not changed:
            release(links)
            return label.select("u", "g")


def page_groups(df: DataFrame, id_col: str = "page_id", text: str = "page_text", threshold: float = 0.6, words: int = 3, groups: int = GROUPS) -> DataFrame:
    """(id, group_id, copies): every row with the least id it is connected with by similarity; ``copies`` counts the rows of its very text.

    Each bucket's members are first checked against its centre only. Members of a bucket that are then still in different
    groups are checked with one another, so no link between groups is lost, while pages of one group are never paired.
    A row without partner, without text or of fewer than ``words`` words is a group of its own.
    """
    src, rows, reps, shared = _index(df, id_col, text, words, groups)
    star = cut_lineage(shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    first = cut_lineage(_linked(src, reps, star, id_col, text, words, threshold).select("a", "b"))
    label = components(first)
    tagged = shared.join(label.withColumnRenamed("u", "rep"), "rep", "left").withColumn("g", F.coalesce("g", "rep"))
    ends = tagged.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.max(F.when(F.col("rep") == F.col("centre"), F.col("g"))).alias("gc")).where("lo < hi")
    mixed = cut_lineage(tagged.join(ends.select("key", "gc"), "key").select("key", "rep", "g", "gc", "size"))
    out = mixed.where("g <> gc").select("key", F.col("rep").alias("a"), F.col("g").alias("ga"), "size")
    every = mixed.select("key", F.col("rep").alias("b"), F.col("g").alias("gb"), "size")
    rest = _blocked(out, every, "key").where("ga <> gb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = _linked(src, reps, rest.join(star, ["a", "b"], "left_anti"), id_col, text, words, threshold).select("a", "b")
    label = components(first.unionByName(second))
    member = _membership(rows, reps).join(label.withColumnRenamed("u", "rep"), "rep", "left").select("id", F.coalesce("g", "rep").alias("group_id"), "copies")
    every = src.select(F.col(id_col).alias("id")).join(member, "id", "left")
    return every.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
