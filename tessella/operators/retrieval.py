"""Top-k search, exact and by an index, reranking, evaluation metrics and prompt context.

``top_k`` is exact: it scores all rows against blocks of the query set inside the scan (one matrix product per Arrow batch) and
keeps the best k of each batch, so the shuffle carries k rows per query and task, not the cross product. Query blocks have
``BLOCK`` rows; that bounds each broadcast however many queries there are. ``indexed_top_k`` parts all rows into cells around centres that are
fitted on a bounded sample, and looks into the nearest cells of each query only, so its work grows with the rows times the share of
cells looked into. Ties go to the lower id. Null or empty vectors and vectors of another length are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import chop, py_strip, tokenize
from tessella.functions.vectors import cosine
from tessella.session import cut_lineage, spread

BLOCK = 4_096
FETCH_K, TOP_K = 20, 5
# The index: rows its centres are fitted on, rows a cell has about, share of the cells looked into (and least number of them).
INDEX_SAMPLE, CELL_ROWS, PROBED, LEAST_PROBES = 20_000, 1_000, 0.1, 4
MOST_CELLS, ROUNDS, SALT_ROWS = 4_096, 8, 20_000


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, ``BLOCK`` at a time."""
    rows, width = [], None
    for r in queries.select(key, vector).where(F.size(vector) > 0).toLocalIterator():
        width = width or len(r[1])
        if len(r[1]) == width:
            rows.append(r)
        if len(rows) == BLOCK:
            yield np.array([x[0] for x in rows]), np.array([x[1] for x in rows], dtype=np.float64)
            rows = []
    if rows:
        yield np.array([x[0] for x in rows]), np.array([x[1] for x in rows], dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows): cosine (of unit rows) and dot are one product; l2 is the negative squared distance."""
    if metric != "l2":
        return q @ m.T
    return 2 * q @ m.T - (q * q).sum(axis=1)[:, None] - (m * m).sum(axis=1)[None, :]


def _best(qid: np.ndarray, q: np.ndarray, own: np.ndarray, m: np.ndarray, k: int, metric: str, skip_self: bool) -> pd.DataFrame:
    """The best k rows of each query among ``m``: those within rounding of the k-th score are picked out, scored exactly and ordered."""
    s = _scores(q, m, metric)
    if skip_self:
        s[qid[:, None] == own[None, :]] = -np.inf
    keep = min(k, s.shape[1])
    least = np.partition(s, -keep, axis=1)[:, -keep]
    i, j = np.nonzero(s >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None])
    score = s[i, j]
    if metric == "l2":
        score = np.where(np.isfinite(score), -((q[i] - m[j]) ** 2).sum(axis=1), score)
    order = np.lexsort((own[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    ok = (place < keep) & np.isfinite(score)
    return pd.DataFrame({"query_id": qid[i[ok]], "id": own[j[ok]], "score": score[ok]})


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return _unit(m) if metric == "cosine" else m


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("id", key)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): best ``k`` rows per query; score is cosine, dot or negative squared distance."""
    spark, found = vectors.sparkSession, None
    src = spread(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.size("v") > 0))
    for ids, block in _blocks(queries, key, vector):
        shared = spark.sparkContext.broadcast((ids, _unit(block) if metric == "cosine" else block))

        def run(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            for pdf in it:
                pdf = pdf[pdf["v"].map(len) == q.shape[1]]
                for lo in range(0, len(pdf), 2_048):
                    part = pdf.iloc[lo : lo + 2_048]
                    yield _best(qid, q, part["id"].to_numpy(), _matrix(part["v"], metric), k, metric, skip_self)

        part = src.mapInPandas(run, "query_id bigint, id bigint, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id bigint, `{key}` bigint, score double, rank int")
    return _ranked(found, k, key)


def centres(vectors: DataFrame, metric: str = "cosine", vector: str = "embedding", sample: int = INDEX_SAMPLE, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Centres of the cells by k-means on about ``sample`` rows drawn by hash; one cell a ``cell_rows`` rows of the whole table, ``MOST_CELLS`` at most."""
    rows = vectors.select(F.col(vector).alias("v")).where(F.size("v") > 0)
    n = rows.count()
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    v = sorted((r["v"] for r in drawn.collect()), key=tuple)
    v = [x for x in v if len(x) == len(v[0])]
    if not v:
        return np.empty((0, 0))
    m = np.array(v, dtype=np.float64)
    m = _unit(m) if metric == "cosine" else m
    c = m[np.random.default_rng(3).permutation(len(m))[: max(1, min(MOST_CELLS, n // cell_rows, len(m) // 4))]]
    for _ in range(ROUNDS):
        at = _scores(c, m, "l2").argmax(axis=0)
        size = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, m)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def celled(vectors: DataFrame, cells: np.ndarray, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", probes: int = 1) -> DataFrame:
    """(id, v, cell): every row in its ``probes`` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in it:
            pdf = pdf[pdf["v"].map(len) == c.shape[1]]
            for lo in range(0, len(pdf), 2_048):
                part = pdf.iloc[lo : lo + 2_048]
                s = _scores(_matrix(part["v"], metric), c, "l2")
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), near.shape[1]), "v": part["v"].repeat(near.shape[1]).to_numpy(), "cell": near.ravel().astype("int32")})

    src = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    return spread(src).mapInPandas(run, "id bigint, v array<double>, cell int")


def indexed_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", skip_self: bool = True, probed: float = PROBED) -> DataFrame:
    """As ``top_k``, by the cells nearest to each query; what it finds is scored exactly, what lies in other cells is missed.

    Every row is indexed. Rows of a cell meet its queries in parts of ``SALT_ROWS`` rows, so a crowded cell is no crowded task.
    """
    cells = centres(vectors, metric, vector)
    if not len(cells):
        return vectors.sparkSession.createDataFrame([], f"query_id bigint, `{key}` bigint, score double, rank int")
    probes = min(len(cells), max(LEAST_PROBES, round(len(cells) * probed)))
    rows = cut_lineage(celled(vectors, cells, metric, key, vector))
    salts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SALT_ROWS))).cast("int").alias("salts"))
    left = rows.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")  # a row a cell
    asked = celled(queries, cells, metric, key, vector, probes).join(F.broadcast(salts), "cell")
    right = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def meet(part: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})]
        if len(part) and len(q):
            m, own = _matrix(part["v"], metric), part["id"].to_numpy()
            for lo in range(0, len(q), 256):
                b = q.iloc[lo : lo + 256]
                out.append(_best(b["id"].to_numpy(), _matrix(b["v"], metric), own, m, k, metric, skip_self))
        return pd.concat(out)

    found = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(meet, "query_id bigint, id bigint, score double")
    return _ranked(found, k, key)


def rerank(hits: DataFrame, vectors: DataFrame, k: int = TOP_K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first hits ordered anew by the product of unit vectors; equal scores keep their order."""
    v = vectors.select(F.col(key), F.col(vector).alias("v"))
    q = vectors.select(F.col(key).alias("query_id"), F.col(vector).alias("qv"))
    scored = hits.join(v, key).join(q, "query_id").select("query_id", key, "rank", cosine(F.col("v"), F.col("qv"), clamp=False).alias("rerank_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).select("query_id", key, "rerank_score", "new_rank")


def unique_hits(hits: DataFrame, signature: tuple[str, ...]) -> DataFrame:
    """First hit per query and signature, by rank; null parts count as the text 'None'."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in signature]
    w = Window.partitionBy("query_id", *parts).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair_reranked(hits: DataFrame, score: Callable[[str, list[str]], list[float]] | None, k: int = TOP_K) -> DataFrame:
    """(query_id, doc_id, score, new_rank): hits (query_id, question, doc_id, text, rank) ordered anew by a pair scorer that the caller gives.

    ``score`` gets a question and its texts. Equal scores keep their order. Without a scorer, or where it fails, a question keeps its first ``k`` hits.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank", kind="stable")
        try:
            got = np.array(score(part["question"].iloc[0] or "", [t or "" for t in part["text"]]), dtype=float)
            part = part.assign(score=got).iloc[np.argsort(-got, kind="stable")]
        except Exception:  # no scorer, or one that fails: the order stays
            part = part.assign(score=np.nan)
        part = part.head(k)
        return part.assign(new_rank=np.arange(1, len(part) + 1, dtype="int32"))[["query_id", "doc_id", "score", "new_rank"]]

    return hits.select("query_id", "question", "doc_id", "text", "rank").groupBy("query_id").applyInPandas(run, "query_id bigint, doc_id bigint, score double, new_rank int")


def answer_rows(answers: DataFrame, docs: DataFrame, sample: int = 3) -> DataFrame:
    """Rows of an answer evaluation: question, answer, answer_ref, ref_sim, refs_sim, refs_count, docs_sample.

    ``answers``: query_id, question, answer, answer_ref, answer_vec, ref_vec, refs_vec (array of vectors); ``docs``: query_id, rank, text.
    Similarities are cosines; without a vector on either side they are null.
    """
    first = docs.where(F.col("rank") <= sample).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("docs_sample"))
    sims = F.transform(F.filter("refs_vec", lambda v: v.isNotNull()), lambda v: cosine(F.col("answer_vec"), v, clamp=False))
    rows = answers.join(first, "query_id", "left")
    return rows.select(
        "query_id", "question", "answer", "answer_ref", F.when(F.col("answer_vec").isNotNull() & F.col("ref_vec").isNotNull(), cosine(F.col("answer_vec"), F.col("ref_vec"), clamp=False)).alias("ref_sim"),
        F.when(F.col("answer_vec").isNotNull(), F.array_max(sims)).alias("refs_sim"), F.coalesce(F.size("refs_vec"), F.lit(0)).alias("refs_count"), F.coalesce("docs_sample", F.array().cast("array<string>")).alias("docs_sample"),
    )


def similarity_means(rows: DataFrame) -> DataFrame:
    """One row: answers, counts and means of ref_sim and refs_sim over what is not null, median and sample deviation of ref_sim."""
    r = lambda c: F.round(c, 6)
    return rows.agg(
        F.count(F.lit(1)).alias("answers"), F.count("ref_sim").alias("n_ref"), r(F.avg("ref_sim")).alias("avg_ref_sim"), r(F.avg("refs_sim")).alias("avg_refs_sim"),
        r(F.median("ref_sim")).alias("median_ref_sim"), r(F.stddev_samp("ref_sim")).alias("std_ref_sim"),
    )


def overlap_score(answer: Column, reference: Column) -> Column:
    """1 where one text holds the other, else the share of the answer's words that the reference has; 0 for an empty reference."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    a, r = F.coalesce(F.lower(answer), F.lit("")), F.lower(F.coalesce(reference, F.lit("")))
    part = F.size(F.array_intersect(F.array_distinct(words(a)), F.array_distinct(words(r)))) / F.greatest(F.size(words(a)), F.lit(1))
    return F.when(r == "", 0.0).when(F.contains(r, a) | F.contains(a, r), 1.0).otherwise(part)


def _question_blocks(questions: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Ids, numbers of different tokens, and for each token the questions that hold it; ``BLOCK`` questions at a time."""

    def block(rows):
        where: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for t in r["t"] or []:
                where.setdefault(t, []).append(i)
        return np.array([r["query_id"] for r in rows]), np.array([max(1, len(r["t"] or [])) for r in rows], dtype=float), {t: np.array(v) for t, v in where.items()}

    rows = []
    for r in questions.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("t")).toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            yield block(rows)
            rows = []
    if rows:
        yield block(rows)


def overlap_top_k(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): documents by the share of a question's different tokens that they hold.

    Questions (query_id, text) are broadcast in blocks of ``BLOCK``, each against all documents.
    """
    tokens = spread(docs.select("doc_id", "text")).select("doc_id", F.array_distinct(tokenize(F.col("text"))).alias("t")).where("t is not null")
    found = docs.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    for block in _question_blocks(questions):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, n, index = shared.value
            none = np.empty(0, dtype=np.int64)
            for pdf in it:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    per = [np.concatenate([none, *(index[t] for t in tokens if t in index)]) for tokens in part["t"]]
                    doc = np.repeat(np.arange(len(part)), [len(x) for x in per])
                    hit = np.bincount(np.concatenate(per) * len(part) + doc, minlength=len(qid) * len(part)).reshape(len(qid), len(part))
                    out = _top(hit / n[:, None], part["doc_id"].to_numpy(), k)
                    yield pd.DataFrame({"query_id": qid[out[0]], "doc_id": out[1], "score": out[2]})

        found = found.unionByName(tokens.mapInPandas(run, "query_id bigint, doc_id bigint, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _top(s: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the best k positive entries of each row, ties to the lower id."""
    keep = min(k, s.shape[1])
    least = np.partition(s, -keep, axis=1)[:, -keep]
    i, j = np.nonzero((s >= least[:, None]) & (s > 0))
    order = np.lexsort((own[j], -s[i, j], i))
    i, j = i[order], j[order]
    ok = np.arange(len(i)) - np.searchsorted(i, i) < keep
    return i[ok], own[j[ok]], s[i[ok], j[ok]]


def containment_matches(hits: DataFrame, docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(query_id, ref_no, rank) where document and reference contain one another, case aside; an empty document matches all.

    Only fetched documents are compared, each with the references of its own question.
    """
    text = hits.join(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("d")), "doc_id")
    both = text.join(refs.select("query_id", "ref_no", F.lower("ref").alias("r")), "query_id")
    return both.where(F.contains("r", "d") | F.contains("d", "r")).select("query_id", "ref_no", "rank")


def evaluation(queries: DataFrame, matches: DataFrame, ks: tuple[int, ...] = (5, 10), dcg_k: int = 3) -> DataFrame:
    """One row of means over ``queries`` (query_id, n_refs).

    Recall: matched references in the first k / references. Precision: matching documents in the first k / k, even where fewer came.
    MRR: over all fetched. nDCG: binary gain per document, ideal min(references, k), so it can pass 1. Nothing gives 0.
    """
    docs = matches.select("query_id", "rank").distinct()
    aggs = [F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), F.sum(F.when(F.col("rank") <= dcg_k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg")]
    aggs += [(F.count_if(F.col("rank") <= k) / F.lit(float(k))).alias(f"precision_{k}") for k in ks]
    per = docs.groupBy("query_id").agg(*aggs)
    ref = matches.groupBy("query_id").agg(*[F.count_distinct(F.when(F.col("rank") <= k, F.col("ref_no"))).alias(f"hit_{k}") for k in ks])
    row = queries.join(per, "query_id", "left").join(ref, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_refs", F.lit(dcg_k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    ndcg = F.when(F.col("n_refs") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return row.agg(
        F.count(F.lit(1)).alias("questions"),
        *[mean(F.coalesce(F.col(f"hit_{k}") / F.greatest(F.col("n_refs"), F.lit(1)), F.lit(0.0))).alias(f"recall_{k}") for k in ks],
        *[mean(F.coalesce(f"precision_{k}", F.lit(0.0))).alias(f"precision_{k}") for k in ks],
        mean(F.coalesce("mrr", F.lit(0.0))).alias("mrr"),
        mean(ndcg).alias(f"ndcg_{dcg_k}"),
    )


def context(hits: DataFrame, docs: DataFrame, label: str, text: str = "text", limit: int = 1200) -> DataFrame:
    """(query_id, context): lines '[label] text' in rank order, parted by blank lines."""
    row = hits.join(docs.select("doc_id", F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("name"), F.col(text).alias("body")), "doc_id")
    line = F.concat(F.lit("["), F.col("name"), F.lit("] "), chop(py_strip(F.coalesce("body", F.lit(""))), limit))
    lines = row.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return lines.select("query_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("context"))
