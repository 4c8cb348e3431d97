import datetime as dt
import math

from pyspark.sql import functions as F

from tessella.functions import vectors
from tessella.operators import cache, retrieval


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_top_k_against_brute_force_with_ties_and_bad_rows(spark):
    v = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(50, None), (51, []), (52, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = retrieval.top_k(df, df.where("vec_id in (0, 1)"), 4).orderBy("query_id", "rank").collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    for q in (0, 1):
        want = sorted(((-round(cos(v[q][1], x), 9), i) for i, x in v[:12] if i != q))[:4]
        assert [(r.vec_id) for r in got if r.query_id == q] == [i for _, i in want]
    assert retrieval.top_k(df, df.limit(0), 4).count() == 0
    assert retrieval.top_k(df.limit(0), df.where("vec_id = 1"), 4).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, retrieval.top_k(df, df, 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    assert sorted(map(tuple, retrieval.top_k(df, df, 3).collect())) == whole


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([(1, 1), (2, 2), (3, 0), (4, 1)], "query_id long, n_refs int")
    # two documents match the one reference of query 1: nDCG passes 1
    m = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (2, 1, 4)], "query_id long, ref_no int, rank int")
    r = retrieval.evaluation(q, m).first()
    assert r.questions == 4
    assert r.recall_5 == round((1 + 0.5) / 4, 6) and r.precision_5 == round((2 / 5 + 1 / 5) / 4, 6)
    assert r.mrr == round((1 + 1 / 4) / 4, 6)
    assert r.ndcg_3 == round((1 + 1 / math.log2(3)) / 4, 6)
    assert retrieval.evaluation(q.limit(0), m).first().mrr == 0.0


def test_empty_document_matches_every_reference(spark, as_rows):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(7, None), (8, "abc DEF")], "doc_id long, text string")
    refs = spark.createDataFrame([(1, 0, "c d"), (1, 1, "zzz")], "query_id long, ref_no int, ref string")
    assert as_rows(retrieval.containment_matches(hits, docs, refs)) == [(1, 0, 1), (1, 0, 2), (1, 1, 1)]


def test_overlap_ranking_and_context(spark, as_rows):
    docs = spark.createDataFrame([(1, "alpha beta", "s"), (2, "beta beta gamma", None), (3, None, "t"), (4, "none", "t")], "doc_id long, text string, source string")
    q = spark.createDataFrame([(9, "Beta gamma"), (8, "")], "query_id long, text string")
    hits = retrieval.overlap_top_k(docs, q, 5)
    assert as_rows(hits) == [(9, 1, 0.5, 2), (9, 2, 1.0, 1)]
    assert as_rows(retrieval.context(hits, docs, "source")) == [(9, "[unknown] beta beta gamma\n\n[s] alpha beta")]


def cached(spark, rows):
    t = dt.datetime(2024, 1, 1)
    full = [(i, q, a, ["f"], m, e, t + dt.timedelta(days=d)) for i, q, a, m, e, d in rows]
    return cache.keyed(spark.createDataFrame(full, "id long, question string, answer string, files array<string>, model string, embedding array<double>, created_at timestamp"))


def test_upsert_keeps_first_id_and_last_known_embedding(spark):
    rows = cached(spark, [(1, "Q ", "a1", "M", [1.0], 3), (2, "q", "a2", " m", None, 1), (3, "q", "a3", None, None, 2), (4, "", "x", "m", None, 4), (5, "q2", None, "m", None, 5)])
    got = {(r.model_key): r for r in cache.upserted(cache.storable(rows)).collect()}
    assert set(got) == {"m", ""}
    assert (got["m"].id, got["m"].answer, got["m"].embedding, got["m"].versions) == (1, "a2", [1.0], 2)


def test_exact_lookup_prefers_model_then_none(spark, as_rows):
    state = cache.upserted(cached(spark, [(1, "q", "a", None, None, 1), (2, "q", "b", "m", None, 1), (3, "r", "c", None, None, 1)]))
    asked = spark.createDataFrame([(1, " Q", "M"), (2, "q", "other"), (3, "r", "m"), (4, "zz", "m"), (5, None, None)], "ask_id long, question string, model string")
    assert as_rows(cache.exact_lookup(state, asked)) == [(1, 2), (2, 1), (3, 3)]


def test_similar_lookup(spark, as_rows):
    state = cache.upserted(cached(spark, [(1, "a", "a", "m", [1.0, 0.0], 1), (2, "b", "b", "m", [2.0, 0.0], 2), (3, "c", "c", "m", [0.0, 1.0], 9), (4, "d", "d", "m", [1.0], 8), (5, "e", "e", "x", [1.0, 0.0], 9)]))
    ask = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", None), (3, "y", [1.0, 0.0])], "ask_id long, model string, embedding array<double>")
    assert as_rows(cache.similar_lookup(state, ask, 0.5)) == [(1, 2, 1.0)]  # the newest of equals
    assert cache.similar_lookup(state, ask, 1.0).count() == 0  # strictly above
    assert cache.similar_lookup(state, ask, 0.5, scan=1).count() == 0  # match is outside the newest


def clustered(spark, n=4_000, width=12, seed=1):
    import numpy as np

    r = np.random.default_rng(seed)
    middle = r.standard_normal((40, width)) * 2
    v = middle[r.integers(0, 40, n)] + r.standard_normal((n, width))
    v[r.random(n) < 0.3] = middle[0]  # a third in one spot
    v += r.standard_normal((n, width)) * 0.01
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(n, None), (n + 1, []), (n + 2, [1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def recall(exact, found):
    want = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    got = {(r.query_id, r.vec_id): r.score for r in found.collect()}
    assert all(abs(want[k] - got[k]) < 1e-9 for k in want.keys() & got.keys())
    worst = {}
    for (q, _), s in want.items():
        worst[q] = min(s, worst.get(q, s))
    return sum(s >= worst[q] - 1e-9 for (q, _), s in got.items()) / len(want)  # equals of the last place count


def test_index_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELL_ROWS", 60)
    monkeypatch.setattr(retrieval, "SALT_ROWS", 500)
    df = clustered(spark).repartition(4).cache()
    asked = df.where("vec_id % 50 = 0")
    for metric in ("cosine", "l2"):
        cells = retrieval.centres(df, metric, cell_rows=60)
        assert len(cells) > 50 and retrieval.celled(df, cells, metric).count() == 4_000  # every row is indexed
        found = retrieval.indexed_top_k(df, asked, 10, metric)
        assert recall(retrieval.top_k(df, asked, 10, metric), found) >= 0.9
        assert found.where("query_id = vec_id").count() == 0
    assert retrieval.indexed_top_k(df.limit(0), asked, 5).count() == 0 == retrieval.indexed_top_k(df, asked.limit(0), 5).count()


def test_index_recall_on_the_test_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = v.where("vec_id % 50 = 0")
    assert recall(retrieval.top_k(v, asked, 10), retrieval.indexed_top_k(v, asked, 10)) >= 0.9


def test_pair_scorer_and_fallback(spark, as_rows):
    hits = spark.createDataFrame([(1, "q", 5, "aa", 1), (1, "q", 6, "bbb", 2), (1, "q", 7, None, 3), (1, "q", 8, "ccc", 4)], "query_id long, question string, doc_id long, text string, rank int")
    pick = lambda df: [r[1] for r in sorted(as_rows(df.select("query_id", "doc_id", "new_rank")), key=lambda r: r[2])]
    assert pick(retrieval.pair_reranked(hits, lambda q, t: [len(x) for x in t], 3)) == [6, 8, 5]
    assert pick(retrieval.pair_reranked(hits, None, 2)) == [5, 6]
    assert pick(retrieval.pair_reranked(hits, lambda q, t: 1 / 0, 3)) == [5, 6, 7]
    assert retrieval.pair_reranked(hits.limit(0), None).count() == 0


def test_questions_in_blocks(spark, as_rows, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} other") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"word{i} other word1") for i in range(6)] + [(9, None)], "query_id long, text string")
    whole = as_rows(retrieval.overlap_top_k(docs, q, 3))
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    assert as_rows(retrieval.overlap_top_k(docs, q, 3)) == whole and len(whole) == 18
