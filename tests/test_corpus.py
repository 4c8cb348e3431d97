from pyspark.sql import functions as F

from tessella.operators import corpus, indexing, requests

DOCS = "doc_id long, text string, lang string"


def made(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def test_nulls_ties_and_repeats(spark, as_rows):
    d = corpus.cleaned(made(spark, [(3, "same", None), (1, "same ", "ru"), (2, None, "ru"), (4, "", "en"), (5, "same", "en"), (6, "other", None)]))
    assert as_rows(corpus.canonical_ids(d).select("doc_id", "copies")) == [(1, 3), (6, 1)]
    assert as_rows(corpus.duplicate_groups(d)) == [(1, 2, "3,5")]
    assert as_rows(corpus.empty_after_clean(d)) == [(2, "empty_after_clean"), (4, "empty_after_clean")]
    for unique in (corpus.canonical(d), corpus.unique_measures(d)):
        assert as_rows(corpus.language_share(unique)) == [("ru", 1, 0.5), ("unknown", 1, 0.5)]
        assert as_rows(unique.select("doc_id")) == [(1,), (6,)]
    twice = d.unionByName(d)  # rows that repeat a document count once
    assert as_rows(corpus.canonical(twice).select("doc_id", "clean")) == [(1, "same"), (6, "other")]


def test_texts_are_cleaned_once_and_not_shuffled(spark):
    d = corpus.cleaned(made(spark, [(i, f"text {i % 3}", "en") for i in range(9)]))
    plan = corpus.unique_measures(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    plan = corpus.canonical(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange hashpartitioning" not in plan


def test_first_documents_beyond_the_broadcast(spark, as_rows, monkeypatch):
    d = corpus.cleaned(made(spark, [(i, f"text {i % 4}", "en") for i in range(20)] + [(30, "alone", None)]))
    want = as_rows(corpus.canonical(d).select("doc_id", "clean"))
    monkeypatch.setattr(corpus, "BROADCAST_GROUPS", 0)
    assert as_rows(corpus.canonical(d).select("doc_id", "clean")) == want and len(want) == 5


def test_quantiles_by_rank_equal_the_direct_ones(spark, as_rows, monkeypatch):
    import random

    import numpy as np

    from tessella.operators import quantiles

    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([None, r.random(), r.randint(0, 9) / 2]), float(r.randint(-5, 5))) for _ in range(3_000)] + [("one", 7.0, None)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    qs = (0.0, 0.1, 0.5, 0.95, 1.0)
    for by in ((), ("g",)):
        direct = as_rows(quantiles.profile(df, ("x", "y"), qs, by))
        monkeypatch.setattr(quantiles, "DIRECT_ROWS", 0)
        ranked = as_rows(quantiles.profile(df, ("x", "y"), qs, by))
        monkeypatch.undo()
        assert len(direct) == len(ranked) == (2 if not by else 7)
        for a, b in zip(direct, ranked, strict=True):
            assert a[:-1] == b[:-1] and np.allclose(a[-1], b[-1], rtol=1e-12)
        for row in direct:
            values = [v[1 if row[-6] == "x" else 2] for v in data if not by or v[0] == row[0]]
            assert np.allclose(row[-1], np.quantile([v for v in values if v is not None], qs))
    assert quantiles.profile(df.limit(0), ("x",), qs).count() == 0


def test_empty_tables(spark):
    d = corpus.cleaned(made(spark, []))
    u = corpus.canonical(d)
    assert corpus.duplicate_groups(d).count() == 0
    assert corpus.describe_all(corpus.lengths(corpus.unique_measures(d))).count() == 0
    assert corpus.tfidf_top(d).count() == 0
    assert corpus.lexical_diversity(corpus.vocabulary(u)).first().diversity == 0.0
    assert all(r.value == 0.0 for r in corpus.quality_metrics(d).collect())


def test_quality_metrics_by_hand(spark):
    d = corpus.cleaned(made(spark, [(1, "aa bb", "en"), (2, "aa bb", "en"), (3, "привет", "ru"), (4, " ", None)]))
    m = {r.metric: r.value for r in corpus.quality_metrics(d).collect()}
    assert m["duplicate_ratio"] == 0.25 and m["error_rate"] == 0.25 and m["largest_duplicate_group"] == 2
    assert m["avg_tokens_per_document"] == 1.5 and m["lexical_diversity"] == 1.0 and m["non_ascii_ratio"] == 0.5
    assert m["short_doc_ratio"] == 1.0 and m["clean_text_coverage"] == 0.0


def test_term_coverage(spark, as_rows):
    vocab = spark.createDataFrame([("urok", 3), ("a b", 1)], "term string, freq long")
    terms = spark.createDataFrame([(" Urok",), ("urok",), ("x y",), ("",)], "term string")
    c = corpus.term_coverage(vocab, terms)
    assert as_rows(c) == [("urok", 2, 3, True), ("x y", 1, 0, False)]
    assert tuple(corpus.coverage_ratio(c).first()) == (3, 2, 0.666667)
    assert tuple(corpus.coverage_ratio(corpus.term_coverage(vocab, terms.limit(0))).first()) == (0, 0, 0.0)


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    r = corpus.describe(df, "x").first()
    assert (r.n, r.min, r.max, r.mean, r.p50, r.p90) == (2, 1.0, 2.0, 1.5, 1.5, 1.9)


def test_index_rules(spark, as_rows):
    df = spark.createDataFrame([(1, "s", " " + "x" * 30), (2, "s", "x" * 30), (3, None, "x" * 30), (4, None, "x" * 30), (5, "s", "x" * 29), (6, "s", None)], "id long, source string, text string")
    kept = indexing.min_length(df)
    assert as_rows(kept.select("id")) == [(1,), (2,), (3,), (4,)]
    assert as_rows(indexing.first_per_signature(kept, ("source",), "id").select("id")) == [(1,), (3,)]
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, source string")
    new = spark.createDataFrame([(9, "a", 1)], "id long, source string, extra int")
    got = indexing.replace_by_source(old.withColumnRenamed("id", "id"), new.drop("extra"))
    assert as_rows(got) == [(2, "b"), (3, None), (9, "a")]
    # rows of the target do not seed the signatures of the batch
    assert as_rows(indexing.not_yet_indexed(kept, spark.createDataFrame([(1,)], "id long"), "id").select("id")) == [(2,), (3,), (4,)]


def test_log_statistics(spark):
    log = spark.createDataFrame([(1, "ok", 1.0, None, 5), (2, "ok", 3.0, 4, None)], "id long, status string, duration_ms double, text_len long, token_count long")
    r = requests.stats(log).first()
    assert (r.requests, r.duration_mean, r.duration_p50, r.duration_p95, r.text_len_mean, r.token_count_mean) == (2, 2.0, 2.0, 2.9, 4.0, 5.0)
    assert r.image_width_mean is None and r.image_height_p50 is None
    sized = log.withColumn("image_width", F.col("id") * 10).withColumn("image_height", F.when(F.col("id") == 2, 7))
    by = {x.status: x for x in requests.stats(sized.unionByName(sized.withColumn("status", F.lit(None).cast("string"))), ("status",)).collect()}
    assert (by["ok"].image_width_mean, by["ok"].image_width_p50, by["ok"].image_height_p50) == (15.0, 15.0, 7.0) and by[None].requests == 2 and by[None].duration_p50 == 2.0
    none = requests.stats(log.limit(0)).first()
    assert none.requests == 0 and none.duration_mean is None and none.duration_p50 is None
    assert [r.id for r in requests.history(log, 1).collect()] == [2]


def test_histogram(spark, as_rows):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.99,), (None,)], "x double")
    assert as_rows(requests.histogram(df, "x", 4)) == [(0, 1), (3, 2)]
    one = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert as_rows(requests.histogram(one, "x")) == [(0, 2)]
