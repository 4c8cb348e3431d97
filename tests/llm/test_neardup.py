import inspect
import random
import re

import numpy as np

from tessella.llm import neardup


def similarity(a, b):
    def sh(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def test_code_covers_every_radius():
    m = neardup.masks()
    assert m.sum(axis=1).min() >= 5
    for i in range(neardup.WIDTH):
        for j in range(neardup.WIDTH):  # any two differing positions leave some mask whole
            assert (~m[:, [i, j]].any(axis=1)).any()


def test_sketches_within_radius_share_a_bucket():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**32, (200, neardup.WIDTH), dtype=np.uint32)
    b = a.copy()
    for row in b:
        row[r.choice(neardup.WIDTH, neardup.RADIUS, replace=False)] += 1
    x, y = neardup.bucket_keys(a, 1), neardup.bucket_keys(b, 1)
    assert (x == y).any(axis=1).all()


def test_pairs_next_to_the_threshold_share_a_bucket():
    groups = inspect.signature(neardup.similar_pairs).parameters["groups"].default
    assert groups == inspect.signature(neardup.representative_pairs).parameters["groups"].default
    r = np.random.default_rng(5)
    a = r.integers(0, 256, (10_000, groups * neardup.WIDTH), dtype=np.uint8)
    b = np.where(r.random(a.shape) < 0.6, a, a + np.uint8(1))
    found = (neardup.bucket_keys(a, groups) == neardup.bucket_keys(b, groups)).any(axis=1)
    assert found.mean() > 0.985


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(60, 160))] for _ in range(40)]
    out = []
    for b in base:
        for _ in range(4):
            t = [w for w in b]
            for _ in range(r.randint(0, 12)):
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], [r.choice(words)], [t[i], r.choice(words)]])
            out.append(" ".join(t))
    return out


def test_recall_against_brute_force(spark):
    texts = corpus()
    texts += [texts[0], texts[0].upper().replace(" ", ",\n"), None, "", "one two", "one two three", "One, two; THREE!"]
    df = spark.createDataFrame([(i * 7, t, "x") for i, t in enumerate(texts)], "page_id long, page_text string, a string")
    want = {(7 * i, 7 * j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.6}
    got = {(r.a, r.b) for r in neardup.similar_pairs(df).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    exact = {(7 * i, 7 * j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) == 1}
    assert exact <= got  # copies are never lost


def test_groups_join_copies_without_pairing_them(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near = text + " extra words here"
    rows = [(i, text) for i in range(300)] + [(500, near), (501, "something else entirely here"), (502, None), (503, "")]
    df = spark.createDataFrame(rows, "page_id long, page_text string")
    found, member = neardup.representative_pairs(df)
    assert found.count() == 1 and member.count() == 302
    got = {r.id: (r.group_id, r.copies) for r in neardup.page_groups(df).collect()}
    assert got == {i: (0, 300) for i in range(300)} | {500: (0, 1), 501: (501, 1), 502: (502, 1), 503: (503, 1)}


def test_groups_equal_components_of_all_pairs(spark, monkeypatch):
    texts = corpus(8)
    template = [f"t{i}" for i in range(100)]
    r = random.Random(1)
    for i in range(60):  # one template, filled in differently: hot buckets
        t = list(template)
        for k in r.sample(range(100), 3):
            t[k] = f"own{i}x{k}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, page_text string")
    pairs = [(x.a, x.b) for x in neardup.similar_pairs(df).collect()]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(neardup._blocked, "__defaults__", (8,))  # blocks of hot buckets
    assert {x.id: x.group_id for x in neardup.page_groups(df).collect()} == dict(enumerate(root))
    assert sorted((x.a, x.b) for x in neardup.similar_pairs(df).collect()) == sorted(pairs)


def test_candidates_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(corpus(5)[:60])), "page_id long, page_text string")
    want = sorted(map(tuple, neardup.similar_pairs(df).collect()))
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert want and sorted(map(tuple, neardup.similar_pairs(df).collect())) == want


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)], "a long, b long")
    got = neardup.components(edges).collect()
    assert len(got) == 81 and {r.g for r in got} == {0}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, page_text string")
    assert neardup.similar_pairs(df).count() == 0
    assert neardup.page_groups(df).count() == 0
