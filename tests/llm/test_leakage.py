import re

import numpy as np
import pandas as pd

from tessella.llm import leakage

ITEM = "Архив хранит подвал корпуса, доступ открыт по вторникам с жетоном номер пять и подписью."
SCHEMA = "item_id long, question string, refs array<string>, answer_ref string"
DOCS = "doc_id long, text string, term string, item_id long"


def items(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], DOCS)


def test_places(spark, as_rows):
    texts = [
        "до " + ITEM + " после",
        ITEM.upper().replace(" ", "\n"),
        ITEM.replace("корпуса", "кор-\nпуса").replace("а", "а­"),
        "доступ открыт по вторникам с жетоном номер",  # seven words only
        "подвал корпуса — доступ, открыт: по вторникам (с) жетоном!",
        None,
        "",
        "доступ открыт по средам с жетоном номер пять и подписью",
        "слово " * 5_000 + ITEM,
    ]
    it = items(spark, [(1, "Что?", [ITEM], None), (2, ITEM, None, None), (3, "short", [None, ""], ""), (4, None, None, None)])
    assert as_rows(leakage.leaked(docs(spark, texts), it)) == [(d, i) for d in (0, 1, 2, 4, 8) for i in (1, 2)]


def test_hyphen_is_read_both_ways(spark, as_rows):
    item = "раз два из за того что три четыре пять шесть"
    texts = ["раз два из-\nза того что три четыре пять шесть", "раз два изза того что три четыре пять шесть"]
    assert as_rows(leakage.leaked(docs(spark, texts), items(spark, [(1, item, None, None)]))) == [(0, 1)]


def test_brute_force_on_repeated_words(spark, as_rows):
    import random

    r = random.Random(4)
    words = ["a", "b", "c"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(80)]
    it = [(i, " ".join(r.choice(words) for _ in range(12)), None, None) for i in range(6)]
    want = []
    for d, t in enumerate(texts):
        for i, q, *_ in it:
            w = q.split()
            if any(re.search(rf"\b{' '.join(w[k : k + 8])}\b", t) for k in range(len(w) - 7)):
                want.append((d, i))
    assert as_rows(leakage.leaked(docs(spark, texts), items(spark, it))) == sorted(want)
    assert want


def test_near(spark, as_rows):
    text = "вторникам доступ открыт жетоном номер пять с подписью"
    assert as_rows(leakage.near_matches(docs(spark, [text, "доступ"]), items(spark, [(1, ITEM, None, None)])).select("doc_id", "item_id")) == [(0, 1)]


def test_near_at_every_offset(spark, as_rows):
    item = [f"w{i}" for i in range(15)]
    texts = [" ".join(item[k : k + 8]) for k in range(8)]
    texts += [" ".join([*item[k : k + 3], "x", *item[k + 4 : k + 6], "y", item[k + 7]]) for k in range(8)]  # two words changed
    got = leakage.near_matches(docs(spark, texts), items(spark, [(1, " ".join(item), None, None)]))
    assert as_rows(got) == [(d, 1, 8 if d < 8 else 6) for d in range(16)]


def test_near_against_brute_force(spark, as_rows):
    import random
    from collections import Counter

    r = random.Random(9)
    words = [f"w{i}" for i in range(90)]
    its = [[r.choice(words) for _ in range(r.randint(8, 20))] for _ in range(12)]
    texts = []
    for _ in range(80):
        t = [r.choice([*words, "other", "more"]) for _ in range(r.randint(0, 60))]
        w = r.choice(its)
        k = r.randrange(len(w) - 7)
        at = r.randint(0, len(t))
        texts.append(t[:at] + [x for x in w[k : k + 8] if r.random() < 0.9] + t[at:])
    df = Counter(x for t in texts for x in set(t))
    want = {}
    for i, w in enumerate(its):
        for k in range(len(w) - 7):
            run = w[k : k + 8]
            anchors = sorted(set(run), key=lambda x: (df[x], run.index(x)))[:3]
            for d, t in enumerate(texts):
                for at in range(len(t)):
                    m = len(set(run) & set(t[max(at - 8, 0) : at + 9])) if t[at] in anchors else 0
                    if m >= 6:
                        want[d, i] = max(m, want.get((d, i), 0))
    them, it = docs(spark, [" ".join(t) for t in texts]), items(spark, [(i, " ".join(w), None, None) for i, w in enumerate(its)])
    near = as_rows(leakage.near_matches(them, it))
    assert near == sorted((d, i, m) for (d, i), m in want.items())
    whole = {
        (d, i) for d, t in enumerate(texts) for i, w in enumerate(its) for k in range(len(w) - 7)
        if len(set(w[k : k + 8])) >= 6 and f" {' '.join(w[k : k + 8])} " in f" {' '.join(t)} "
    }
    assert whole and whole <= set(as_rows(leakage.leaked(them, it))) and whole <= {(d, i) for d, i, _ in near}


def test_blocks_change_nothing(spark, as_rows, monkeypatch):
    it = items(spark, [(1, ITEM, [ITEM, "иной текст из девяти разных слов стоит тут рядом с ним"], None), (2, "x", None, ITEM)])
    them = docs(spark, [ITEM, "иной текст из девяти разных слов стоит тут рядом с ним", "текст иной разных из девяти слов тут стоит"])
    whole = as_rows(leakage.leaked(them, it)), as_rows(leakage.near_matches(them, it))
    assert len(whole[0]) == 3 and len(whole[1]) == 4
    monkeypatch.setattr(leakage, "BLOCK_RUNS", 3)
    assert (as_rows(leakage.leaked(them, it)), as_rows(leakage.near_matches(them, it))) == whole
    sizes = [(len(b) // 8, b["phrase"].min()) for b in leakage.phrases(it)]
    assert sizes == [(3, 3 * i) for i in range(len(sizes) - 1)] + [(sizes[-1][0], 3 * (len(sizes) - 1))] and len(sizes) > 4


def test_slices_of_places_change_nothing(monkeypatch):
    r = np.random.default_rng(2)
    runs = r.integers(0, 70, (40, 8))
    pos = np.flatnonzero(r.random(3_000) < 0.8)
    term = r.integers(0, 70, len(pos))
    terms = pd.DataFrame({"item_id": np.repeat(np.arange(40), 8), "term": runs.ravel()})
    anchor = pd.DataFrame({"phrase": np.repeat(np.arange(40), 3), "term": runs[:, :3].ravel()})
    loose = leakage._loose_runs(np.arange(70), terms, anchor, 8)
    got = []
    for places in (10**6, 7):
        monkeypatch.setattr(leakage, "PLACES", places)
        got.append([np.concatenate(x).tolist() for x in zip(*leakage._loose_hits(term, pos, *loose[1:], 8, 3), strict=True)])
    assert got[0] == got[1] and len(got[0][0]) > 100


def test_empty(spark):
    it = items(spark, [(1, ITEM, None, None)])
    assert leakage.leaked(docs(spark, [ITEM]).limit(0), it).count() == 0
    assert leakage.leaked(docs(spark, [ITEM]), it.limit(0)).count() == 0
    assert leakage.near_matches(docs(spark, [ITEM]), it.limit(0)).count() == 0
