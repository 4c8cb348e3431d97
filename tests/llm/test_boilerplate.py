import random

import numpy as np
import pytest

from tessella.llm import boilerplate as b

MENU = ["Home", "Catalogue", "Programmes", "Contacts", "Sign in", "Library"]
FOOT = ["© 2021 School site. All rights reserved.", "Privacy policy", "Subscribe to the newsletter", "Views: 55", "Share with friends", "We use cookies so that the site works better."]
LINKS = ["How we studied the river", "Notes for mentors", "A meeting about budgets"]
SUBJECT = ["children", "teachers", "mentors", "parents", "students", "librarians"]
VERB = ["discuss", "build", "compare", "describe", "measure", "draw"]
THING = ["a cardboard model of the bridge", "two sources about the old town", "the water of the local pond", "their plan for the coming week"]


def page(r, i):
    title = f"Lessons on topic {i}"
    head = [] if r.random() < 0.3 else [f"===== https://s.example/{i} ====="]
    menu = r.sample(MENU, 4) if r.random() < 0.6 else [" | ".join(r.sample(MENU, 4))]
    body = [title]
    heads = [title]
    for _ in range(r.randint(2, 4)):
        para = " ".join(f"The {r.choice(SUBJECT)} {r.choice(VERB)} {r.choice(THING)} and the {r.choice(SUBJECT)} help them in room {r.randint(1, 99)}." for _ in range(r.randint(2, 4)))
        body.append(para)
        if r.random() < 0.4:
            body += [f"* {r.choice(VERB)} the plan ({r.randint(1, 99)})", f"* {r.choice(VERB)} the map ({r.randint(1, 99)})"]
    foot = r.sample(FOOT, 4)
    if r.random() < 0.5:
        foot = ["Read also", *r.sample(LINKS, 2), *foot]
    lines = head + menu + body + foot
    truth = [1] * (len(head) + len(menu)) + [0] * len(body) + [1] * len(foot)
    return {"text": "\n".join(lines), "title": title, "headings": heads, "site": i % 4, "truth": truth}


@pytest.fixture(scope="module")
def net():
    r = random.Random(1)
    return b.fit([page(r, i) for i in range(250)], epochs=6)


def test_held_out_pages(net):
    r = random.Random(2)
    right = total = 0
    for i in range(60):
        p = page(r, 1000 + i)
        score = net.scores([b.page_input(p["text"], p["title"], p["headings"])])[0]
        right += int(((score >= 0.5) == np.array(p["truth"], bool)).sum())
        total += len(score)
    assert right / total > 0.97


def test_gradient_is_that_of_the_loss():
    n = b.Network(3)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    r = random.Random(3)
    batch = [b.page_input(p["text"], p["title"], p["headings"]) for p in (page(r, 1), page(r, 2))]
    labels = [np.arange(len(x[1])) % 2 for x in batch]

    def loss(p):
        m = b.Network.__new__(b.Network)
        m.p = p
        s = [np.clip(x, 1e-9, 1 - 1e-9) for x in m.scores(batch)]
        return -sum(np.log(np.where(y == 1, q, 1 - q)).sum() for q, y in zip(s, labels, strict=True)) / sum(map(len, labels))

    seen = {}
    real = b.Network.step
    state: dict = {}
    before = {k: v.copy() for k, v in n.p.items()}
    real(n, batch, labels, state, 0.0)
    for k in ("Wf", "Wb", "U", "cf", "o"):
        g = state[k][0] * 10  # first Adam moment is a tenth of the gradient
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({x: v.copy() for x, v in before.items()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        seen[k] = (loss(up) - loss(down)) / 2e-3, g[i]
    for k, (want, got) in seen.items():
        assert abs(want - got) <= 0.03 * abs(want) + 1e-4, k


def test_padding_does_not_change_scores(net):
    r = random.Random(5)
    a, c = (page(r, i) for i in (1, 2))
    one, two = (b.page_input(p["text"], p["title"], p["headings"]) for p in (a, c))
    alone, together = net.scores([one])[0], net.scores([one, two, b.page_input(None, None, None)])[0]
    assert np.allclose(alone, together, atol=1e-5)


def test_leaves_and_empty():
    assert b.leaves(None) == b.leaves("") == b.leaves(" \n\t") == []
    assert [(n, s) for n, s, *_ in b.leaves("a\n\n  b \n")] == [(1, "a"), (3, "b")]
    assert len(b.page_input("x\n" * 3_000, None, None)[0]) == 3_000


def test_frames(spark, net):
    r = random.Random(7)
    rows = [(i, p["text"], p["title"], p["headings"], "s") for i, p in ((i, page(r, i)) for i in range(6))] + [(50, None, None, None, "s"), (51, "", "t", [], "s"), (52, "word " * 50_000, None, [None], "s")]
    df = spark.createDataFrame(rows, "page_id long, page_text string, page_title string, headings array<string>, line_no string")
    lines = b.furniture_lines(df, net)
    assert lines.columns == ["page_id", "line_no", "score"] and lines.count() > 20
    main = {x.page_id: x.main_text for x in b.main_text(df, net).collect()}
    assert len(main) == 9 and main[50] is None and main[51] == ""
    assert "Lessons on topic 3" in main[3] and "Privacy policy" not in main[3]
    assert b.furniture_lines(df.limit(0), net).count() == 0


def test_fit_without_pages(spark):
    df = spark.createDataFrame([], "page_id long, page_text string, page_title string, headings array<string>, resource_id long")
    assert b.furniture_lines(df, b.fit_on(df)).count() == 0


def test_recurrence_counts_all_pages(spark):
    r = random.Random(8)
    every = [page(r, i) for i in range(80)]
    df = spark.createDataFrame([(i, p["site"] if i % 9 else None, p["text"] if i % 11 else None, None) for i, p in enumerate(every)], "page_id long, resource_id long, page_text string, site string")
    for i, p in enumerate(every):
        p["site"], p["text"] = (p["site"] if i % 9 else -1), (p["text"] if i % 11 else None)
    sample = [p for p in every[:12] if p["text"]]
    got, want, some = b.recurrence(df, sample), b.counted(every), b.counted(sample)
    assert got.pages == 80 and got.keys == {k: want.keys[k] for k in some.keys} and got.pairs == {k: want.pairs[k] for k in some.pairs}
    assert got.sites == {s: want.sites[s] for s in some.sites}
    assert b.recurrence(df.limit(0), []).pages == 0
