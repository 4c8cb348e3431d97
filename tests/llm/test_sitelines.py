from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import sitelines
from tessella.llm.sitelines import chunk_lines, line_key


def test_line_key_python_and_jvm(spark):
    lines = ["  A\xa0 b\t12 ", "x", "", " ", "№ 7–8", "Ы ٣4", "a\x1cb\x85c", "ß"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string")
    got = {r[0]: r[1] for r in df.select("i", sitelines.line_key_col(F.col("l"))).collect()}
    assert got == {i: line_key(x) for i, x in enumerate(lines)}


def test_chunks_depend_on_content_only():
    a = "some long footer line that stands on many pages and has several chunks in it, surely enough of them"
    of, h, n = chunk_lines(["zz", a, "q", "x" + a])
    assert n.sum() == len("zz" + a + "q" + "x" + a)
    mine, shifted = h[of == 1], h[of == 3]
    assert len(mine) > 1 and set(mine[2:]) <= set(shifted)  # a shift changes only chunks within a window of it
    again = chunk_lines([a])[1]
    assert np.array_equal(again, mine)
    for short in range(1, 9):
        assert [x.sum() for x in chunk_lines(["a" * short])[2:]] == [short]


def pages(spark):
    rows = []
    for i in range(40):
        body = f"Unique paragraph number {'x' * i} with words of page {i}\nMENU\n© 20{i:02d} Site.  All rights\n"
        rows.append((i, f"http{'s' * (i % 2)}://{'www.' if i % 3 else ''}Hot.example{':80' if i % 5 == 0 else ''}/{i}", body + ("Rare line\n" if i < 4 else "") + ("Five\nFive\n" if i < 5 else ""), "k"))
    rows += [(100 + i, "https://small.example/", "MENU\nother", None) for i in range(4)]
    rows += [(200, None, "MENU", None), (201, "https://hot.example/", None, None), (202, "https://long.example/", "y" * 200_000, None)]
    return spark.createDataFrame(rows, "page_id long, page_url string, page_text string, line_key string").withColumn("site", F.lit(1)).withColumn("chunk", F.lit(2)).withColumn("n", F.lit(3))


def test_against_brute_force(spark, as_rows):
    df = pages(spark)
    got = as_rows(sitelines.repeated_lines(df).select("site", "line_key", "n_pages", "site_rows"))
    assert got == [("hot.example", "five", 5, 41), ("hot.example", "menu", 40, 41), ("hot.example", "unique paragraph number x with words of page 0", 1, 41)] or got == [
        ("hot.example", "five", 5, 41), ("hot.example", "menu", 40, 41), ("hot.example", "© 0 site. all rights", 40, 41)
    ]
    count, rows = Counter(), Counter()
    for r in df.collect():
        if r.page_url:
            site = r.page_url.lower().split("/")[2].split(":")[0].removeprefix("www.")
            rows[site] += 1
            count.update({(site, line_key(x)) for x in (r.page_text or "").split("\n") if line_key(x)})
    assert {(s, k) for s, k, _, _ in got} == {x for x, n in count.items() if n >= 5 and n * 10 >= rows[x[0]]}


def cleaned(df):
    return sitelines.without_repeats(df, sitelines.repeated_lines(df), sitelines.repeated_passages(df))


def both_ways(monkeypatch, df):
    """Broadcast, and shuffled with a hot site parted."""
    first = {r.page_id: tuple(r) for r in cleaned(df).collect()}
    monkeypatch.setattr(sitelines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sitelines, "SALT_ROWS", 7)
    assert {r.page_id: tuple(r) for r in cleaned(df).collect()} == first
    return first


def test_removal(spark, monkeypatch):
    df = pages(spark)
    got = both_ways(monkeypatch, df)
    assert len(got) == df.count()
    assert "MENU" not in got[7][1] and "Unique paragraph" in got[7][1] and got[7][2] == 2
    assert got[200][1] == "MENU" and got[201][1] is None and got[100][2] == 0


def test_passages_are_cut_across_lines_and_inside_them(spark, monkeypatch):
    byline = "Материал подготовлен редакцией школьного портала, перепечатка разрешена только с активной ссылкой на источник и указанием автора текста"
    rows = []
    for i in range(30):
        own = f"Собственный абзац страницы {'абвгдежзик'[i % 10] * (i + 3)} про урок {'клмнопрст'[i % 9] * (i + 2)}"
        end = byline if i % 2 else byline.replace(" портала, ", "\nпортала, ")  # wrapped otherwise on every second page
        rows.append((i, "https://a.example/x", f"{own} {end}. {i * i} {'щъыьэюя'[i % 7] * (i + 4)} хвост"))
    df = spark.createDataFrame(rows, "page_id long, page_url string, page_text string")
    assert sitelines.repeated_lines(df).count() <= 1  # no whole line tells it
    for i, (_, kept, _, gone) in both_ways(monkeypatch, df).items():
        assert gone > len(byline) / 2 and "разрешена только с активной" not in kept
        assert rows[i][2].split(" про урок ")[0] in kept and kept.endswith(rows[i][2][-8:])


def test_chunks_of_pages_know_their_places():
    texts = ["A  b\n12 c" * 30, "", "İ x" * 50, "a b 7 C" * 30]
    of, h, begin, end, n = sitelines.chunk_pages(texts)
    for k, t in enumerate(texts):
        mine = of == k
        assert "".join(t[a:b] for a, b in zip(begin[mine], end[mine], strict=True)) == t
    assert np.array_equal(h[of == 0], h[of == 3])  # white space, figures and case aside they are equal


def test_empty(spark):
    df = pages(spark).limit(0)
    assert sitelines.repeated_lines(df).count() == 0
    assert cleaned(df).count() == 0
