import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.text import clean_text, tokens_of
from tessella.llm import tokens

BPE = f"bpe:{tokens.bpe_path()}"
needs_bpe = pytest.mark.skipif(not os.path.exists(tokens.bpe_path()), reason="no vocabulary files")
PARTS = st.lists(st.sampled_from(["слово", "word", "a-b", " ", "\n", "  ", "\n\n\n", "́", "\xa0", "½", "12", "x" * 30, ". ", "-\n", "＿", "\x07", "。", "中文", "，", "ᄀ", "ᅡ", "'s", "'", "－", "١٢", "ͺ", "￼", "—", "한"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(1, 40))
def test_cuts_keep_the_count(parts, size):
    text = "".join(parts)
    cut = tokens.cut_text(text, size)
    assert "".join(cut) == text
    assert sum(tokens.count_tokens(cut)) == len(tokens_of(clean_text(text)))


@needs_bpe
@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(1, 40))
def test_cuts_keep_the_bpe_count(parts, size):
    text = "".join(parts)
    assert sum(tokens.count_tokens(tokens.cut_text(text, size, BPE), BPE)) == tokens.count_tokens([text], BPE)[0]


def test_oversized_branch_equals_whole(spark, as_rows):
    texts = [(1, "one two three " * 50), (2, "x" * 400), (3, None), (4, ""), (5, "short")]
    df = spark.createDataFrame(texts, "k long, text string")
    got = as_rows(tokens.with_token_counts(df, "k", "text", size=100))
    assert got == sorted((k, len(tokens_of(clean_text(t)))) for k, t in texts)


@pytest.mark.parametrize("sentence", ["Школьный музей открыт по вторникам, вход свободный. ", "学校博物馆每周二开放，入场免费。", "學校。", "학교 박물관은 화요일에 연다. "])
def test_long_texts_of_any_script_are_cut(spark, sentence):
    text = sentence * (1_000_000 // len(sentence))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    assert len(tokens.cut_text(text, tokens.CHUNK_CHARS)) > 10
    assert tokens.with_token_counts(df, "k", "text").first().n_tokens == len(tokens_of(clean_text(text)))


@needs_bpe
@pytest.mark.parametrize("sentence", ["Школьный музей открыт по вторникам, вход свободный. ", "学校博物馆每周二开放，入场免费。"])
def test_long_texts_of_any_script_are_cut_for_bpe(spark, sentence):
    text = sentence * (1_000_000 // len(sentence))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    assert len(tokens.cut_text(text, tokens.CHUNK_CHARS, BPE)) > 10
    assert tokens.with_token_counts(df, "k", "text", BPE).first().n_tokens == tokens.count_tokens([text], BPE)[0]


def test_sites(spark):
    urls = ["http://www.A.example:80/x", "HTTPS://a.example", "https://u@a.example/?q", " https://a.example./ ", None, "", "www.a.example/p"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(tokens.site_of(F.col("u"))).collect()] == ["a.example", "a.example", "a.example", "a.example", None, None, "a.example"]


def made(spark):
    docs = spark.createDataFrame([("p/a.pdf", "uno dos tres", "S", 1), ("p/e.pdf", "", None, 2)], "source_path string, text string, source string, n_tokens long")
    pages = spark.createDataFrame(
        [(1, "http://www.h.example/x", "b.pdf", "one two", "H"), (2, "http://h.example/y", "b.pdf", "one  two", "H"), (3, "http://h.example/z", None, "zz zz", "H"), (4, "http://k", "c.pdf", None, "N")],
        "page_id long, page_url string, pdf_file_name string, page_text string, clean_text_hash string",
    )
    rec = [(1, "p/a.pdf", "x", 3, "ru"), (2, "p/a.pdf", "x", None, None), (3, "q/b.pdf", "H", 2, "en-GB"), (4, "q/b.pdf", "other", 2, "en"), (5, "q/b.pdf", "H", 9, "eng"), (6, None, None, 1, "de"), (7, "p/e.pdf", "x", 1, "UND"), (8, "z/c.pdf", "N", 0, "uk")]
    return spark.createDataFrame(rec, "record_id long, source_path string, content_hash string, tokens int, language string"), docs, pages


def test_records(spark, as_rows):
    counted = tokens.record_tokens(*made(spark))
    got = {r.record_id: (r.n_tokens, r.origin, r.domain) for r in counted.collect()}
    assert got == {1: (3, "documents", "S"), 2: (3, "documents", "S"), 3: (2, "scanned_pages", "h.example"), 4: (None, None, "unknown"), 5: (2, "scanned_pages", "h.example"), 6: (None, None, "unknown"), 7: (0, "documents", "unknown"), 8: (0, "scanned_pages", "k")}
    assert as_rows(tokens.unreliable_counts(counted)) == [(2,), (5,), (7,)]
    totals = {(r.origin, r.lang, r.domain): (r.records, r.total_tokens) for r in tokens.token_totals(counted).collect()}
    assert totals["*", "*", "*"] == (6, 10) and totals["*", "en", "*"] == (2, 4) and totals["*", "unknown", "*"] == (2, 3)
    assert totals["documents", "*", "*"] == (3, 6) and totals["scanned_pages", "en", "h.example"] == (2, 4)


def test_null_count_without_text_is_unreliable(spark, as_rows):
    counted = spark.createDataFrame([(1, None, None), (2, 5, None), (3, None, 4), (4, 4, 4)], "record_id long, tokens long, n_tokens long")
    assert as_rows(tokens.unreliable_counts(counted)) == [(1,), (3,)]


def test_empty(spark):
    counted = tokens.record_tokens(*[x.limit(0) for x in made(spark)])
    assert counted.count() == 0 and tokens.unreliable_counts(counted).count() == 0
