import numpy as np
import pytest

from tessella.llm import abuse
from tessella.llm.abuse import undisguise

CLEAN = ["Участники рисуют схему решения и сравнивают два источника.", "Lessons take place in the library in spring.", "Die Kinder führen ein Heft.", "Les enfants dessinent un schéma."]


@pytest.fixture(scope="module")
def model():
    return abuse.fit([(" ".join(CLEAN), {c: 0.0 for c in abuse.CATEGORIES})] * 3)


def scores(model, text):
    w = model.dense()
    m, _ = abuse.sentence_margins(*abuse.features(*abuse.sentence_words(text)), w, model.bias)
    return dict(zip(abuse.CATEGORIES, (m.max(axis=0) if len(m) else np.full(3, -np.inf)), strict=True))


def test_undisguise():
    assert undisguise("дебил") == undisguise("д3бил".replace("3", "е")) == "дебил"
    assert undisguise("идиoт") == "идиот" and undisguise("cтpиптиз") == "стриптиз" and undisguise("идиииот") == "идиот"
    assert undisguise("1d10t".replace("1d10t", "idi0t")) == "idiot" and undisguise("2024") == "0"
    assert undisguise("с****с") == "с*с" and undisguise("**") == "*"


def test_spaced_letters_are_joined():
    a, b = abuse.sentence_words("слушай, к р е т и н, уходи"), abuse.sentence_words("слушай, кретин, уходи")
    assert np.array_equal(a[0], b[0])
    assert not np.array_equal(abuse.sentence_words("и в с")[0], abuse.sentence_words("ивс")[0])


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("Рисуют схему. Ты кретин, никому ты не нужен. Далее план.", "abusive"),
        ("Lessons in spring. Listen, m0ron, post again and you will regret it.", "abusive"),
        ("Die Fremden sind keine Menschen und gehören vertrieben.", "hateful"),
        ("Чужаки — не люди, гнать их отсюда.", "hateful"),
        ("Hot naked models are waiting in our chat.", "sexual"),
        ("Горячие голые модели ждут тебя в чате.", "sexual"),
    ],
)
def test_seeded_cases(model, text, category):
    s = scores(model, text)
    assert s[category] > 0
    assert all(v < s[category] for k, v in s.items() if k != category)


@pytest.mark.parametrize("text", [*CLEAN, "На занятии о травле разбирают, почему слово «кретин» ранит.", "The biology unit covers reproduction, breasts and sexual health."])
def test_clean_texts(model, text):
    assert max(scores(model, text).values()) < 0


def test_labels_teach_new_phrases():
    r = np.random.default_rng(0)
    plain = ["The group studies maps.", "Feedback is gathered in May.", "The handbook lists exercises.", "Schools receive a pack of sheets.", "The tutor keeps a log."]
    docs = []
    for i in range(200):
        s = [plain[k] for k in r.permutation(5)[:4]]
        bad = i % 4 == 0
        if bad:
            s.insert(2, f"Glorp off, you snazzle number {i}.")
        docs.append((" ".join(s), {"abusive": float(bad), "hateful": 0.0, "sexual": 0.0}))
    m = abuse.fit(docs)
    assert scores(m, "The tutor keeps a log. Glorp off, you snazzle.")["abusive"] > 0
    assert scores(m, " ".join(plain))["abusive"] < 0


def test_l1_leaves_few_weights(model):
    assert len(model.index) < abuse.Model(np.arange(1 << abuse.BITS), None, None).index.size / 4


def test_frames(spark, as_rows, model):
    rows = [(1, "Ты кретин, никому ты не нужен.", "s", "x"), (2, CLEAN[0], None, "x"), (3, None, "s", "x"), (4, "", "s", "x"), (5, "...", "s", "x"), (6, CLEAN[1] * 5_000 + " Чужаки — не люди, гнать их отсюда.", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, abusive string")
    got = {r.doc_id: r for r in abuse.scored(df, model).collect()}
    assert len(got) == 6 and got[3].abusive == got[4].abusive == got[5].abusive == 0.0
    assert as_rows(abuse.flagged(abuse.scored(df, model))) == [(1, "abusive"), (6, "hateful")]
    rates = {r.source: (r.docs, r.abusive_rate, r.any_rate) for r in abuse.source_rates(abuse.scored(df, model, ("doc_id", "source"))).collect()}
    assert rates == {"s": (4, 0.25, 0.25), "unknown": (2, 0.0, 0.5)}
    assert abuse.flagged(abuse.scored(df.limit(0), model)).count() == 0


def test_fit_on_frames(spark):
    docs = spark.createDataFrame([(1, CLEAN[0]), (2, "Ты кретин, никому ты не нужен."), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "ok"), (2, "abusive"), (2, None), (3, "ok"), (9, "ok")], "doc_id long, label string")
    assert len(abuse.fit_on(docs, labels).index) > 0
    assert len(abuse.fit_on(docs.limit(0), labels.limit(0)).index) > 0
