import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid

TEXT = {
    "ru": "Занятия проходят в районной библиотеке весной. Участники ведут дневник наблюдений и рисуют схему. Учителя попросили продолжить курс для всех детей.",
    "uk": "Заняття відбуваються у сільській школі щосуботи. Учасники ведуть щоденник спостережень і малюють схему. Учителі попросили продовжити курс для всіх дітей.",
    "en": "Lessons take place in the district library in spring. The participants keep a log and draw a diagram. Teachers asked to continue the course for all children.",
    "de": "Der Unterricht findet im Frühling in der Stadtbücherei statt. Die Kinder führen ein Heft und zeichnen eine Skizze. Das Kollegium bat um eine Fortsetzung für alle.",
    "fr": "Les leçons ont lieu au printemps dans la bibliothèque du quartier. Les enfants tiennent un carnet et dessinent un schéma. Les enseignants ont demandé une suite pour tous.",
}
HELD_OUT = {
    "ru": "Погода сегодня хорошая, поэтому мы пойдём гулять в парк вместе с друзьями.",
    "uk": "Погода сьогодні гарна, тому ми підемо гуляти до парку разом із друзями.",
    "en": "The weather is fine today, so we will walk to the park with our friends.",
    "de": "Das Wetter ist heute schön, deshalb gehen wir mit unseren Freunden in den Park.",
    "fr": "Il fait beau aujourd'hui, alors nous irons au parc avec nos amis.",
}


@pytest.fixture(scope="module")
def model():
    wrong = [(TEXT["ru"], "de"), (TEXT["en"], "uk")]  # the second fit drops these
    return langid.fit([(t, k) for k, t in TEXT.items()] * 3 + wrong)


def test_code_has_distance_for_errors():
    c = langid.codewords()
    assert c.shape == (5, 15)
    assert min((c[i] != c[j]).sum() for i in range(5) for j in range(i)) == 8


def test_decoding_corrects_wrong_bits():
    for k in range(5):
        m = langid.CODES[k] * 5.0
        m[[0, 4, 9]] *= -1
        best, lead, conf = langid.decode(m[None])
        assert best[0] == k and lead[0] > 0 and 0 < conf[0] <= 1
    best, lead, _ = langid.decode(np.zeros((1, 15)))
    assert lead[0] == 0  # ambiguous


@pytest.mark.parametrize("k", sorted(TEXT))
def test_held_out_sentences(model, k):
    s = langid.WordScores(model)
    main, conf, _ = langid.passages(HELD_OUT[k], s)
    assert main == k and conf > 0.5
    assert langid.passages(HELD_OUT[k], langid.WordScores(langid.fit([])))[0] == k  # function words alone


def langs(text, model):
    main, _, found = langid.passages(text, langid.WordScores(model))
    return main, langid.languages_of(main, found)


def test_mixed_texts(model):
    two, one = TEXT["de"].split(". ")[0] + ". " + HELD_OUT["de"], HELD_OUT["de"]
    assert langs(TEXT["ru"] + " " + two + " " + TEXT["ru"], model) == ("ru", ["de", "ru"])
    assert langs(TEXT["ru"] + " " + one + " " + TEXT["ru"], model) == ("ru", ["ru"])  # one sentence is not enough
    assert langs(f"{one} {TEXT['ru']} {TEXT['ru']} {one}", model) == ("ru", ["ru"])  # nor are two apart
    assert langs(TEXT["uk"].replace("щоденник", "щоден-\nник"), model) == ("uk", ["uk"])


def test_texts_without_language(model):
    assert langs(None, model) == langs("", model) == langs("12 ; 34 ; 56\n7 ; 8", model) == (None, [])
    assert langs(TEXT["fr"] * 2_000, model)[0] == "fr"


def test_label_codes(spark):
    labels = ["ru", " RU", "ru-RU", "fr_FR", "deu", "ENG", "unknown", "und", "", " ", None, "mk", "\xa0uk"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(langid.label_code(F.col("l"))).collect()] == ["ru", "ru", "ru", "fr", "de", "en", None, None, None, None, None, "mk", "uk"]


def test_records(spark, as_rows):
    docs = [(i, f"p{k}", t, k, 1.0) for i, (k, t) in enumerate(TEXT.items())] + [(10, "pmix", TEXT["ru"] + " " + TEXT["en"], "ru", 0.0), (11, "pnum", "1 2 3", None, 0.0), (12, None, TEXT["ru"], "ru", 0.0), (13, "pnull", None, "ru", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, source_path string, text string, lang string, confidence double")
    rec = [(1, "pru", "rus"), (2, "puk", "ru"), (3, "pen", None), (4, "pde", " DE "), (5, "pfr", "und"), (6, "pmix", "ru"), (7, "pnum", None), (8, "gone", None), (9, "pnull", None), (10, None, None), (11, "puk", "ru")]
    r = spark.createDataFrame(rec, "record_id long, source_path string, language string").withColumn("main", F.lit("x"))
    assert as_rows(langid.mislabelled(langid.record_languages(r, d))) == [(2, "uk"), (3, "en"), (5, "fr"), (6, "en"), (6, "ru"), (11, "uk")]
    assert langid.mislabelled(langid.record_languages(r.limit(0), d.limit(0))).count() == 0


@pytest.mark.parametrize("text", [
    "Muzeum szkolne jest otwarte we wtorki i czwartki. Uczniowie mogą wejść bezpłatnie, jeżeli mają legitymację.",
    "Okul müzesi salı ve perşembe günleri açıktır. Öğrenciler kartları varsa ücretsiz girebilirler.",
    "学校博物馆每周二开放。 学生可以免费入场。 老师讲述城市的历史。",
])
def test_other_languages_are_refused(model, text):
    v = langid.judged(text, langid.WordScores(model))
    assert v.refused and v.ambiguous


@pytest.mark.parametrize("k", sorted(TEXT))
def test_own_languages_are_not_refused(model, k):
    v = langid.judged(TEXT[k], langid.WordScores(model))
    assert not v.refused and not v.ambiguous and v.main == k


def test_cover_is_gapless_and_marks_ambiguity(model):
    text = TEXT["ru"] + " OK. " + TEXT["de"] + "\n\n12 13.\n"
    v = langid.judged(text, langid.WordScores(model))
    assert v.cover[0][0] == 0 and v.cover[-1][1] == len(text)
    assert all(x[1] == y[0] for x, y in zip(v.cover, v.cover[1:], strict=False))
    clear = [c[2] for c in v.cover if not c[4]]
    assert clear == ["ru", "de"] and any(c[4] for c in v.cover)
    half = langid.judged(TEXT["ru"] + " " + TEXT["de"], langid.WordScores(model))
    assert half.ambiguous and half.confidence < 0.6


def test_mixed_refused_text_has_no_row(spark):
    d = spark.createDataFrame([(1, "p", "学校博物馆每周二开放。 学生可以免费入场。", None)], "doc_id long, source_path string, text string, lang string")
    r = spark.createDataFrame([(1, "p", None)], "record_id long, source_path string, language string")
    found = langid.record_languages(r, d)
    assert found.first().refused and langid.mislabelled(found).count() == 0
