import pytest

from tessella.llm import pairs
from tessella.llm.pairs import defects_of


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        ("Где музей?", None, ["empty"]),
        ("Где музей?", "", ["empty"]),
        ("Где музей?", " ​ \xa0", ["empty"]),
        ("Где музей?", "<br>&nbsp;", ["empty"]),
        ("Где музей?", "TODO", ["empty"]),
        ("Где музей?", "N/A", ["empty"]),
        ("Где музей?", "Ответ:", ["empty"]),
        ("Где музей?", "Где  музей ?", ["copies_question"]),
        ("Где музей?", "Ответ: где музей? ГДЕ МУЗЕЙ", ["copies_question"]),
        ("Где музей?", "Где музей? Он стоит у реки.", []),
        ("Сколько занятий в курсе?", "12 занятий", []),
        ("Сколько занятий в курсе?", "Да, бесплатно", []),
        ("Сколько занятий в курсе?", "1) рисуют схему\n2) строят график", []),
        ("Сколько занятий в курсе?", "Подробности на сайте. https://portal.example/p/1", []),
        ("Сколько занятий в курсе?", "В курсе двенадцать занятий, и каждое из", ["truncated"]),
        ("Сколько занятий в курсе?", "В курсе двенадцать занятий. Каждое из них разви", ["truncated"]),
        ("Сколько занятий в курсе?", "В курсе (см. программу двенадцать занятий.", ["truncated"]),
        ("Сколько занятий в курсе?", "К сожалению, я не могу ответить на этот вопрос.", ["refusal"]),
        ("Сколько занятий в курсе?", "Данных нет. Попробуйте обратиться к координатору.", ["refusal"]),
        ("Сколько занятий в курсе?", "К сожалению, точных данных нет, но в прошлом году курс занимал двенадцать часов.", []),
        ("Сколько занятий в курсе?", "Участники, которые не могут приехать, получают запись.", []),
        ("How long is the course?", "I am unable to help with this request.", ["refusal"]),
        ("How long is the course?", "Those who cannot travel get a recording.", []),
        ("Wie lange dauert der Kurs?", "Leider liegen mir dazu keine Angaben vor.", ["refusal"]),
        ("Combien de temps dure le cours ?", "Désolé, je ne peux pas répondre.", ["refusal"]),
        ("Скільки триває курс?", "На жаль, я не можу відповісти на це питання.", ["refusal"]),
        ("Сколько длится курс?", "The course takes twelve hours in the spring.", ["other_language"]),
        ("Сколько длится курс?", "Sorry, I cannot answer.", ["refusal", "other_language"]),
        ("Переведите на английский: курс открыт.", "The course is open.", []),
        ("What is the course for?", "Der Kurs ist für die Eltern und die Kinder, die nicht in der Stadt sind.", ["other_language"]),
        (None, "Курс открыт.", []),
        ("How long is the spring course?", "How long is the spring", ["copies_question", "truncated"]),
        ("How long is the spring course?", "Answer: how long is the spring course (", ["copies_question", "truncated"]),
        ("Музей открыт по вторникам или по средам?", "Музей открыт по вторникам.", []),
        ("How long is the course?", "How long is the course? It takes", ["truncated"]),
        ("Why did the king write to the school?", "The king asked the school for its pardon and he got it from them.", []),
        ("Pourquoi ?", "Pardon, je ne sais pas.", ["refusal"]),
    ],
)
def test_rules(question, answer, want):
    assert defects_of(question, answer) == want


def test_long_text():
    assert defects_of("Где музей?", "Музей стоит у реки. " * 20_000) == []


def test_frame_with_clashing_columns_repeats_and_empty(spark, as_rows):
    df = spark.createDataFrame([(1, "Где музей?", None, "x"), (2, None, "Музей у реки.", "y"), (3, "Где музей?", "Где музей?", None)], "id long, question string, answer string, q string")
    df = df.withColumn("a", df.id).withColumn("row_id", df.id).withColumn("defect", df.q)
    assert as_rows(pairs.pair_defects(df.unionByName(df), "id", "question", "answer")) == [(1, "empty"), (3, "copies_question")]
    assert pairs.pair_defects(df.limit(0), "id", "question", "answer").count() == 0


def test_long_texts_bring_whole_sentences_to_the_fit():
    from tessella.llm.sample import drawn_passages

    text = " ".join(f"Sentence number {i} stands here." for i in range(1_000))
    got = drawn_passages(text, 3_000)
    assert 2_800 < len(got) <= 3_200 and set(got.split("\n")) <= {f"Sentence number {i} stands here." for i in range(1_000)}
    assert any(int(x.split()[2]) > 900 for x in got.split("\n")) and got == drawn_passages(text, 3_000)
    assert drawn_passages(None, 5) is None and drawn_passages("short", 5) == "short" and drawn_passages("x" * 10, 5) == ""
