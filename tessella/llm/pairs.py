"""Defects of question-answer pairs by ordered rules.

The rules run in this order, and every one that applies is reported:

1. ``empty``: null, or nothing but spaces, marks, markup, an introducing word or a placeholder. Nothing is left for other rules.
2. ``copies_question``: after an introducing word, nothing but the question's words, once or more, or its beginning (three words and
   ``PREFIX`` of it at least) that breaks off. A copy's words are the question's, so of the other rules only truncation applies:
   to a cut copy, and to a whole one that leaves a delimiter unclosed; its end mark doesn't matter.
3. ``truncated``: an unclosed delimiter or code fence at the end, an abrupt ending (joining mark, dash, ellipsis,
   dangling conjunction or preposition), or a last sentence without end mark that is not a short fact, list or link.
4. ``refusal``: some sentence refuses or reports missing information and no other sentence gives an answer.
5. ``other_language``: the answer's script, or within a script its language, differ from the question's,
   unless the question asks for a translation or names an answer language. Within a script the language is
   told by n-gram classifiers that are fitted on at most ``SAMPLE_PAIRS`` of the pairs themselves, which
   function words and letters label where they are clear; without such a model those words decide alone.

Phrase rules are stems of refusing in five languages, not a list of whole sentences; a sentence is held against those of its
own script, and within the Latin script of the answer's language where that is clear.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.langid import COMMON, LANGS, Model, WordScores, decode_costs, fit
from tessella.llm.sample import FIT_CHARS, bounded_sample, fit_text, in_order
from tessella.llm.words import WORDS, visible
from tessella.session import spread

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")
SHORT_FACT_WORDS = 7
SAMPLE_PAIRS = 4_000
LEAD = 0.6
PREFIX = 0.6

# Placeholders that stand for no answer.
PLACEHOLDERS = {
    "null", "none", "nan", "nil", "na", "n a", "todo", "tbd", "fixme", "undefined", "empty", "blank", "placeholder", "no answer", "lorem ipsum", "test", "xxx",
    "пусто", "нет ответа", "ответ отсутствует", "без ответа", "заглушка", "немає відповіді", "порожньо", "keine antwort", "leer", "k a", "pas de réponse", "vide", "sans réponse",
}
# Words that introduce an answer or a repeated question.
INTRODUCING = {
    "ответ", "вопрос", "коротко", "итак", "да", "нет", "вы", "ваш", "спросили", "спрашиваете", "вот", "что", "известно", "по", "материалам", "портала", "хорошо", "отвечаю",
    "відповідь", "питання", "запитання", "отже", "так", "ні", "ви", "запитали", "ось", "відомо", "за", "матеріалами", "порталу",
    "answer", "question", "q", "a", "in", "short", "well", "so", "yes", "no", "you", "asked", "here", "is", "what", "we", "know", "the", "your", "was", "according", "to", "materials",
    "antwort", "frage", "kurz", "also", "ja", "nein", "gesagt", "laut", "unterlagen", "sie", "fragten",
    "réponse", "question", "bref", "donc", "oui", "non", "vous", "demandez", "selon", "les", "documents", "en",
}

_MARKUP = re.compile(r"<[^<>]*>|&[a-zA-Z#0-9]+;|```|!?\[\]\([^)]*\)")
_SENTENCE = re.compile(r"\S.*?(?:[.!?…]+[»”\"')\]]*(?=\s|\Z)|(?=\n)|\Z)", re.S)
_LIST = re.compile(r"\s*(?:[-*•–—·]|\(?\d{1,3}[.)]|[a-zа-яіїєґ]\))\s+\S", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S+\Z", re.I)
_ABRUPT = re.compile(r"(?:[,;:(\[{«„“‘/&+=\-–—‑…]|\.\.\.)\Z")
_END = re.compile(r"[.!?。][»”“\"'’)\]*_`]*\Z")
_CYRILLIC, _LATIN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[A-Za-zÀ-ɏ]")
_QUOTED = re.compile(r"«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|\"[^\"\n]*\"|https?://\S+")
# Conjunctions, prepositions and articles that cannot end an answer.
DANGLING = set(
    "и а но или что чтобы как который которая которое которые в во на с со к ко о об от до для по при за из у без под над между через если когда потому так "
    "і й та або але що щоб як який яка яке які у в на з із зі до від для по при за без під над між через якщо коли бо "
    "and or but that which who the a an of to in on at for with by from as if when because than into "
    "und oder aber dass der die das den dem des ein eine einen einem einer in im an am auf mit von zu zum zur für bei nach aus als wenn weil "
    "et ou mais que qui le la les un une des du de à au aux en dans sur pour avec par sans comme si quand car".split()
)
# Stems by which an answer refuses or reports that it has no information, by language.
_STEMS = {
    "ru": r"""
        (?:не\s+(?:с?мо(?:гу|жем)|(?:в\s+)?(?:состоянии|силах)|получится|удастся|представляется\s+возможным|имею|имеем|располага\w+|вправе|готов\w*|берусь|стану|буду|знаю|знаем|владе\w+|обладаю|умею|нашл\w+|найден\w*|могу|уполномоч\w+|облада\w+))
        |(?:отве(?:тить|та)|помочь|сказать|обсуждать|сообщить|подсказать|комментировать)[\s\w]{0,25}\s(?:не\s+(?:могу|можем|получится|удастся|буду|стану|готов\w*)|невозможно|нельзя)
        |воздерж\w+|отказыва\w+|вынужден\w*\s+отказать|затрудня\w+|бессил\w+|увы\b|к\s+сожалению|извините|простите|прошу\s+прощения|сожалею
        |выходит\s+за\s+(?:рамки|пределы)|вне\s+моей\s+компетенции|языков\w+\s+модел\w+|как\s+(?:ии|искусственн\w+\s+интеллект)
        |(?:нет|отсутству\w+|недостаточно|не\s+хватает|не\s+содерж\w+|не\s+найден\w*|не\s+обнаружен\w*|мало)\s+(?:\w+\s+){0,4}(?:информаци\w+|данных|сведени\w+|контекст\w*|ответа|материал\w*|документ\w*)
        |(?:информаци\w+|данны\w+|сведени\w+|ответ\w*|документ\w*)\s+(?:\w+\s+){0,6}(?:нет\b|отсутству\w+|недостаточно|не\s+(?:найден|обнаружен|содерж|указан|передал|предостав|сказан)\w*)
        |(?:ничего|об\s+этом)\s+(?:\w+\s+){0,4}не\s+(?:сказан|найден|указан|говорит|сообща|известн)\w*|мне\s+(?:это\s+)?не\s*известн\w+|данных\s+нет
        """,
    "uk": r"""
        не\s+мож(?:у|емо)|не\s+вда(?:сться|лося)|не\s+маю|не\s+маємо|не\s+знаю|не\s+володі\w+|не\s+зможу|утрима\w+\s+від|утримаюсь|відмовля\w+|на\s+жаль|вибачте|перепрошую|пробачте|мовн\w+\s+модел\w+|поза\s+межами|виходить\s+за\s+межі|безсил\w+
        |(?:немає|нема|бракує|недостатньо|відсутн\w+|не\s+містят\w*|не\s+знайден\w*)\s+(?:\w+\s+){0,4}(?:інформаці\w+|даних|відомост\w+|матеріал\w*|відповіді)
        |(?:інформаці\w+|дан\w+|відомост\w+)\s+(?:\w+\s+){0,6}(?:немає|нема|відсутн\w+|не\s+(?:знайден|містят|вказан)\w*)
        """,
    "en": r"""
        \b(?:i|we)\s*(?:'m|\s+am|\s+are|'re|\s+was)?\s*(?:really\s+|very\s+|so\s+)?(?:sorry|afraid|unable|not\s+(?:able|allowed|permitted|sure|aware|in\s+a\s+position))
        |\b(?:i|we)\s+(?:can\s*not|can't|could\s*n[o']t|could\s+not|do\s+not|don't|won't|will\s+not|must\s+decline|have\s+(?:no|to\s+decline)|would\s+rather\s+not|prefer\s+not|decline|lack|refuse|am\s+not)
        |\bso\s+i\s+can't|(?:^|\W)sorry\b|unfortunately|apolog\w+|language\s+model|as\s+an\s+ai\b|beyond\s+(?:what\s+i|my|the\s+scope)|outside\s+(?:my|the\s+scope)
        |(?:no|not\s+enough|insufficient|lacks?|without)\s+(?:\w+\s+){0,3}(?:information|data|details|evidence|passages?|sources?|documents?|context)\b
        |(?:information|data|details|context|documents?|materials?|sources?|passages?)\s+(?:\w+\s+){0,5}(?:not|n't|no)\s+(?:\w+\s+){0,2}(?:available|found|contain\w*|mention\w*|provided|include\w*|given|say\w*|cover\w*|enough)
        |(?:does|do|did)\s*(?:n't|\s+not)\s+(?:contain|mention|include|cover|provide|say)|cannot\s+(?:be\s+)?(?:answer\w*|help|assist|provide|say)|unable\s+to|not\s+comment
        """,
    "de": r"""
        leider|bedaure|bedauere|entschuldig\w+|verzeihung|tut\s+mir\s+leid|sprachmodell|kann\s+(?:ich|dazu|hierzu|das|diese)\s+(?:\w+\s+){0,5}nicht|ich\s+(?:kann|darf|möchte|weiß|habe|will|werde)\s+(?:\w+\s+){0,6}(?:nicht|keine?n?\b)|nicht\s+beantwort\w*|weigere
        |(?:keine?r?l?e?i?|nicht\s+genügend|nicht\s+genug|unzureichende?)\s+(?:\w+\s+){0,3}(?:angaben|informationen?|daten|auskunft|antwort|hinweise|unterlagen|kenntnis\w*)|liegen\s+mir\s+(?:\w+\s+){0,3}(?:keine|nicht)|außerhalb\s+meine\w+|übersteigt\s+mein\w+
        """,
    "fr": r"""
        désolée?s?|navrée?s?|malheureusement|je\s+regrette|excusez|pardon|mod[èe]le\s+de\s+langage|je\s+(?:ne|n')\s*(?:\w+\s+){0,3}(?:pas|aucune?|rien)|je\s+n['’]\w+\s+(?:pas|aucune?)|impossible\s+de|m['’]abstien\w*|je\s+préfère\s+ne|dépasse\s+mes|hors\s+de\s+m\w+
        |(?:aucune?|pas\s+(?:d['’]|de\s+|assez\s+d['’]\s*|assez\s+de\s+|suffisamment\s+d['’]\s*))\s*(?:information|donnée|réponse|élément|précision|renseignement|document|passage|indication)s?
        |(?:contexte|documents?|sources?|matériaux|textes?)\s+(?:\w+\s+){0,3}ne\s+(?:\w+\s+){0,3}(?:pas|rien|aucun)
        """,
}
REFUSING = {k: re.compile(v, re.X | re.I) for k, v in _STEMS.items()}
# Filler around a refusal that is not itself an answer.
FILLER = re.compile(
    r"""
    попробуйте|обратитесь|уточните|переформулир|свяжитесь|напишите|задайте|спросите|рекомендую\s+обратиться|спасибо|пожалуйста,\s+(?:уточ|перефор|обрат|задай)|надеюсь\s+на\s+понимание|благодарю|чем\s+ещё\s+могу
    |спробуйте|зверніться|уточніть|переформулю|зв['’]яжіться|напишіть|поставте\s+(?:інше|питання)|запитайте|дякую|будь\s+ласка
    |\btry\b|please\b|contact\b|rephras|reach\s+out|ask\s+(?:the|a|your|another|me)|write\s+to|thank|let\s+me\s+know|is\s+there\s+anything
    |bitte|versuchen\s+sie|wenden\s+sie|formulieren\s+sie|fragen\s+sie|danke|kontaktieren
    |essayez|veuillez|merci|contactez|reformulez|adressez|consultez|demandez
    """,
    re.X | re.I,
)
_LEAD_IN = re.compile(r"^\W*(?:ответ|коротко|итак|вот\s+что\s+известно|по\s+материалам\s+портала|відповідь|коротко|ось\s+що\s+відомо|за\s+матеріалами\s+порталу|answer|in\s+short|here\s+is\s+what\s+we\s+know|according\s+to\s+the\s+materials|antwort|kurz(?:\s+gesagt)?|laut\s+unterlagen|réponse|en\s+bref|selon\s+les\s+documents)\s*[:.\-–—]*\s*", re.I)
# Ways to ask for an answer in some language.
ASKS_LANGUAGE = re.compile(
    r"перевед\w*|перевес\w*|перевод\w*|переклад\w*|перекла[вс]\w*|translat\w*|übersetz\w*|tradui\w*|traduct\w*"
    r"|по-?\s?(?:английски|немецки|французски|украински|русски)|(?:^|\W)на\s+(?:английском|немецком|французском|украинском|русском|английский|немецкий|французский|украинский|русский)\b"
    r"|(?:англійською|німецькою|французькою|українською|російською)|\bin\s+(?:english|german|french|ukrainian|russian)\b|auf\s+(?:englisch|deutsch|französisch|ukrainisch|russisch)\b|en\s+(?:anglais|allemand|français|ukrainien|russe)\b",
    re.I,
)
_COMMON = {k: set(v.split()) for k, v in COMMON.items()}
# Letters that belong to one language of a script.
_LETTERS = {"ru": re.compile("[ыэъё]"), "uk": re.compile("[іїєґ]"), "de": re.compile("[äöüß]"), "fr": re.compile("[éèêàçùûîôœ]")}
_SCRIPTS = {"cyrillic": ("ru", "uk"), "latin": ("en", "de", "fr")}


def script_of(text: str) -> str | None:
    """The script of at least 70 % of the letters; quoted names and links aside where enough remains."""
    rest = _QUOTED.sub(" ", text)
    rest = rest if sum(map(len, WORDS.findall(rest))) >= 8 else text
    c, l = len(_CYRILLIC.findall(rest)), len(_LATIN.findall(rest))
    if c + l < 4:
        return None
    return "cyrillic" if c >= 0.7 * (c + l) else "latin" if l >= 0.7 * (c + l) else None


def language_of(text: str, script: str) -> str | None:
    """Language within a script by function words and letters; None without a clear lead."""
    rest = _QUOTED.sub(" ", text).lower()
    words = WORDS.findall(rest)
    score = {}
    for k in _SCRIPTS[script]:
        own = _LETTERS.get(k)
        score[k] = sum(w in _COMMON[k] for w in words) + (2 * len(own.findall(rest)) / 3 if own else 0)
    order = sorted(score, key=score.get, reverse=True)
    return order[0] if score[order[0]] >= 2 and score[order[0]] >= 1.7 * score[order[1]] + 1 else None


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = visible(_MARKUP.sub(" ", answer))
    words = WORDS.findall(text.lower())
    return not words or " ".join(words) in PLACEHOLDERS or not WORDS.search(_LEAD_IN.sub("", text))


def cut_copy(question: str | None, answer: str) -> bool:
    """After introducing words, the beginning of the question, broken off."""
    q, a = (WORDS.findall(visible(t or "").lower()) for t in (question, answer))
    if _END.search(visible(answer).strip()):
        return False
    for lead in range(len(a)):
        k = len(a) - lead
        if 3 <= k < len(q) and k >= PREFIX * len(q) and a[lead:] == q[:k]:
            return True
        if a[lead] not in INTRODUCING:
            return False
    return False


def copies_question(question: str | None, answer: str) -> bool:
    q, a = (WORDS.findall(visible(t or "").lower()) for t in (question, answer))
    if not q or len(a) < len(q):
        return False
    n = len(a) % len(q)
    lead, rest = a[:n], a[n:]
    return rest == q * (len(rest) // len(q)) and all(w in INTRODUCING for w in lead) or _interleaved(q, a)


def _interleaved(q: list[str], a: list[str]) -> bool:
    """Repetitions of the question, each perhaps with introducing words before it."""
    i, found = 0, 0
    while i < len(a):
        if a[i : i + len(q)] == q:
            i, found = i + len(q), found + 1
        elif a[i] in INTRODUCING:
            i += 1
        else:
            return False
    return found > 0


def _unclosed(text: str) -> bool:
    """An opening delimiter without its end; list marks such as '1)' and unpaired closers don't count."""
    if text.count("```") % 2:
        return True
    for opening, closing in (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("„", "“")):
        depth = 0
        for ch in text:
            if ch == opening:
                depth += 1
            elif depth and (ch == closing or (opening == "„" and ch == "”")):
                depth -= 1
        if depth:
            return True
    rest = re.sub("„[^“”]*[“”]", "", text)
    return rest.count("“") > rest.count("”")


def is_truncated(answer: str) -> bool:
    text = visible(answer).strip().strip("​")
    if _unclosed(text) or _ABRUPT.search(text):
        return True
    if _END.search(text) or _LINK.search(text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1]
    words = WORDS.findall(last.lower())
    if words and words[-1] in DANGLING:
        return True
    if _LIST.match(last):
        return False
    body = _LEAD_IN.sub("", text)
    sents = [m.group() for m in _SENTENCE.finditer(body)]
    ended = [s for s in sents[:-1] if _END.search(s.strip()) and len(WORDS.findall(s)) > 1]
    if ended or len(lines) > 1 and any(_END.search(x.strip()) for x in lines[:-1]):
        return True
    return not _short_fact(body)


# How a bare fact without a verb begins.
_FACT = re.compile(
    r"^\W*(?:\d|да\b|нет\b|только|бесплатно|платно|с\s+\d|до\s|от\s+\d|так\b|ні\b|лише|тільки|безкоштовно|з\s+\d|yes\b|no\b|only|free|from\s+\d|until|ja\b|nein\b|nur|kostenlos|ab\s+\d|von\s+\d|bis|oui\b|non\b|seulement|uniquement|gratuit|de\s+\d|du\s+\d|à\s+partir)", re.I
)


def _short_fact(body: str) -> bool:
    n = len(WORDS.findall(body))
    return n <= 3 or n <= SHORT_FACT_WORDS and bool(_FACT.match(body))


def _languages_of(text: str, scores: WordScores | None) -> tuple[str, ...]:
    """The languages whose refusals the text can hold: those of its script, within the Latin script the one it is clearly in."""
    script = script_of(text)
    if script is None:
        return LANGS
    told = _told(text, script, scores) if script == "latin" else None
    return (told,) if told else _SCRIPTS[script]


def is_refusal(answer: str, scores: WordScores | None = None) -> bool:
    """Some sentence refuses, and every other is filler or an introduction."""
    body = _LEAD_IN.sub("", visible(answer).replace("’", "'"))
    refused, langs = False, None
    for m in _SENTENCE.finditer(body):
        s = m.group()
        if not WORDS.search(s):
            continue
        langs = langs or _languages_of(body, scores)
        if _refusing(s, langs):
            refused = True
        elif not FILLER.search(s):
            return False
    return refused


# Who speaks or what is missing; without one of these a negation says something about the subject.
_SPEAKER = re.compile(
    r"\b(?:я|мне|мной|меня|мы|нам|нас|моих|моей|мені|мене|ми|моїх|i|me|my|we|us|our|ich|mir|mich|wir|uns|mein\w*|je|j|me|nous|mes|mon)\b|\bi'|j'"
    r"|(?:могу|располагаю|имею|знаю|буду|воздерж\w+|отказываюсь|затрудня\w+|можу|маю|відмовля\w+|утрима\w+)\b"
    r"|(?:информаци|данны|данных|сведени|ответ|документ|контекст|фрагмент|материал|модел|запрос|вопрос|інформаці|відомост|даних|матеріал|відповід|питанн|запит|information|data|details|context|passage|source|document|answer|request|question|model|angaben|informationen|daten|auskunft|frage|unterlagen|antwort|donnée|réponse|élément|contexte|précision|renseignement|requête)", re.I
)


_BUT = re.compile(r"[,;:–—]\s*(?:но|однако|зато|але|проте|but|however|yet|aber|jedoch|mais|cependant)\s", re.I)


def _refusing(sentence: str, langs: tuple[str, ...] = LANGS) -> bool:
    """A refusal that no contrast turns into an answer ("..., but the course takes 12 hours")."""
    refuses = lambda t: any(REFUSING[k].search(t) for k in langs)
    s = _QUOTED.sub(" ", sentence)
    if not (refuses(s) and _SPEAKER.search(s)):
        return False
    tail = _BUT.split(sentence)[1:]
    return not tail or len(WORDS.findall(tail[-1])) < 4 or bool(refuses(tail[-1]) or FILLER.search(tail[-1]))


def _told(text: str, script: str, scores: WordScores | None) -> str | None:
    """Language within the script, by the fitted classifiers where there are any."""
    if scores is None:
        return language_of(text, script)
    words = WORDS.findall(_QUOTED.sub(" ", text).lower())
    words = [w for w in words if w.isalpha()]
    if not words:
        return None
    cost = decode_costs(scores.of(words).sum(axis=0, keepdims=True))[0]
    order = sorted(_SCRIPTS[script], key=lambda k: cost[LANGS.index(k)])
    return order[0] if cost[LANGS.index(order[1])] - cost[LANGS.index(order[0])] >= LEAD else None


def other_language(question: str | None, answer: str, scores: WordScores | None = None) -> bool:
    question = visible(question or "")
    if ASKS_LANGUAGE.search(_QUOTED.sub(" ", question)):
        return False
    answer = _LEAD_IN.sub("", visible(answer))
    a, q = script_of(answer), script_of(question)
    if a is None or q is None:
        return False
    if a != q:
        return True
    la, lq = _told(answer, a, scores), _told(question, q, scores)
    return la is not None and lq is not None and la != lq


def defects_of(question: str | None, answer: str | None, scores: WordScores | None = None) -> list[str]:
    if is_empty(answer):
        return ["empty"]
    text = visible(answer).strip()
    if copies_question(question, answer):
        return ["copies_question"] + ["truncated"] * (_unclosed(text) and not _unclosed(visible(question)))
    if cut_copy(question, answer):
        return ["copies_question", "truncated"]
    found = []
    if is_truncated(answer):
        found.append("truncated")
    if is_refusal(answer, scores):
        found.append("refusal")
    if other_language(question, answer, scores):
        found.append("other_language")
    return found


def fit_on_pairs(pairs: DataFrame, most: int = SAMPLE_PAIRS, most_chars: int = FIT_CHARS) -> Model:
    """n-gram classifiers from (q, a) rows whose function words and letters tell the language clearly."""
    cols = [fit_text(F.col(c), most_chars).alias(c) for c in ("q", "a")]
    sample = bounded_sample(pairs, F.xxhash64("row_id", "q"), most).where("q is not null and a is not null").select("row_id", *cols).collect()
    labelled = []
    for r in in_order(sample, "row_id", "q", "a"):
        text = _QUOTED.sub(" ", visible(f"{r['q']} {r['a']}"))
        script = script_of(text)
        told = language_of(text, script) if script else None
        if told:
            labelled.append((text, told))
    return fit(labelled)


def pair_defects(df: DataFrame, row_id: str, question: str, answer: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep`` columns, row_id, defect): one row per row of ``df`` and defect; rows without defect give none."""
    pairs = df.select(*keep, F.col(row_id).cast("bigint").alias("row_id"), F.col(question).alias("q"), F.col(answer).alias("a"))
    model = df.sparkSession.sparkContext.broadcast(fit_on_pairs(pairs))  # fixed size

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def defects(question: pd.Series, answer: pd.Series) -> pd.Series:
        scores, seen, out = WordScores(model.value), {}, []
        for pair in zip(question, answer, strict=True):
            if pair not in seen:
                seen[pair] = defects_of(*pair, scores)
            out.append(seen[pair])
        return pd.Series(out)

    return spread(pairs).select(*keep, "row_id", F.explode(defects("q", "a")).alias("defect")).distinct()
