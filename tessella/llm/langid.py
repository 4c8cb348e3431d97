"""Document and passage languages by error-correcting output codes.

Every bit of a language's codeword asks one binary question about the text (all 15 ways to part five
languages in two). A bit's classifier is linear in the character n-grams of words, with log-ratio
weights fitted on a bounded sample of labelled documents. Decoding is loss-weighted: the language whose
codeword costs least under the logistic loss of all bits, with a confidence from the costs. A sentence
whose two best codewords lie close is ambiguous: it takes no part in the choice and is marked so. A text most of whose words
stand in sentences that no codeword fits well (less than ``FIT_LEAD`` a word ahead of the next) is in none of the five
languages and is refused (``und``).

The fit repairs its own labels: documents whose decoded language differs from their label are left out
and the weights are fitted again. Bounds of the sample: ``SAMPLE_DOCS`` documents, and ``FIT_CHARS`` characters of whole sentences a document.

Defined results: null text, empty text and text without words of letters (figures only) have no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.sample import FIT_CHARS, bounded_sample, fit_text, in_order
from tessella.llm.words import rejoined, visible
from tessella.session import spread

LANGS = ("ru", "en", "uk", "de", "fr")
SAMPLE_DOCS = 3_000
BITS_LOG2 = 16
NGRAMS = (1, 2, 3, 4)
MARGIN = 2.0
FIT_LEAD = 0.6
UNKNOWN = "und"
FULL_WORDS = 3
# Frequent function words, so that small samples know every language.
COMMON = {
    "ru": "и в не на я что он с как это по но они мы все она так его за был от же из у вы бы к для до если чтобы только или ещё когда уже при этот быть после перед через который которые может где",
    "en": "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up about out many then them these so some her would make like him into time has look two more",
    "uk": "і в не на я що він з як це по але вони ми всі вона так його за був від же із у ви б до для якщо щоб тільки або ще коли вже при цей бути після перед через який які може де та й є її",
    "de": "der die das und in zu den ist nicht von sie mit dem sich des auf für ein eine als auch es an werden aus er hat dass nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man",
    "fr": "le la les de des du et un une est que qui dans en pour pas sur au aux avec ce il elle sont par plus ne se cette à vous nous mais ou son sa ses leur être fait comme tout ont était après avant chaque très bien sans deux",
}
# Three-letter codes of the languages.
THREE = {"rus": "ru", "eng": "en", "ukr": "uk", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr"}
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_SENTENCE = re.compile(r"\S.*?(?:[.!?…]+[»”\"')\]]*(?=\s|\Z)|(?=\n[^\S\n]*\n)|\Z)", re.S)
_ENDED = re.compile(r"[.!?…][»”\"')\]]*\Z")


def codewords() -> np.ndarray:
    """(languages, bits) of +-1: every way to part the languages in two, once."""
    rows = [r for r in product((1, -1), repeat=len(LANGS)) if r[0] == 1 and -1 in r]
    return np.array(rows, dtype=np.float64).T


CODES = codewords()


def ngram_ids(word: str) -> np.ndarray:
    w = f" {word} "
    grams = [w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1) if w[i : i + n] != " "]
    return np.array([xxhash.xxh32_intdigest(g) >> (32 - BITS_LOG2) for g in grams], dtype=np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (2 ** BITS_LOG2, bits)

    def word(self, w: str) -> np.ndarray:
        return np.clip(self.weights[ngram_ids(w)].mean(axis=0) * 2.0, -4, 4)


class WordScores:
    """Bit scores of words, remembered up to ``most`` words."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most, self.index, self.rows = model, most, {}, []
        self.table = np.zeros((0, CODES.shape[1]))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.index, self.rows, self.table = {}, [], self.table[:0]
        index, at = self.index, []
        for w in words:
            k = index.get(w)
            if k is None:
                k = index[w] = len(self.rows)
                self.rows.append(self.model.word(w))
            at.append(k)
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :])])
        return self.table[at]


def decode_costs(margins: np.ndarray) -> np.ndarray:
    """(rows, languages): mean logistic loss of each codeword under the bit margins."""
    return np.logaddexp(0, -margins[:, None, :] * CODES[None]).mean(axis=2)


def decode(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language number, its lead in cost over the next, and confidence, by row of bit margins."""
    cost = decode_costs(margins)
    order = np.argsort(cost, axis=1, kind="stable")
    rows = np.arange(len(cost))
    best = order[:, 0]
    lead = cost[rows, order[:, 1]] - cost[rows, best]
    e = np.exp(cost[rows, best][:, None] - cost)
    return best, lead, 1 / e.sum(axis=1)


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


@dataclass(frozen=True)
class Verdict:
    """Languages of a text. Passages: (start, end, language, confidence, full sentences, words) of clear sentences that stand together;
    cover: (start, end, language, confidence, ambiguous) of stretches that cover the text. Offsets count characters of the visible text
    (NFKC, words joined over line ends)."""

    main: str | None = None
    confidence: float = 0.0
    ambiguous: bool = True
    refused: bool = False
    passages: tuple = ()
    cover: tuple = ()


def judged(text: str | None, scores: WordScores) -> Verdict:
    if not text:
        return Verdict()
    text = rejoined(visible(text))
    spans, words, counts = [], [], []
    for a, b in sentences(text):
        w = _WORD.findall(text[a:b].lower())
        if w:
            spans.append((a, b, bool(_ENDED.search(text, a, b))))
            words += w
            counts.append(len(w))
    if not words:
        return Verdict()
    s = scores.of(words)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    per = np.add.reduceat(s, starts, axis=0)
    best, lead, conf = decode(per)
    n = np.array(counts)
    sure = lead >= MARGIN
    refused = bool(2 * n[lead < FIT_LEAD * n].sum() > n.sum())
    cover: list[list] = []
    for i, (a, b, _) in enumerate(spans):
        if cover and cover[-1][2] == best[i] and cover[-1][4] == (not sure[i]):
            cover[-1][1], cover[-1][3] = b, min(cover[-1][3], float(conf[i]))
        else:
            cover.append([a, b, int(best[i]), float(conf[i]), not sure[i]])
    for x, y in zip(cover, cover[1:], strict=False):
        x[1] = y[0]
    cover[0][0], cover[-1][1] = 0, len(text)
    whole = tuple((a, b, LANGS[k], c, bool(u)) for a, b, k, c, u in cover)
    if not sure.any():
        main, _, c = decode(per.sum(axis=0, keepdims=True))
        return Verdict(LANGS[main[0]], float(c[0]), True, refused, (), whole)
    weight = np.zeros(len(LANGS))
    np.add.at(weight, best[sure], n[sure])
    main = int(weight.argmax())
    out: list[list] = []
    for i, (a, b, ended) in enumerate(spans):
        if not sure[i]:
            continue
        full = int(ended and counts[i] >= FULL_WORDS)
        if out and out[-1][2] == best[i]:
            out[-1][1], out[-1][4], out[-1][5] = b, out[-1][4] + full, out[-1][5] + counts[i]
            out[-1][3] = min(out[-1][3], float(conf[i]))
        else:
            out.append([a, b, int(best[i]), float(conf[i]), full, counts[i]])
    share = float(weight[main] / weight.sum())
    return Verdict(LANGS[main], share, refused or share < 0.6 or 2 * n[sure].sum() < n.sum(), refused, tuple((a, b, LANGS[k], c, f, w) for a, b, k, c, f, w in out), whole)


def passages(text: str | None, scores: WordScores) -> tuple[str | None, float, list[tuple[int, int, str, float, int, int]]]:
    """Main language, its confidence (share of the clear words), and the passages of ``judged``."""
    v = judged(text, scores)
    return v.main, v.confidence, list(v.passages)


def languages_of(main: str | None, found: list[tuple]) -> list[str]:
    """The main language, and each that has two full sentences together."""
    if main is None:
        return []
    return sorted({main} | {p[2] for p in found if p[4] >= 2})


def fit(labelled: list[tuple[str, str]]) -> Model:
    """Weights from (text, language) pairs; pairs that the first fit contradicts are dropped for the second."""
    seeds = [(words, k, 5) for k, words in COMMON.items()]
    model = None
    for _ in range(2):
        kept, scores = [], WordScores(model) if model else None
        for t, k in labelled:
            if scores is None or passages(t, scores)[0] in (k, None):
                kept.append((t, k, 1))
        counts = np.full((len(LANGS), 1 << BITS_LOG2), 0.0)
        grams: dict = {}
        for t, k, times in kept + seeds:
            row = counts[LANGS.index(k)]
            for w in _WORD.findall(visible(t).lower()):
                g = grams.get(w)
                if g is None:
                    g = grams[w] = ngram_ids(w)
                row[g] += times
        alpha = 0.05
        p = (counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * counts.shape[1])
        on = (CODES > 0).astype(float)
        weights = np.log(p.T @ on / on.sum(axis=0)) - np.log(p.T @ (1 - on) / (1 - on).sum(axis=0))
        model = Model(weights.astype(np.float32))
    return model


def label_code(c: Column) -> Column:
    """Two-letter code of a stored label: case, spaces, region and three-letter codes aside; null if missing."""
    base = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"^[\s\x{A0}]*([a-z]+)", 1)
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])[base], base)
    return F.when(~named.isin("", "unknown", "und", "none", "null"), named)


def fit_on(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = SAMPLE_DOCS, most_chars: int = FIT_CHARS) -> Model:
    """Fit on at most ``most`` labelled documents, drawn by hash of their id; of longer texts on whole sentences up to ``most_chars`` characters."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), label_code(F.col(label)).alias("l"))
    rows = bounded_sample(rows.where(F.col("l").isin(*LANGS)), F.col("k"), most)
    found = rows.select("k", fit_text(F.col("t"), most_chars).alias("t"), "l").where("t is not null").collect()
    return fit([(r["t"], r["l"]) for r in in_order(found, "k", "l", "t")])


SEGMENT = "array<struct<start:int,end:int,lang:string,confidence:double,sentences:int,words:int>>"
STRETCH = "array<struct<start:int,end:int,lang:string,confidence:double,ambiguous:boolean>>"


def detected(docs: DataFrame, model: Model, key: str = "source_path", text: str = "text") -> DataFrame:
    """(key, main, confidence, ambiguous, refused, langs, passages, cover) of each row; see ``Verdict``. A refused text has no ``langs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for pdf in it:
            out = [judged(t, scores) for t in pdf[text]]
            names, places = ("start", "end", "lang", "confidence", "sentences", "words"), ("start", "end", "lang", "confidence", "ambiguous")
            listed = {
                "langs": [[] if v.refused else languages_of(v.main, v.passages) for v in out],
                "passages": [[dict(zip(names, p, strict=True)) for p in v.passages] for v in out],
                "cover": [[dict(zip(places, p, strict=True)) for p in v.cover] if len({c[2] for c in v.cover}) > 1 else [] for v in out],
            }
            yield pd.DataFrame({key: pdf[key]} | {c: [getattr(v, c) for v in out] for c in ("main", "confidence", "ambiguous", "refused")} | listed)

    return spread(docs.select(key, text)).mapInPandas(run, f"`{key}` {kind}, main string, confidence double, ambiguous boolean, refused boolean, langs array<string>, passages {SEGMENT}, cover {STRETCH}")


def record_languages(records: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per record of a document: record_id, stored label, and the columns of ``detected``."""
    docs = docs.where("source_path is not null")
    found = detected(docs, fit_on(docs))
    return records.select("record_id", "source_path", label_code(F.col("language")).alias("stored")).join(found, "source_path").drop("source_path")


def mislabelled(found: DataFrame) -> DataFrame:
    """(record_id, lang_code) of records whose label is missing or wrong, or whose text is mixed; texts in none of the languages have no row."""
    case = F.col("main").isNotNull() & ~F.col("refused") & (F.col("stored").isNull() | (F.col("stored") != F.col("main")) | (F.size("langs") > 1))
    return found.where(case).select("record_id", F.explode("langs").alias("lang_code")).distinct()
