"""Scores for abusive, hateful and sexual language: FTRL-proximal logistic regression.

Features are hashed word n-grams: stems, pairs of neighbours, and pairs that skip one or two words,
within a sentence (blank lines end one too); quotation marks count as words, so a quoted insult reads unlike a hurled one. Words are
first undisguised: look-alike letters and figures, masks, spaced or dotted letters, stretched letters.
A document's score per category is that of its worst sentence.

Reviewers label documents, not sentences. So the fit alternates: in each document that reviewers put in a
category the sentence that speaks most for it is taken as the example, all sentences of documents without any such vote
are counterexamples, and the weights are fitted again. Per-coordinate rates and L1 give a small broadcast.

Bounds of the fit: at most ``SAMPLE_DOCS`` labelled and ``BACKGROUND_DOCS`` other documents, of each whole sentences of up to ``FIT_CHARS``
characters, drawn by hash; of their counterexample sentences ``NEGATIVES`` reviewed and half as many unreviewed ones, drawn by seed;
2 ** ``BITS`` weights per category. Scoring has no bound.
Defined results: null or wordless texts score 0; a vote counts where it is not null; a document is an
example where at least half of its votes name the category.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.abuse_seeds import seed_sentences
from tessella.llm.sample import FIT_CHARS, bounded_sample, drawn, fit_text, in_order
from tessella.llm.words import mix, rejoined, visible
from tessella.session import spread

CATEGORIES = ("abusive", "hateful", "sexual")
BITS = 18
SAMPLE_DOCS = 6_000
BACKGROUND_DOCS = 3_000
NEGATIVES = 40_000
THRESHOLD = 0.5
ROUNDS = 3

_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-*_·])[^\W\d_])(?:\1[^\W\d_]){2,}(?![^\W_])")
_TOKEN = re.compile(r"[.!?;…]+(?!\s*[»”\"“.!?;…])|\n[^\S\n]*\n|[«»„“”\"]|[\w@$*]+(?:[!|][\w@$*]+)*")
_END, _QUOTE = frozenset(".!?;…\n"), frozenset("«»„“”\"")
_STRETCHED = re.compile(r"(.)\1{2,}")
_CYR = re.compile(r"[а-яёіїєґ]")
# Look-alikes and figures that stand for letters.
TO_CYRILLIC = str.maketrans("aeopcxykmthbirnu0364@$1!|", "аеорсхукмтнвигпиоебчасііі")
TO_LATIN = str.maketrans("013457@$!|аеорсхукі", "oieastasiiaeopcxyki")


def undisguise(token: str) -> str:
    """The plain word behind a token: one script, no figures, no stretched letters; a masked word keeps its ends."""
    if token.isdigit():
        return "0"
    if "*" in token:
        core = token.strip("*")
        if not core:
            return "*"
        if "*" in core:
            return undisguise(core[0]) + "*" + undisguise(core[-1])
        token = core
    if not token.isalpha() or (_CYR.search(token) and not token.isascii() and re.search("[a-z]", token)):
        letters = sum(ch.isalpha() for ch in token)
        if letters * 2 >= len(token) or "@" in token or "$" in token:
            token = token.translate(TO_CYRILLIC if _CYR.search(token) else TO_LATIN)
    return _STRETCHED.sub(r"\1", token)


class Stems(dict):
    """raw token -> 64-bit hash of its undisguised stem; 0 for the end of a sentence; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        if token[0] in _END:
            h = 0
        else:
            h = xxhash.xxh3_64_intdigest('"' if token[0] in _QUOTE else undisguise(token)[:6])
        self[token] = h
        return h


STEMS = Stems()


def sentence_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Stem hashes and sentence numbers of a text's words."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = rejoined(visible(text)).lower()
    text = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text)
    tokens = _TOKEN.findall(text)
    h = np.fromiter(map(STEMS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    word = h != 0
    return h[word], np.cumsum(~word)[word]


def features(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature index, sentence number) of all n-grams, sorted by sentence."""
    cols, at = [h], [s]
    with np.errstate(over="ignore"):
        for gap in (1, 2, 3):
            if len(h) > gap:
                same = s[gap:] == s[:-gap]
                pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap > 1))
                cols.append(pair[same])
                at.append(s[:-gap][same])
    f, at = np.concatenate(cols), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return (mix(f[order]) >> np.uint64(64 - BITS)).astype(np.int64), at[order]


@dataclass(frozen=True)
class Model:
    """Sparse weights: the feature numbers that L1 left, and their weights per category."""

    index: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros((1 << BITS, len(CATEGORIES)), dtype=np.float32)
        w[self.index] = self.weights
        return w


def sentence_margins(f: np.ndarray, at: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins (sentences, categories) and sentence numbers; features weigh 1 / sqrt(their number)."""
    if not len(f):
        return np.empty((0, len(CATEGORIES))), np.empty(0, np.int64)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    size = np.diff(np.append(start, len(f)))
    return np.add.reduceat(w[f], start, axis=0) / np.sqrt(size)[:, None] + bias, at[start]


class Ftrl:
    """FTRL-proximal for several binary targets over one hashed feature space."""

    def __init__(self, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        shape = ((1 << BITS) + 1, len(CATEGORIES))  # the last row is the bias
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, f: np.ndarray, sent: np.ndarray, size: np.ndarray, y: np.ndarray, importance: np.ndarray) -> None:
        """One batch: ``f`` features of sentences numbered ``sent`` from 0, targets and importances by sentence."""
        rows, inverse = np.unique(f, return_inverse=True)
        w = self.weights(rows)
        scale = 1 / np.sqrt(size)
        margin = np.add.reduceat(w[inverse], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0)
        bias = np.array([1 << BITS])
        p = 1 / (1 + np.exp(-np.clip(margin * scale[:, None] + self.weights(bias), -30, 30)))
        err = (p - y) * importance
        each = (err * scale[:, None])[sent]
        g = np.stack([np.bincount(inverse, each[:, c], len(rows)) for c in range(w.shape[1])], axis=1)
        for r, grad, old in ((rows, g, w), (bias, err.sum(axis=0, keepdims=True), self.weights(bias))):
            n = self.n[r]
            sigma = (np.sqrt(n + grad**2) - np.sqrt(n)) / self.alpha
            self.z[r] += grad - sigma * old
            self.n[r] = n + grad**2

    def model(self) -> Model:
        w = self.weights(np.arange(1 << BITS))
        kept = np.flatnonzero(np.any(w != 0, axis=1))
        return Model(kept, w[kept].astype(np.float32), self.weights(np.array([1 << BITS]))[0])


def _train(sents: list[np.ndarray], y: np.ndarray, importance: np.ndarray, epochs: int = 6, batch: int = 64) -> Model:
    learner, rng = Ftrl(), np.random.default_rng(7)
    size = np.array([len(s) for s in sents])
    for _ in range(epochs):
        order = rng.permutation(len(sents))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            f = np.concatenate([sents[i] for i in part])
            learner.step(f, np.repeat(np.arange(len(part)), size[part]), size[part], y[part], importance[part])
    return learner.model()


def split_sentences(text: str | None) -> list[np.ndarray]:
    f, at = features(*sentence_words(text))
    return np.split(f, np.flatnonzero(at[1:] != at[:-1]) + 1) if len(f) else []


def fit(labelled: list[tuple[str, dict[str, float]]], background: list[str] | None = None, negatives: int = NEGATIVES) -> Model:
    """Fit on (text, share of votes by category), unlabelled background texts and the seed sentences.

    Background sentences are mild counterexamples as long as they do not look like cases, and tell what is ordinary.
    """
    seeds = [(np.concatenate(split_sentences(t) or [np.empty(0, np.int64)]), y) for t, y in seed_sentences()]
    seeds = [(f, y) for f, y in seeds if len(f)]
    docs = [(split_sentences(t), votes) for t, votes in labelled]
    docs = [(s, v) for s, v in docs if s]
    behind = [x for x in map(split_sentences, background or []) if x]
    clean: dict[bytes, np.ndarray] = {}
    for s, v in docs:
        if not any(v.values()):
            for f in s:
                clean.setdefault(f.tobytes(), f)
    clean_list = _drawn(list(clean.values()), negatives)
    mild = {f.tobytes(): f for s in behind for f in s}
    mild_list = _drawn([f for k, f in mild.items() if k not in clean], negatives // 2)
    n_clean = len(clean_list)
    clean_list += mild_list
    base_f = [f for f, _ in seeds] + clean_list
    base_y = np.array([y for _, y in seeds] + [(0, 0, 0)] * len(clean_list), dtype=float)
    odds = _log_odds(docs)
    common = _ordinary(docs, behind)
    # Few seeds of a category weigh more, so that none is drowned by another.
    seed_weight = np.where(base_y[: len(seeds)] > 0, np.clip(300 / np.maximum(base_y[: len(seeds)].sum(axis=0), 1), 1, 5), 1.0)
    model = _train([f for f, _ in seeds], base_y[: len(seeds)], seed_weight, epochs=8)
    for r in range(ROUNDS if labelled else 0):
        w = model.dense()
        extra_f, extra_y, extra_i = [], [], []
        for s, v in docs:
            for c, name in enumerate(CATEGORIES):
                if v.get(name, 0) >= 0.5:
                    margin = np.array([w[f, c].sum() / np.sqrt(len(f)) + model.bias[c] for f in s])
                    lift = np.array([odds[c][f].sum() / len(f) for f in s])
                    value = margin + lift * (4 if r == 0 else 2)
                    kind = np.array([common[c].get(f.tobytes(), 0) for f in s])
                    value[(kind == 2) | (kind == 1) & (margin <= 0)] = -np.inf
                    k = int(value.argmax())
                    if np.isfinite(value[k]) and (margin[k] > -0.5 or r == 0 and lift[k] > 0.4):
                        y, i = np.zeros(3), np.zeros(3)
                        y[c], i[c] = 1, 3.0
                        for o, other in enumerate(CATEGORIES):
                            i[o] = 1.0 if o != c and not v.get(other, 0) else i[o]
                        extra_f.append(s[k])
                        extra_y.append(y)
                        extra_i.append(i)
        importance = np.ones((len(base_f), 3))
        importance[: len(seeds)] = seed_weight
        importance[len(seeds) + n_clean :] = 0.5
        # A counterexample that looks strongly like a case was overlooked by its reviewers, or never reviewed.
        m = np.array([w[f].sum(axis=0) / np.sqrt(len(f)) + model.bias for f in base_f])
        limit = np.full((len(base_f), len(CATEGORIES)), np.inf)
        limit[len(seeds) :] = 0.5 if r else np.inf
        limit[len(seeds) + n_clean :] = -1.0
        limit[[[common[c].get(f.tobytes()) == 2 for c in range(len(CATEGORIES))] for f in base_f]] = np.inf
        importance[m > limit] = 0.0
        y = np.concatenate([base_y, np.array(extra_y).reshape(-1, 3)])
        model = _train(base_f + extra_f, y, np.concatenate([importance, np.array(extra_i).reshape(-1, 3)]))
    return model


def _drawn(items: list, most: int) -> list:
    return items if len(items) <= most else [items[i] for i in np.random.default_rng(3).permutation(len(items))[:most]]


def _ordinary(docs: list, behind: list) -> list[dict]:
    """Per category the sentences of its documents that other documents hold too.

    2: surely ordinary, held by five others or more and not several times as often here; 1: too rare to tell.
    """
    plain, n0 = Counter(), len(behind)
    for s in behind:
        plain.update({f.tobytes() for f in s})
    for s, v in docs:
        if not any(v.values()):
            n0 += 1
            plain.update({f.tobytes() for f in s})
    out = []
    for name in CATEGORIES:
        own, n1 = Counter(), 0
        for s, v in docs:
            if v.get(name, 0) >= 0.5:
                n1 += 1
                own.update({f.tobytes() for f in s})
        # A phrase that only cases hold is 1 / prevalence times as frequent in them as overall.
        bar = min(10.0, max(3.0, 0.5 * len(docs) / max(n1, 1)))
        often = {f for f, n in own.items() if n / n1 >= bar * plain[f] / max(n0, 1)}
        out.append({f: 2 if plain[f] >= 5 and f not in often else 1 for f, n in own.items() if plain[f] and (n < 3 or f not in often)})
    return out


def _log_odds(docs: list) -> list[np.ndarray]:
    """Per category and feature: how much more often documents of the category hold it than others do."""
    out, none = [], np.zeros(1 << BITS)
    n0 = 0
    for s, v in docs:
        if not any(v.values()):
            none[np.unique(np.concatenate(s))] += 1
            n0 += 1
    for name in CATEGORIES:
        have, n1 = np.zeros(1 << BITS), 0
        for s, v in docs:
            if v.get(name, 0) >= 0.5:
                have[np.unique(np.concatenate(s))] += 1
                n1 += 1
        ratio = np.log((have + 0.3) / (n1 + 1)) - np.log((none + 0.3) / (n0 + 1))
        out.append(np.where(have >= 2, np.clip(ratio, 0, 4), 0.0))
    return out


def fit_on(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, background: int = BACKGROUND_DOCS, most_chars: int = FIT_CHARS, negatives: int = NEGATIVES) -> Model:
    """Fit on at most ``most`` labelled and ``background`` other documents, drawn by hash of their id in one read of the documents."""
    voted = labels.where("label is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("votes"), *[F.count_if(F.col("label") == c).alias(c) for c in CATEGORIES])
    voted = bounded_sample(voted, F.col("doc_id"), most)
    texts = docs.select("doc_id", "text", drawn(docs, F.col("doc_id"), background).alias("behind")).join(F.broadcast(voted), "doc_id", "left")
    rows = texts.where(F.col("votes").isNotNull() | F.col("behind")).withColumn("text", fit_text(F.col("text"), most_chars)).collect()
    rows = in_order(rows, "doc_id", "text")
    known = {r["doc_id"] for r in rows if r["votes"]}
    labelled = [(r["text"], {c: r[c] / r["votes"] for c in CATEGORIES}) for r in rows if r["votes"]]
    return fit(labelled, [r["text"] for r in rows if r["behind"] and r["doc_id"] not in known], negatives)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the three scores of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        w = m.dense()
        for pdf in it:
            best = np.full((len(pdf), len(CATEGORIES)), -np.inf)
            for lo in range(0, len(pdf), 256):
                parts = [sentence_words(t) for t in pdf["text"].iloc[lo : lo + 256]]
                # Sentences are numbered through the slice, so its n-grams are hashed and weighed at once.
                first = np.cumsum([0] + [int(s[-1]) + 1 if len(s) else 0 for _, s in parts])
                h = np.concatenate([x[0] for x in parts])
                s = np.concatenate([x[1] + k for x, k in zip(parts, first[:-1], strict=True)])
                margin, number = sentence_margins(*features(h, s), w, m.bias)
                if len(number):
                    doc = np.searchsorted(first, number, side="right") - 1
                    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    best[lo + doc[start]] = np.maximum.reduceat(margin, start, axis=0)
            p = 1 / (1 + np.exp(-best))
            yield pd.DataFrame({c: pdf[c] for c in keep} | {c: p[:, k] for k, c in enumerate(CATEGORIES)})

    return spread(docs.select(*keep, "text")).mapInPandas(run, kinds + "".join(f", {c} double" for c in CATEGORIES))


def flagged(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, category) where the score reaches the threshold."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])).alias("x")
    return scores.select("doc_id", pairs).where(F.col("x.score") >= threshold).select("doc_id", "x.category").distinct()


def source_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, docs, and the share of documents per category and in any); null sources share one row."""
    over = [F.col(c) >= threshold for c in CATEGORIES]
    rate = lambda x: F.avg(x.cast("double"))
    return scores.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), *[rate(o).alias(f"{c}_rate") for c, o in zip(CATEGORIES, over, strict=True)], rate(over[0] | over[1] | over[2]).alias("any_rate")
    )
