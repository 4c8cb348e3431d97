"""Main content of web pages: a recurrent block labeller in numpy.

A page's leaves are its non-blank lines. A line is read as the mean of learned vectors of its hashed words
and a role vector. Pages come as plain text, so the tag path is not there to read; the role vector stands for
it: what a tag path would say (title, heading, list item, menu row, prose, wrapped prose), told from the
page's own title and headings, marks, separators, length, ending, blank lines and place. Two LSTMs run over
the lines in both directions, so each line is judged by the whole page, and a logistic layer labels it.

The network is fitted where it is used, on at most ``SAMPLE_PAGES`` whole pages (pages of more than ``FIT_CHARS`` characters are left out
of the fit), with labels that the pages themselves give (``weak_labels``): title, headings, list items and prose are content; lines that
recur over sites, menus, breadcrumbs and lines of no content role are not; doubtful lines take no part. How often a line recurs
is counted over all pages (``recurrence``), for the keys of the sample.
The labels use recurrence, which the network never sees, so it must learn what such lines look like.

Defined results: null or blank text has no lines; a repeated line is judged at each place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.sample import FIT_CHARS, bounded_sample, in_order
from tessella.llm.words import WORDS
from tessella.session import spread

SAMPLE_PAGES = 2_500
EMBED, HIDDEN, VOCABULARY = 16, 24, 1 << 13
EPOCHS, BATCH, RATE = 9, 32, 0.01
THRESHOLD = 0.5

_BULLET = re.compile(r"(?:[-*•–—▪‣·]|\(?\d{1,2}[.)]|[a-zа-я]\))\s+\S", re.I)
_MARK = re.compile(r"\A(?:[-*•–—▪‣·]|\(?\d{1,2}[.)])\s+")
_INNER_END = re.compile(r"[.!?…][»”\"')\]]*\s+[«„“\"(]?[A-ZА-ЯЁІЇЄҐÀ-ÖØ-Þ]")
_SEPARATOR = re.compile(r"\s[|·•»›>/→]\s|\s[|·•»›→]|[|·»›→]\s")
_CONTACT = re.compile(r"\S@\S+\.\S|\+?\d[\d\s()\-]{6,}\d")
_URL = re.compile(r"https?://|www\.|={4,}", re.I)
_DATE = re.compile(r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d{2}\b|\b(?:19|20)\d\d\b")
_QUOTED = re.compile(r"«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|\"[^\"]*\"")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d+")
_ENDED = re.compile(r"[.!?…][»”\"')\]]*\Z")
# Words that mark furniture in the weak labels (stems).
FURNITURE = re.compile(
    r"cookie|куки|©|\(c\)|copyright|права\s+защищ|rights\s+reserved|подпи(?:сат|шит)|subscribe|newsletter|рассылк|реклам|спонсор|партн[её]рский\s+материал|advert|sponsor|anzeige|werbung|publicité|скидк|rabatt|remise"
    r"|комментар|comment|kommentar|просмотр(?:ов|ы)|views|поделит|расскажите|share|teilen|partag|распечат|drucken|imprimer|наверх|to\s+top|nach\s+oben|haut\s+de\s+page|политик|privacy|datenschutz|confidentialit|конфиденц"
    r"|e-?mail|телефон|telefon|téléphone|phone|опубликован|обновлен|published|updated|veröffentlicht|publié|время\s+чтения|reading\s+time|lesezeit|читайте\s+также|похожие|популярн|свежие|see\s+also|related|related|автор:|фото:|photo|foto",
    re.I,
)
_words: dict[str, int] = {}


def word_id(word: str) -> int:
    word = "0" if word.isdigit() else word
    k = _words.get(word)
    if k is None:
        if len(_words) > 300_000:
            _words.clear()
        k = _words[word] = xxhash.xxh32_intdigest(word) & (VOCABULARY - 1)
    return k


def _flat(s: str | None) -> str:
    return " ".join(s.split()).lower() if s else ""


def leaves(text: str | None) -> list[tuple[int, str, bool, bool]]:
    """(line number from 1, stripped line, blank before, blank after) of the non-blank lines."""
    if not text:
        return []
    lines = [x.strip() for x in text.split("\n")]
    n = len(lines)
    return [(i + 1, s, i > 0 and not lines[i - 1], i + 1 < n and not lines[i + 1]) for i, s in enumerate(lines) if s]


ROLE_NAMES = 38
OWN = 22  # the first roles depend on the line alone


class Facts(dict):
    """line -> (own roles, number of words, word ids, text in lower case and single spaces, ended, separators); bounded.

    Furniture recurs, so about half of all lines are looked up.
    """

    def __missing__(self, s: str):
        if len(self) > 40_000:
            self.clear()
        low = s.lower()
        words = WORDS.findall(low)
        k, last, first = len(words), s[-1], s[0]
        digits = len(_DIGIT.findall(s))
        seps = len(_SEPARATOR.findall(s)) if any(c in s for c in "|·•»›>/→") else 0
        size = 0 if k < 2 else 1 if k == 2 else 2 if k < 5 else 3 if k < 9 else 4 if k < 15 else 5
        contact = ("@" in s or digits > 6) and _CONTACT.search(s) is not None
        url = ("://" in s or "www." in low or "====" in s) and _URL.search(s) is not None
        v = np.array(
            (
                size == 0, size == 1, size == 2, size == 3, size == 4, size == 5, last == ".", last in "!?…", last == ":", last in ",;",
                first.islower(), first.isupper(), first.isdigit(), _BULLET.match(s) is not None, k > 0 and s.isupper(), digits / len(s),
                seps >= 1, seps >= 3, contact, "©" in s, url, digits > 1 and _DATE.search(s) is not None,
            ), dtype=np.float32,
        )
        fact = v, k, np.array([word_id(w) for w in words], dtype=np.int64), " ".join(low.split()), last in ".!?…»”\"')]" and _ENDED.search(s) is not None, seps
        self[s] = fact
        return fact


FACTS = Facts()


def roles(rows: list[tuple[int, str, bool, bool]], title: str | None, headings) -> tuple[np.ndarray, list]:
    """Role vectors of a page's leaves, and the facts of each line."""
    title = _flat(title)
    heads = {_flat(h) for h in headings} if headings is not None else set()
    heads.discard("")
    n = len(rows)
    facts = [FACTS[r[1]] for r in rows]
    x = np.zeros((n, ROLE_NAMES), dtype=np.float32)
    if not n:
        return x, facts
    x[:, :OWN] = [f[0] for f in facts]
    x[:, 25], x[:, 26] = not title, not heads
    at = np.arange(n)
    x[:, 29], x[:, 30], x[:, 31], x[0, 36] = at / n, at < 3, n - at <= 5, 1
    more = []
    before_open, before_len = False, 0
    for (_, s, blank, blank_next), (_, k, _, flat, ended, seps) in zip(rows, facts, strict=True):
        size = len(s)
        is_title, is_head = flat == title, flat in heads
        goes_on = before_open and not blank
        more.append((is_title, is_head, not is_title and title != "" and title in flat, blank, blank_next, goes_on and s[0].islower(), goes_on, size > 45 and abs(size - before_len) < 14, min(size, 400) / 400, s.startswith("=====")))
        before_open = not ended and (k >= 5 or goes_on and k >= 2) and seps < 2 and not is_title and not is_head
        before_len = size
    x[:, [22, 23, 24, 27, 28, 32, 33, 34, 35, 37]] = more
    return x, facts


def page_input(text, title, headings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, roles, word ids, words per line."""
    rows = leaves(text)
    x, facts = roles(rows, title, headings)
    ids = np.concatenate([f[2] for f in facts]) if facts else np.empty(0, dtype=np.int64)
    return np.array([r[0] for r in rows], dtype=np.int32), x, ids, np.array([len(f[2]) for f in facts], dtype=np.int64)


def _key(s: str) -> str:
    return _NUMBER.sub("0", _QUOTED.sub("Q", " ".join(s.split()))).lower()


class Recurrence:
    """Pages per key, pages per (site, key), pages and pages per site, by hash; over all pages, for the keys of a sample."""

    def __init__(self, keys: dict[int, int], pairs: dict[int, int], pages: int, sites: dict[int, int]) -> None:
        self.keys, self.pairs, self.pages, self.sites = keys, pairs, pages, sites

    def often(self, site: int, key: str) -> bool:
        """On a seventieth of all pages or a seventh of the site's, and on four at least."""
        h = key_hash(key)
        n, own = self.keys.get(h, 0), self.pairs.get(pair_hash(site, h), 0)
        return n * 70 >= self.pages and n >= 4 or own * 7 >= self.sites.get(site, 0) and own >= 4


def key_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def pair_hash(site: int, h: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{site} {h}") - (1 << 63)


def leaf_keys(text: str | None) -> list[str]:
    return [_key(_MARK.sub("", r[1])) for r in leaves(text)]


def counted(pages: list[dict]) -> Recurrence:
    """The recurrence among the given pages alone."""
    keys, pairs, sites = Counter(), Counter(), Counter()
    for p in pages:
        own = {key_hash(k) for k in leaf_keys(p["text"])}
        keys.update(own)
        pairs.update({pair_hash(p["site"], h) for h in own})
        sites[p["site"]] += 1
    return Recurrence(keys, pairs, len(pages), sites)


def weak_labels(pages: list[dict], known: Recurrence | None = None) -> list[np.ndarray]:
    """Per page the labels of its leaves: 1 furniture, 0 content, -1 doubtful.

    ``pages`` have text, title, headings and site. Keys (figures and quoted names masked) recur as ``known`` tells. Subheadings and list
    items are known by their keys from the pages that name or mark them.
    """
    known = known or counted(pages)
    total, subheads, titles, items = Counter(), set(), set(), Counter()
    split = []
    for p in pages:
        rows = leaves(p["text"])
        keys = [_key(_MARK.sub("", r[1])) for r in rows]
        split.append((rows, keys))
        total.update(set(keys))
        items.update({k for r, k in zip(rows, keys, strict=True) if _BULLET.match(r[1])})
        title = _flat(p["title"])
        if title:
            titles.add(_key(p["title"]))
        subheads |= {_key(h) for h in (p["headings"] if p["headings"] is not None else []) if h and title and _flat(h) != title}
    subheads -= titles
    out = []
    for p, (rows, keys) in zip(pages, split, strict=True):
        x, facts = roles(rows, p["title"], p["headings"])
        y = np.full(len(rows), -1, dtype=np.int8)
        open_before = False
        for i, ((_, s, blank, blank_next), k) in enumerate(zip(rows, keys, strict=True)):
            n, v = facts[i][1], x[i]
            often = known.often(p["site"], k)
            goes_on = not blank_next and i + 1 < len(rows) and rows[i + 1][1][0].islower()
            prose = n >= 6 and (goes_on or len(_INNER_END.findall(s)) > 0 and v[16] == 0)
            open_now = False
            if v[37]:
                y[i] = 1
            elif v[22] or v[23]:
                y[i] = 0
            elif v[24] and v[16]:
                y[i] = 1
            elif open_before and not blank:
                y[i], open_now = 0, not _ENDED.search(s)
            elif not goes_on and n <= 16 and k not in subheads and k not in titles and items[k] * 3 < total[k] and (often or v[19]):
                y[i] = 1
            elif not goes_on and n <= 14 and not v[13] and FURNITURE.search(_QUOTED.sub("", s)):
                y[i] = 1
            elif prose:
                y[i], open_now = 0, not _ENDED.search(s)
            elif items[k] * 3 >= total[k] > 0 and n >= 2 and not FURNITURE.search(s):
                y[i] = 0
            elif k in subheads:
                y[i] = 0 if v[26] else -1
            elif k in titles:
                y[i] = -1 if v[25] else 1
            elif v[17] or v[18]:
                y[i] = 1
            elif n >= 6 and _ENDED.search(s):
                y[i] = 0
            elif not v[25] and not v[26] and n < 9:
                y[i] = 1
            open_before = open_now
        out.append(y)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """Word vectors, two LSTMs and a logistic layer; float32 throughout."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        d = EMBED + ROLE_NAMES
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": (r.standard_normal((VOCABULARY, EMBED)) * 0.1).astype(np.float32), "o": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": draw(d + HIDDEN, 4 * HIDDEN), f"c{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["U"] = draw(2 * HIDDEN + d, 1)

    def inputs(self, batch: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x (lines, pages, features), mask, and the words' ids, slots and weights."""
        x = np.zeros((width, len(batch), EMBED + ROLE_NAMES), dtype=np.float32)
        mask = np.zeros((width, len(batch), 1), dtype=np.float32)
        ids, slot, weight = [], [], []
        for j, (_, role, words, count) in enumerate(batch):
            t = len(role)
            x[:t, j, EMBED:] = role
            mask[:t, j] = 1
            ids.append(words)
            slot.append(np.repeat(np.arange(t) * len(batch) + j, count))
            weight.append(np.repeat(1 / np.maximum(count, 1), count))
        ids, slot, weight = np.concatenate(ids), np.concatenate(slot), np.concatenate(weight).astype(np.float32)
        flat = np.zeros((width * len(batch), EMBED), dtype=np.float32)
        if len(ids):
            vec = self.p["E"][ids] * weight[:, None]
            at = np.argsort(slot, kind="stable")
            s = slot[at]
            start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            flat[s[start]] = np.add.reduceat(vec[at], start, axis=0)
        x[..., :EMBED] = flat.reshape(width, len(batch), EMBED)
        return x, mask, ids, slot, weight

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False):
        """Hidden states (lines, pages, HIDDEN) of one direction; padding carries the state on."""
        w, c0 = self.p[f"W{way}"], self.p[f"c{way}"]
        d = x.shape[2]
        pre = x @ w[:d] + c0
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c, hs, tape = h.copy(), np.zeros((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ w[d:]
            g = _sigmoid(z)
            g[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, a = np.split(g, 4, axis=1)
            cn = f * c + i * a
            tc = np.tanh(cn)
            hn = o * tc
            m = mask[t]
            if keep:
                tape.append((t, g, c, tc, h))
            c, h = m * cn + (1 - m) * c, m * hn + (1 - m) * h
            hs[t] = h
        return (hs, tape) if keep else hs

    def back(self, x: np.ndarray, mask: np.ndarray, way: str, tape: list, dhs: np.ndarray, grad: dict) -> np.ndarray:
        w = self.p[f"W{way}"]
        d = x.shape[2]
        dw, dz_all = np.zeros_like(w), np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, g, c_old, tc, h_old in reversed(tape):
            m = mask[t]
            dh = dh + dhs[t]
            i, f, o, a = np.split(g, 4, axis=1)
            dhn, dcn = dh * m, dc * m
            dcn = dcn + dhn * o * (1 - tc * tc)
            dz = np.concatenate([dcn * a * i * (1 - i), dcn * c_old * f * (1 - f), dhn * tc * o * (1 - o), dcn * i * (1 - a * a)], axis=1)
            dz_all[t] = dz
            dw[d:] += h_old.T @ dz
            dc = dcn * f + dc * (1 - m)
            dh = dz @ w[d:].T + dh * (1 - m)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        dw[:d] = x.reshape(-1, d).T @ flat
        grad[f"W{way}"], grad[f"c{way}"] = dw, flat.sum(axis=0)
        return dz_all @ w[:d].T

    def scores(self, batch: list) -> list[np.ndarray]:
        """Probability of furniture for every leaf of every page."""
        width = max((len(b[1]) for b in batch), default=0)
        if not width:
            return [np.empty(0, np.float32) for _ in batch]
        x, mask, *_ = self.inputs(batch, width)
        both = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b"), x], axis=2)
        p = _sigmoid(both @ self.p["U"] + self.p["o"])[..., 0]
        return [p[: len(b[1]), j] for j, b in enumerate(batch)]

    def step(self, batch: list, labels: list[np.ndarray], state: dict, rate: float) -> float:
        width = max(len(b[1]) for b in batch)
        x, mask, ids, slot, weight = self.inputs(batch, width)
        (hf, tf), (hb, tb) = self.run(x, mask, "f", True), self.run(x, mask, "b", True)
        both = np.concatenate([hf, hb, x], axis=2)
        p = _sigmoid(both @ self.p["U"] + self.p["o"])[..., 0]
        y = np.full(p.shape, -1.0, np.float32)
        for j, lab in enumerate(labels):
            y[: len(lab), j] = lab
        counts = y >= 0
        dz = (np.where(counts, p - y, 0) / max(1, counts.sum())).astype(np.float32)[..., None]
        grad = {"U": both.reshape(-1, both.shape[2]).T @ dz.reshape(-1, 1), "o": dz.sum(keepdims=True).reshape(1)}
        dboth = dz @ self.p["U"].T
        dx = dboth[..., 2 * HIDDEN :].copy()
        dx += self.back(x, mask, "f", tf, dboth[..., :HIDDEN], grad)
        dx += self.back(x, mask, "b", tb, dboth[..., HIDDEN : 2 * HIDDEN], grad)
        de = np.zeros_like(self.p["E"])
        if len(ids):
            np.add.at(de, ids, dx[..., :EMBED].reshape(-1, EMBED)[slot] * weight[:, None])
        grad["E"] = de
        state["t"] = state.get("t", 0) + 1
        for k, g in grad.items():
            m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            fix = np.sqrt(1 - 0.999 ** state["t"]) / (1 - 0.9 ** state["t"])
            self.p[k] -= (rate * fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
        return float(-np.log(np.where(y == 1, p, 1 - p)[counts] + 1e-7).mean())


def fit(pages: list[dict], epochs: int = EPOCHS, known: Recurrence | None = None) -> Network:
    """Fit on pages (text, title, headings, site) by their weak labels."""
    net, state, rng = Network(), {}, np.random.default_rng(11)
    data = [page_input(p["text"], p["title"], p["headings"]) for p in pages]
    labels = weak_labels(pages, known)
    for e in range(epochs):
        blind = [_without_names(d, rng) for d in data]
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][1]) // 8 for i in order], kind="stable")]
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(groups)):
            if any(len(data[i][1]) for i in groups[k]):
                net.step([blind[i] for i in groups[k]], [labels[i] for i in groups[k]], state, RATE / (1 + e / 2))
    return net


def _without_names(page, rng) -> tuple:
    """Now and then a page without its title or headings, as such pages must be read too; and with some words unread."""
    numbers, x, ids, count = page
    x = x.copy()
    if rng.random() < 0.2:
        x[:, [22, 24]], x[:, 25] = 0, 1
    if rng.random() < 0.3:
        x[:, 23], x[:, 26] = 0, 1
    if len(ids):
        line = np.repeat(np.arange(len(count)), count)
        kept = (rng.random(len(count)) > 0.1)[line] & (rng.random(len(ids)) > 0.1)
        ids, count = ids[kept], np.bincount(line[kept], minlength=len(count))
    return numbers, x, ids, count


def recurrence(pages: DataFrame, sample: list[dict]) -> Recurrence:
    """Counts over all pages for the keys, (site, key) pairs and sites of the sample; added up before the shuffle.

    The driver gets at most one row per key and pair of the sample.
    """
    own = [(p["site"], {key_hash(k) for k in leaf_keys(p["text"])}) for p in sample]
    wanted = frozenset(h for _, hs in own for h in hs), frozenset(pair_hash(s, h) for s, hs in own for h in hs)
    shared = pages.sparkSession.sparkContext.broadcast(wanted)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (keys, pairs), found, hashes = shared.value, Counter(), {}
        for pdf in it:
            for site, text in zip(pdf["site"], pdf["text"], strict=True):
                page = set()
                for _, line, *_ in leaves(text):
                    h = hashes.get(line)
                    if h is None:
                        if len(hashes) > 100_000:
                            hashes.clear()
                        h = hashes[line] = key_hash(_key(_MARK.sub("", line)))
                    if h in keys:
                        page.add(h)
                found.update((False, h) for h in page)
                found.update((True, x) for x in (pair_hash(site, h) for h in page) if x in pairs)
        yield pd.DataFrame([(k, h, n) for (k, h), n in found.items()], columns=["pair", "h", "n"])

    src = spread(pages.select(F.coalesce("resource_id", F.lit(-1)).alias("site"), F.col("page_text").alias("text")))
    rows = src.mapInPandas(run, "pair boolean, h bigint, n bigint").groupBy("pair", "h").agg(F.sum("n").alias("n")).collect()
    sites = pages.sparkSession.createDataFrame([(s,) for s in {p["site"] for p in sample}], "site bigint")
    per_site = src.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    found = per_site.join(F.broadcast(sites), "site").collect()
    total = per_site.agg(F.sum("n")).first()[0] or 0
    return Recurrence({r["h"]: r["n"] for r in rows if not r["pair"]}, {r["h"]: r["n"] for r in rows if r["pair"]}, total, {r["site"]: r["n"] for r in found})


def fit_on(pages: DataFrame, most: int = SAMPLE_PAGES, most_chars: int = FIT_CHARS) -> Network:
    """Fit on at most ``most`` pages of up to ``most_chars`` characters, drawn by hash of their id."""
    cols = [F.col("page_text").alias("text"), F.col("page_title").alias("title"), "headings", F.coalesce("resource_id", F.lit(-1)).alias("site")]
    sample = bounded_sample(pages, F.col("page_id"), most).where(F.length("page_text") <= most_chars).select("page_id", *cols).collect()
    sample = [r.asDict() for r in in_order(sample, "page_id", "text")]
    return fit(sample, known=recurrence(pages, sample))


def _judged(it: Iterator[pd.DataFrame], net: Network):
    """(page ids, inputs, scores) of some pages at a time, pages of like length together."""
    for pdf in it:
        for lo in range(0, len(pdf), 1_024):
            part = pdf.iloc[lo : lo + 1_024]
            data = [page_input(*row) for row in zip(part["page_text"], part["page_title"], part["headings"], strict=True)]
            order = np.argsort([len(d[1]) for d in data], kind="stable")
            scores: list = [None] * len(data)
            for at in range(0, len(order), 256):
                group = order[at : at + 256]
                for i, p in zip(group, net.scores([data[i] for i in group]), strict=True):
                    scores[i] = p
            yield part, data, scores


def _shared(pages: DataFrame, net: Network):
    return pages.sparkSession.sparkContext.broadcast(net.p)


def _network(weights: dict) -> Network:
    net = Network.__new__(Network)
    net.p = weights
    return net


def furniture_lines(pages: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, line_no, score) of the lines that are not main content; pages without an id are passed over."""
    pages = pages.where("page_id is not null")
    shared = _shared(pages, net)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, data, scores in _judged(it, _network(shared.value)):
            hit = [p >= threshold for p in scores]
            ids = np.repeat(part["page_id"].to_numpy(), [h.sum() for h in hit])
            lines = np.concatenate([d[0][h] for d, h in zip(data, hit, strict=True)])
            yield pd.DataFrame({"page_id": ids, "line_no": lines, "score": np.concatenate([p[h] for p, h in zip(scores, hit, strict=True)]).astype("float64")})

    return spread(pages.select("page_id", "page_text", "page_title", "headings")).mapInPandas(run, "page_id bigint, line_no int, score double")


def main_text(pages: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, main_text): the page without its furniture lines, in one pass; null text stays null, pages without an id are passed over."""
    pages = pages.where("page_id is not null")
    shared = _shared(pages, net)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, data, scores in _judged(it, _network(shared.value)):
            out = []
            for t, d, p in zip(part["page_text"], data, scores, strict=True):
                drop = set(d[0][p >= threshold].tolist())
                out.append("\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in drop) if t is not None else None)
            yield pd.DataFrame({"page_id": part["page_id"], "main_text": out})

    return spread(pages.select("page_id", "page_text", "page_title", "headings")).mapInPandas(run, "page_id bigint, main_text string")
