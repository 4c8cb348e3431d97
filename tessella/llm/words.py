"""Word splitting and stable hashing shared by the text operators (executor side, Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORDS = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
MASK64 = (1 << 64) - 1


class HashCache(dict):
    """word -> signed 64-bit hash; emptied when it holds ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


HASH = HashCache()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(HASH.__getitem__, words), dtype=np.int64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h.view(np.uint64) if h.dtype == np.int64 else h
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Different hashes of the n-word runs, sorted; fewer than n words give none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    u = words.view(np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ mix(u[i : i + m] + np.uint64(i + 1))
    return np.unique(mix(out))


_HYPHEN_END = re.compile(r"[-‐‑]\s*\n\s*")


def rejoined(text: str) -> str:
    """The text with words joined that a hyphen at a line end broke (letters on both sides)."""

    def join(m: re.Match) -> str:
        a, z = m.span()
        return "" if a and z < len(text) and text[a - 1].isalpha() and text[z].isalpha() else m.group()

    return _HYPHEN_END.sub(join, text) if "\n" in text else text


def visible(text: str) -> str:
    """NFKC without invisible characters."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text
