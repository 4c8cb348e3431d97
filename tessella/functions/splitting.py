"""Recursive splitting of a text at an ordered list of separators, with overlapping chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk size, overlap and separators in the order in which they are tried.
SIZE, OVERLAP = 650, 250
SEPARATORS = ("\n\n", "\n", "。", "!", "?", "]】", ")", "}", "›")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text, each later one beginning with the separator."""
    starts = [0, *[m.start() for m in re.finditer(re.escape(separator), text)], len(text)]
    return [text[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size``; each chunk repeats up to ``overlap`` characters of the last."""
    chunks, window, total = [], [], 0
    for p in pieces:
        if window and total + len(p) > size:
            chunks.append("".join(window))
            while total > overlap or (total and total + len(p) > size):
                total -= len(window.pop(0))
        window.append(p)
        total += len(p)
    if window:
        chunks.append("".join(window))
    return chunks


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped non-empty chunks. A piece that holds none of the separators stays whole, however long."""
    if not text:
        return []
    at = next((i for i, s in enumerate(separators) if s in text), len(separators))
    if at == len(separators):
        whole = text.strip()
        return [whole] if whole else []
    out, small = [], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, separators[at + 1 :])
    out += _packed(small, size, overlap)
    return [c.strip() for c in out if c.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def recursive_chunks(text: pd.Series) -> pd.Series:
    return text.map(split_text)
