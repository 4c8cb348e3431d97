"""Text of office files: DOCX and PPTX by the standard library, PDF where a reader library is installed, else an error."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml\Z")


def _paragraphs(xml: bytes) -> str:
    """Text runs of a part, joined by paragraph (tags ``p`` and ``t`` of either office format); tabs and breaks are kept."""
    lines = []
    for p in ElementTree.fromstring(xml).iter():
        if p.tag.endswith("}p"):
            runs = [x.text or "" if x.tag.endswith("}t") else "\t" if x.tag.endswith("}tab") else "\n" if x.tag.endswith("}br") else "" for x in p.iter()]
            lines.append("".join(runs))
    return "\n".join(lines)


def docx_pages(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [_paragraphs(z.read("word/document.xml"))]


def pptx_pages(content: bytes) -> list[str]:
    """One page a slide, in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := _SLIDE.search(n)))
        return [_paragraphs(z.read(n)) for _, n in slides]


def pdf_pages(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF reader is installed") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


READERS = {".docx": docx_pages, ".pptx": pptx_pages, ".pdf": pdf_pages, ".txt": lambda c: [c.decode("utf-8")]}


def pages_of(path: str, content: bytes) -> list[tuple[int, str]]:
    """(page number from 0, text) of the pages that are not blank; an unknown kind raises."""
    kind = "." + path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"unknown kind {kind}")
    return [(i, t) for i, t in enumerate(READERS[kind](content)) if t.strip()]


def text_of(path: str, content: bytes) -> str:
    return "\n".join(t for _, t in pages_of(path, content))
