"""URL, HTML and JSON functions. Bad or null input gives null or an empty array, never an error."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File kinds that can be downloaded, media to skip, hosts of file shares.
DOWNLOADS = ("pdf", "docx", "pptx", "xlsx")
MEDIA = ("mp4", "avi", "mov")
SHARES = ("yadi.sk", "disk.yandex.ru")
# Patterns of shared-drive addresses and of a download page's token; lengths of a link's texts.
DRIVE_QUERY, DRIVE_PATH, CONFIRM = r"[?&]id=([^&#]+)", r"/d/([^/?#]+)", r"confirm=([0-9A-Za-z_]+)&"
ANCHOR, SNIPPET = 150, 200


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute link without fragment; links that cannot be parsed give null."""

    def one(b, x):
        try:
            return urldefrag(urljoin(b or "", x))[0] if x is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)])


def site_key(url: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment, parameters and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[?#;].*$", ""), r"/+$", "")


def authority(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def domain_slug(url: Column) -> Column:
    return F.replace(authority(url), F.lit("."), F.lit("_"))


def url_path(url: Column) -> Column:
    """The path of an address without parameters; '' for a bare host."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")


def drive_id(url: Column) -> Column:
    """File id of a shared-drive link: the ``id`` parameter, else the segment after ``/d/``."""
    query = F.regexp_extract(url, DRIVE_QUERY, 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(F.regexp_extract(url, DRIVE_PATH, 1), F.lit("")))


def confirm_token(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, CONFIRM, 1), F.lit(""))


def file_name(url: Column) -> Column:
    """Last segment of the path, or 'file'."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("file"))


def file_type(name: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1), F.lit("")))


def is_internal(base: Column, target: Column) -> Column:
    """The target's authority ends with the base's (suffix test, ports included)."""
    return F.coalesce(F.endswith(authority(target), authority(base)), F.lit(False))


def is_download(url: Column) -> Column:
    low = F.lower(url)
    bare = F.regexp_replace(low, r"[?#].*$", "")
    share = F.lit(False)
    for h in SHARES:
        share = share | F.coalesce(F.endswith(authority(low), F.lit(h)), F.lit(False))
    return F.contains(low, F.lit("drive.google.com")) | bare.rlike(rf"\.({'|'.join(DOWNLOADS)})$") | share


def is_media(url: Column) -> Column:
    return F.lower(url).rlike(rf"\.({'|'.join(MEDIA)})$")


def safe_file_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_\-.]", "_"), 1, 150)


class _Page(HTMLParser):
    """Collects visible text, h1-h3, title, and links with the text of the element around them."""

    HIDDEN = {"script", "style", "template"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.heads, self.found, self.hidden, self.title = [], [], [], 0, None
        self.open: list[tuple[str, dict, list[str], list[dict]]] = [("", {}, [], [])]

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag not in self.VOID:
            self.open.append((tag, dict(attrs), [], []))

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif any(o[0] == tag for o in self.open[1:]):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        """End the innermost element; its text goes on to its parent, and the links within learn their snippet."""
        tag, attrs, parts, links = self.open.pop()
        whole = "".join(parts).strip()
        for x in links:
            x["snippet"] = " ".join(p.strip() for p in parts if p.strip())[:SNIPPET]
        if tag == "title" and self.title is None:
            self.title = whole
        elif tag in ("h1", "h2", "h3"):
            self.heads.append(whole)
        elif tag == "a" and attrs.get("href"):
            link = {"href": attrs["href"], "anchor": "".join(p.strip() for p in parts)[:ANCHOR], "snippet": ""}
            self.found.append(link)
            self.open[-1][3].append(link)
        self.open[-1][2].extend(parts)
        return tag

    def handle_data(self, data):
        if not self.hidden:
            self.open[-1][2].append(data)
            if data.strip():
                self.text.append(data.strip())

    def finish(self) -> None:
        while len(self.open) > 1:
            self._close()
        for x in self.open[0][3]:
            x["snippet"] = " ".join(p.strip() for p in self.open[0][2] if p.strip())[:SNIPPET]


_LINK = T.StructType().add("href", T.StringType()).add("anchor", T.StringType()).add("snippet", T.StringType())
PAGE = T.StructType().add("title", T.StringType()).add("headings", T.ArrayType(T.StringType())).add("text", T.StringType()).add("links", T.ArrayType(_LINK))


@F.pandas_udf(PAGE)
def parse_page(html: pd.Series) -> pd.DataFrame:
    """Title, h1-h3, visible text and links of a page; null html gives nulls and empty lists."""
    rows = []
    for h in html:
        p = _Page()
        if h:
            p.feed(h)
            p.close()
            p.finish()
        rows.append((p.title, p.heads, "\n".join(p.text) if h else None, p.found))
    return pd.DataFrame(rows, columns=["title", "headings", "text", "links"])


def text_links(text: Column) -> Column:
    """Absolute links in plain text."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"'=]+)"), F.lit(1))


def coerce_files(c: Column) -> Column:
    """Non-empty strings of a JSON list; anything else gives an empty array."""
    parsed = F.from_json(c, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def request_text(body: Column) -> Column:
    """The ``text`` of a JSON body, else its ``question``."""
    return F.coalesce(F.nullif(F.get_json_object(body, "$.text"), F.lit("")), F.get_json_object(body, "$.question"))


# Patterns that bring numbered items onto lines of their own, applied in this order.
LIST_RULES = (
    (r"(?U):\s*(?=\d+[.)]\s)", ":\n"),
    (r"(?U)(?<!\n)\s(?=\d+[.)]\s)", "\n"),
    (r"(?U)(\d+)\.\s", "$1) "),
    (r"\n{3,}", "\n\n"),
)


def numbered_list(c: Column) -> Column:
    for pattern, to in LIST_RULES:
        c = F.regexp_replace(c, pattern, to)
    return c


def is_identifier(c: Column) -> Column:
    """A name that can stand in a statement: a letter or underscore, then letters, digits and underscores, outer spaces aside."""
    return F.regexp_like(F.trim(F.coalesce(c, F.lit(""))), F.lit(r"\A[A-Za-z_][A-Za-z0-9_]*\z"))


# Characters that HTML text must not hold, in the order in which they are replaced.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(c: Column | str) -> Column:
    """Text that can stand in HTML."""
    c = F.col(c) if isinstance(c, str) else c
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def grouped(n: Column, digits: int = 0) -> Column:
    """A number with spaces between thousands."""
    return F.replace(F.format_number(n, digits), F.lit(","), F.lit(" "))
