"""Size of images from their headers, and PNG content as base64."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how a PNG file begins.
PNG = b"\x89PNG\r\n\x1a\n"
SIZE = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("kind", T.StringType())


def header_size(b: bytes | None) -> tuple[int | None, int | None, str | None]:
    """(width, height, kind) of PNG, GIF, BMP and JPEG content; nulls for anything else."""
    if not b:
        return None, None, None
    b = bytes(b)
    try:
        if b.startswith(PNG):
            return (*struct.unpack(">II", b[16:24]), "png")
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", b[6:10]), "gif")
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return w, abs(h), "bmp"
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b):
                mark, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return w, h, "jpeg"
                at += 2 + size
    except struct.error:
        pass
    return None, None, None


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header_size(b) for b in content], columns=["width", "height", "kind"], dtype=object)


def png_base64(content: Column) -> Column:
    """Base64 of PNG content on one line; null for anything else."""
    return F.when(F.substring(content, 1, len(PNG)) == F.lit(PNG), F.regexp_replace(F.base64(content), r"\s", ""))
