"""Width, height, mode and pages of image and PDF files from their bytes, a few reads a file in an Arrow function: no picture is decoded."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Segments of a JPEG that are walked until its frame, and pages of a TIFF that are counted.
SEGMENTS, DIRECTORIES = 256, 1024
#: A PDF's first page is measured as it is drawn at so many dots per inch; its boxes are in points, 72 an inch.
DPI = 200
_MODES = {"png": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}, "jpeg": {1: "L", 3: "RGB", 4: "CMYK"}, "bmp": {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"},
    "tiff": {0: "L", 1: "L", 2: "RGB", 3: "P", 5: "CMYK", 6: "YCbCr"}}


FACTS = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("stored_mode", StringType()), StructField("pages", IntegerType())])
Facts = tuple[int | None, int | None, str | None, int | None]


def _number(data: bytes, at: int | None, size: int, order: str = "big") -> int | None:
    """An unsigned number of ``size`` bytes from place ``at`` on; null beyond the end."""
    if at is None or at < 0 or at + size > len(data):
        return None
    return int.from_bytes(data[at : at + size], order)


def png(data: bytes) -> Facts | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    return _number(data, 16, 4), _number(data, 20, 4), _MODES["png"].get(_number(data, 25, 1)), 1


def bmp(data: bytes) -> Facts | None:
    """Heights of rows stored from the top are negative."""
    if data[:2] != b"BM":
        return None
    size = [None if x is None else abs(x - 2**32 if x >= 2**31 else x) for x in (_number(data, k, 4, "little") for k in (18, 22))]
    return *size, _MODES["bmp"].get(_number(data, 28, 2, "little")), 1


def jpeg(data: bytes) -> Facts | None:
    """Segments are walked from one length to the next until a frame header."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    for _ in range(min(SEGMENTS, len(data) // 4 + 1)):
        marker = _number(data, at + 1, 1)
        if marker is None or data[at] != 0xFF or marker in (0xD9, 0xDA):
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return _number(data, at + 7, 2), _number(data, at + 5, 2), _MODES["jpeg"].get(_number(data, at + 9, 1)), 1
        length = -1 if marker == 0xFF else _number(data, at + 2, 2)
        if length is None:
            return None
        at += 2 + length
    return None


def tiff(data: bytes) -> Facts | None:
    """The first directory's tags; pages are directories, each of which says where the next one is."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "little" if data[:1] == b"I" else "big"
    first = _number(data, 4, 4, order)

    def tag(code: int) -> int | None:
        if first is None:
            return None
        for k in range(max(min(_number(data, first, 2, order) or 0, 512), 1)):
            at = first + 2 + 12 * k
            if _number(data, at, 2, order) == code:
                return _number(data, at + 8, 2 if _number(data, at + 2, 2, order) == 3 else 4, order)
        return None

    at, pages = first, 0
    for _ in range(min(DIRECTORIES, len(data) // 6 + 1)):
        n = _number(data, at, 2, order) if at else None
        if n is None:
            break
        at, pages = _number(data, at + 2 + 12 * n, 4, order), pages + 1
    return tag(256), tag(257), _MODES["tiff"].get(tag(262)), pages


_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_BOX = re.compile(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]")


def _drawn(low: bytes, high: bytes) -> int | None:
    try:
        return math.ceil((float(high) - float(low)) * DPI / 72)
    except (ValueError, OverflowError):
        return None


def pdf(data: bytes) -> Facts | None:
    """Page objects are counted and the first media box measured where they stand in plain text, not in compressed streams."""
    pages = sum(1 for _ in _PAGE.finditer(data)) if data[:5] == b"%PDF-" else 0
    box = _BOX.search(data) if pages else None
    if not box:
        return None
    return _drawn(box[1], box[3]), _drawn(box[2], box[4]), "RGB", pages


#: The reader of each extension.
READERS = {"png": png, "jpg": jpeg, "jpeg": jpeg, "bmp": bmp, "tiff": tiff, "pdf": pdf}


def header_of(extension: str | None, data: bytes | None) -> Facts:
    """Width, height, mode and pages; nulls for unknown kinds and what is none of its kind, and for figures that no whole number of 32 bits holds."""
    found = READERS[extension](data) if data is not None and extension in READERS else None
    return tuple(None if isinstance(x, int) and not -(2**31) <= x < 2**31 else x for x in found or (None,) * 4)


@F.pandas_udf(FACTS)
def headers(extension: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([header_of(*x) for x in zip(extension, data, strict=True)], columns=FACTS.names, dtype=object)
    return rows.astype({"width": "Int32", "height": "Int32", "pages": "Int32"})


def with_headers(files: DataFrame) -> DataFrame:
    """``files`` (extension, error, content) with width, height, stored_mode, mode, pages, and an ``error`` where the content is none of its kind or cut off before they are known.

    ``mode`` is what the picture has once it is loaded: RGB. Files with an error already are not looked into. A file that lacks width, height
    or, for pictures, a known mode has ``load error: no <extension> header``; no file raises an exception.
    """
    read = F.when(F.col("error").isNull() & F.col("extension").isin(*READERS), F.col("content"))
    # a function that may give another result each time is called once, not again in each filter and column that uses it
    rows = files.withColumn("__h", headers.asNondeterministic()("extension", read)).drop("content")
    known = F.col("__h.width").isNotNull() & F.col("__h.height").isNotNull() & F.col("__h.stored_mode").isNotNull()
    found = F.col("__known")
    error = F.when(F.col("error").isNull() & ~found, F.concat(F.lit("load error: no "), F.col("extension"), F.lit(" header"))).otherwise(F.col("error"))
    kept = lambda name: F.when(found, F.col(f"__h.{name}"))
    rows = rows.withColumn("__known", known)
    return rows.withColumns({"error": error, "width": kept("width"), "height": kept("height"), "stored_mode": kept("stored_mode"), "pages": kept("pages"),
        "mode": F.when(found, "RGB")}).drop("__h", "__known")
