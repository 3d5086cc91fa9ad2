"""Measures and cuts of grey images, given as row-major bytes with width and height, in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

MEASURES = StructType([
    StructField("laplacian_variance", DoubleType()), StructField("flat_pixels", LongType()),
    StructField("flat_deviation", DoubleType()), StructField("low", IntegerType()), StructField("high", IntegerType()),
    StructField("black_share", DoubleType()), StructField("content_box", ArrayType(IntegerType())),
])


#: Pixels that are measured at once: images of one size lie in one array, so that the steps' cost is shared.
AT_ONCE = 2**17


def _padded(g: np.ndarray) -> np.ndarray:
    """Images (the last two axes) with a border that mirrors the pixels next to it."""
    return np.pad(g, [(0, 0)] * (g.ndim - 2) + [(1, 1), (1, 1)], mode="reflect" if min(g.shape[-2:]) > 1 else "edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    """Four-neighbour Laplacian; borders mirror the pixels next to them."""
    p = _padded(g)
    return p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * g


def squared_gradient(g: np.ndarray) -> np.ndarray:
    """Squared magnitude of the three-by-three Sobel gradient."""
    p = _padded(g)
    across = lambda a, b, c: a + 2 * b + c
    x = across(p[..., :-2, 2:], p[..., 1:-1, 2:], p[..., 2:, 2:]) - across(p[..., :-2, :-2], p[..., 1:-1, :-2], p[..., 2:, :-2])
    y = across(p[..., 2:, :-2], p[..., 2:, 1:-1], p[..., 2:, 2:]) - across(p[..., :-2, :-2], p[..., :-2, 1:-1], p[..., :-2, 2:])
    return x * x + y * y


def gradient(g: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_gradient(g))


def content_boxes(g: np.ndarray, padding: int = 10, paper: int = 250) -> list[list[int] | None]:
    """Of each image, x, y, width and height of what is darker than paper, with padding; rows and columns with a single dark pixel are specks."""
    dark = g <= paper
    n, height, width = g.shape
    rows, columns = dark.sum(axis=2) > 1, dark.sum(axis=1) > 1
    found = rows.any(axis=1) & columns.any(axis=1)
    x, y = np.maximum(0, columns.argmax(axis=1) - padding), np.maximum(0, rows.argmax(axis=1) - padding)
    right = np.minimum(width, width - columns[:, ::-1].argmax(axis=1) + padding)
    low = np.minimum(height, height - rows[:, ::-1].argmax(axis=1) + padding)
    boxes = np.stack([x, y, right - x, low - y], axis=1).tolist()
    return [b if f else None for b, f in zip(boxes, found.tolist(), strict=True)]


def _twice_median(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the median of the first ``n`` numbers of each row of ordered numbers; anything where there are none."""
    at = np.arange(len(ordered))
    return ordered[at, np.maximum(n - 1, 0) // 2] + ordered[at, np.minimum(n // 2, ordered.shape[1] - 1)]


def measure_same(raw: np.ndarray) -> pd.DataFrame:
    """The measures of images of one size, (image, row, column)."""
    n, size = len(raw), raw.shape[1] * raw.shape[2]
    g = raw.astype(np.int32)
    flat = (squared_gradient(g) < 50**2).reshape(n, size)
    count, none = flat.sum(axis=1), np.int16(2**13)
    shades = raw.reshape(n, size).astype(np.int16)
    middle = _twice_median(np.sort(np.where(flat, shades, none), axis=1), count)
    spread = _twice_median(np.sort(np.where(flat, np.abs(2 * shades - middle[:, None]), none), axis=1), count)
    hist = np.bincount((g.reshape(n, size) + 256 * np.arange(n)[:, None]).ravel(), minlength=256 * n).reshape(n, 256)
    share = np.cumsum(hist, axis=1) / size
    return pd.DataFrame({
        "laplacian_variance": laplacian(g).astype(np.float64).reshape(n, size).var(axis=1), "flat_pixels": count,
        "flat_deviation": np.where(count > 0, spread / 4, 0.0),
        "low": np.argmax(share > 0.025, axis=1), "high": np.argmax(share > 0.975, axis=1), "black_share": share[:, 4],
        "content_box": content_boxes(raw)}, columns=MEASURES.names)


@F.pandas_udf(MEASURES)
def measure(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Figures that the quality scores are made of; null where the bytes are not an image of that size."""
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, (d, w, h) in enumerate(zip(data, width, height, strict=True)):
        if d and w > 0 and h > 0 and len(d) == w * h:
            by_size.setdefault((int(h), int(w)), []).append(k)
    parts = [pd.DataFrame(columns=MEASURES.names, index=range(0), dtype=object)]
    for (h, w), places in by_size.items():
        step = max(1, AT_ONCE // (h * w))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            raw = np.frombuffer(b"".join(data.iloc[k] for k in some), np.uint8).reshape(len(some), h, w)
            parts.append(measure_same(raw).set_index(pd.Index(some)))
    out = pd.concat(parts[1:] or parts).reindex(range(len(data)))
    return out.astype({"laplacian_variance": "float64", "flat_pixels": "Int64", "flat_deviation": "float64", "low": "Int32", "high": "Int32", "black_share": "float64"}).replace({"content_box": {np.nan: None}})


@F.pandas_udf(BinaryType())
def turn(data: pd.Series, width: pd.Series, height: pd.Series, degrees: pd.Series) -> pd.Series:
    """The image turned counter-clockwise by a multiple of 90 degrees."""
    return pd.Series([np.rot90(np.frombuffer(d, np.uint8).reshape(h, w), int(a) // 90 % 4)
        .tobytes() if d else None for d, w, h, a in zip(data, width, height, degrees, strict=True)])


@F.pandas_udf(BinaryType())
def crop(data: pd.Series, width: pd.Series, height: pd.Series, box: pd.Series) -> pd.Series:
    """The image cut to a box (x, y, width, height); whole without a box."""
    def one(d, w, h, b):
        if not d or b is None:
            return d
        x, y, bw, bh = (int(v) for v in b)
        return np.frombuffer(d, np.uint8).reshape(h, w)[y : y + bh, x : x + bw].tobytes()

    return pd.Series([one(*x) for x in zip(data, width, height, box, strict=True)])


def turned(g: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned counter-clockwise about its centre by a small angle, of the same size; between pixels bilinear, beyond the border the border's."""
    h, w = g.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(np.float64)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    dy, dx = y - cy, x - cx
    sy = np.clip(cy + dy * np.cos(a) + dx * np.sin(a), 0, h - 1)
    sx = np.clip(cx + dx * np.cos(a) - dy * np.sin(a), 0, w - 1)
    y0, x0 = np.minimum(sy.astype(int), max(h - 2, 0)), np.minimum(sx.astype(int), max(w - 2, 0))
    fy, fx = sy - y0, sx - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    top, bottom = g[y0, x0] * (1 - fx) + g[y0, x1] * fx, g[y1, x0] * (1 - fx) + g[y1, x1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def skew_of(g: np.ndarray, limit: float = 5.0, step: float = 0.25, dark: int = 128) -> float:
    """The angle by which lines of text rise to the right, in degrees: the one whose projection of dark pixels is the most uneven."""
    y, x = np.nonzero(g < dark)
    if len(y) < 20:
        return 0.0
    best, angle = -1.0, 0.0
    for a in sorted(np.arange(-limit, limit + step / 2, step), key=abs):
        rows = np.rint(y + x * np.tan(np.deg2rad(a))).astype(int)
        unevenness = float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())
        if unevenness > best * 1.0001:
            best, angle = unevenness, float(a)
    return angle


@F.pandas_udf(DoubleType())
def skew(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The measured angle of text lines; null where the bytes are not an image of that size."""
    return pd.Series([skew_of(np.frombuffer(d, np.uint8).reshape(h, w)) if d and len(d) == w * h
        else None for d, w, h in zip(data, width, height, strict=True)], dtype="float64")


@F.pandas_udf(BinaryType())
def deskew(data: pd.Series, width: pd.Series, height: pd.Series, angle: pd.Series) -> pd.Series:
    """The image with lines that rise by ``angle`` degrees made level; as it is for an angle of 0 or null."""
    def one(d, w, h, a):
        return turned(np.frombuffer(d, np.uint8).reshape(h, w), -a).tobytes() if d and a == a and a else d

    return pd.Series([one(*x) for x in zip(data, width, height, angle, strict=True)])
