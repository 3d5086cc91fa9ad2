"""Image measures against loops over pixels."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.operators import pixels as px


def mirrored(g, y, x):
    h, w = g.shape
    flip = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    return g[flip(y, h), flip(x, w)]


def test_filters_by_loops():
    g = np.random.default_rng(0).integers(0, 256, (7, 9)).astype(float)
    lap, grad = np.zeros_like(g), np.zeros_like(g)
    for y in range(7):
        for x in range(9):
            at = lambda dy, dx: mirrored(g, y + dy, x + dx)  # noqa: B023, E731
            lap[y, x] = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * g[y, x]
            sx = sum(k * (at(dy, 1) - at(dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
            sy = sum(k * (at(1, dx) - at(-1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = np.hypot(sx, sy)
    assert np.allclose(px.laplacian(g), lap) and np.allclose(px.gradient(g), grad)


def test_measure_turn_and_crop(spark):
    page = np.full((40, 50), 255, np.uint8)
    page[15:20, 12:30] = 7
    page[2, 48] = 0
    rows = [(1, page.tobytes(), 50, 40), (2, b"short", 50, 40), (3, None, 1, 1)]
    df = spark.createDataFrame(rows, "k int, d binary, w int, h int").withColumn("m", px.measure("d", "w", "h"))
    got = {r.k: r.m for r in df.collect()}
    assert got[1].content_box == [2, 5, 38, 25] and got[1].high == 255 and got[1].black_share == 1 / 2000
    assert got[2].flat_pixels is None and got[3].low is None
    one = df.where("k = 1").select(px.turn("d", "w", "h", F.lit(90)).alias("t"), px.crop("d", "w", "h", "m.content_box").alias("c")).first()
    assert bytes(one.t) == np.rot90(page).tobytes() and bytes(one.c) == page[5:30, 2:40].tobytes()


def test_turned_by_loops_and_deskew(spark):
    g = np.random.default_rng(1).integers(0, 256, (9, 12)).astype(np.uint8)
    a, out = np.deg2rad(3.0), np.zeros_like(g)
    for y in range(9):
        for x in range(12):
            dy, dx = y - 4.0, x - 5.5
            sy = min(max(4.0 + dy * np.cos(a) + dx * np.sin(a), 0), 8)
            sx = min(max(5.5 + dx * np.cos(a) - dy * np.sin(a), 0), 11)
            value = sum(g[min(int(sy) + i, 8), min(int(sx) + j, 11)] * (abs(1 - i - sy % 1)) * (abs(1 - j - sx % 1)) for i in (0, 1) for j in (0, 1))
            out[y, x] = np.rint(value)
    assert np.abs(px.turned(g, 3.0).astype(int) - out).max() <= 1
    page = np.full((120, 160), 255, np.uint8)
    for y in range(15, 110, 12):
        page[y : y + 3, 15:145] = 0
    assert px.skew_of(page) == 0.0 and px.skew_of(np.full((5, 5), 255, np.uint8)) == 0.0
    tilted = px.turned(page, 3.0)
    assert abs(px.skew_of(tilted) - 3.0) <= 0.5
    df = spark.createDataFrame([(1, tilted.tobytes()), (2, None), (3, b"x")], "k int, d binary").select("k", "d", px.skew("d", F.lit(160), F.lit(120)).alias("a"))
    got = {r.k: (r.a, r.level) for r in df.withColumn("level", px.deskew("d", F.lit(160), F.lit(120), "a")).collect()}
    level = np.frombuffer(got[1][1], np.uint8).reshape(120, 160)
    assert abs(px.skew_of(level)) <= 0.5 and got[2] == (None, None) and got[3][0] is None and bytes(got[3][1]) == b"x"


def test_many_images_are_measured_at_once(monkeypatch):
    """300 images of three sizes among rows that are none: a few steps in all, and each row's figures are its own."""
    rng = np.random.default_rng(3)
    sizes = [(1, 6), (7, 5), (20, 20)]
    images = [rng.integers(0, 256 if k % 2 else 40, sizes[k % 3]).astype(np.uint8) for k in range(300)]
    rows = [(i.tobytes(), i.shape[1], i.shape[0]) for i in images] + [(None, 1, 1), (b"", 0, 0), (b"abc", 2, 2)]
    calls = []
    monkeypatch.setattr(px, "measure_same", lambda raw, real=px.measure_same: calls.append(len(raw)) or real(raw))
    got = px.measure.func(*(pd.Series(list(x)) for x in zip(*rows, strict=True)))
    assert calls == [100, 100, 100] and got.iloc[300:].isna().all(axis=None)
    for g, r in zip(images, got.iloc[:300].itertuples(), strict=True):
        f = g.astype(float)
        flat = f[px.gradient(f) < 50]
        want = float(np.median(np.abs(flat - np.median(flat)))) if len(flat) else 0.0
        assert (r.laplacian_variance, r.flat_pixels, r.flat_deviation) == (px.laplacian(f).var(), len(flat), want)
        assert r.black_share == (g <= 4).mean() and r.high == np.sort(g.ravel())[int(np.floor(0.975 * g.size + 1e-9))]
