"""Neighbourhoods, lines and packed masks against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from voxlake.functions import rasters


def bresenham(x0, y0, x1, y1):
    dx, sx, dy, sy = abs(x1 - x0), 1 if x0 < x1 else -1, -abs(y1 - y0), 1 if y0 < y1 else -1
    error, out = dx + dy, []
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        twice = 2 * error
        if twice >= dy:
            error, x0 = error + dy, x0 + sx
        if twice <= dx:
            error, y0 = error + dx, y0 + sy


def test_lines(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(-9, 10) for _ in range(4)) for _ in range(300)] + [(2, 2, 2, 2), (0, 0, 5, 0), (0, 5, 0, 0), (0, 0, 4, 2), (4, 2, 0, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    for r in df.withColumn("p", rasters.line_points(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert [tuple(p) for p in r.p] == bresenham(r.a, r.b, r.c, r.d), r


def test_drawing(spark):
    rng = random.Random(2)
    width, height = 11, 7
    frames = [(f"i{k}", width, [rng.randrange(256) for _ in range(width * height)]) for k in range(4)]
    overlays = []
    for k in range(3):
        for layer in range(3):
            overlays.append((f"i{k}", layer, rng.choice(["line", "rectangle"]), *(rng.uniform(-0.2, 1.2) for _ in range(4)), rng.randrange(0, 4), width, height, *(rng.randrange(256) for _ in range(3)), rng.choice([0, 77, 128, 255])))
    o = spark.createDataFrame(overlays, "image_id string, layer int, kind string, x0 double, y0 double, x1 double, y1 double, thickness int, columns int, rows int, red int, green int, blue int, alpha int")
    f = spark.createDataFrame(frames, "image_id string, columns int, pixels array<int>")
    want = {}
    for name, _, pixels in frames:
        rgb = [v for p in pixels for v in (p, p, p)]
        for image, _, kind, x0, y0, x1, y1, t, _, _, *colour, alpha in sorted(overlays, key=lambda o: o[1]):
            if image != name:
                continue
            point = lambda x, y: (int(min(max(x, 0), 1) * (width - 1) + 0.5), int(min(max(y, 0), 1) * (height - 1) + 0.5))
            a, b, c, d = point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)
            for p, q in ([(a, b), (b, c), (c, d), (d, a)] if kind == "rectangle" else [(a, c)]):
                for x, y in bresenham(*p, *q):
                    t = max(1, t)
                    for yy in range(y - t // 2, y - t // 2 + t):
                        for xx in range(x - t // 2, x - t // 2 + t):
                            if 0 <= xx < width and 0 <= yy < height:
                                for i in range(3):
                                    at = 3 * (yy * width + xx) + i
                                    s = alpha / 255
                                    rgb[at] = colour[i] if alpha == 255 else rgb[at] if alpha == 0 else int(rgb[at] * (1.0 - s) + colour[i] * s + 0.5)
        want[name] = rgb
    assert {r.image_id: r.rgb for r in rasters.drawn(f, o).collect()} == want
    assert rasters.drawn(f, o.where("false")).where("size(rgb) = 231").count() == 4


def test_smoothing(spark):
    rng = np.random.default_rng(3)
    for rows, columns in ((1, 1), (1, 6), (5, 1), (6, 7)):
        p = rng.integers(0, 256, (rows, columns))
        e = np.pad(p, 1, mode="edge")
        smooth = sum((2 - abs(i)) * (2 - abs(j)) * e[1 + i : 1 + i + rows, 1 + j : 1 + j + columns] for i in (-1, 0, 1) for j in (-1, 0, 1)) // 16
        df = spark.createDataFrame([(p.ravel().tolist(), columns)], "p array<int>, c int")
        got = df.select(*(rasters.denoised(F.col("p"), F.col("c"), F.lit(s)).alias(f"s{i}") for i, s in enumerate((0.05, 0.5, 2.0)))).first()
        assert got.s0 == p.ravel().tolist() and got.s2 == smooth.ravel().tolist()
        assert got.s1 == np.floor(p + 0.5 * (smooth - p)).astype(int).ravel().tolist()
    assert spark.createDataFrame([([1, 2, 3], 2)], "p array<int>, c int").select(rasters.denoised(F.col("p"), F.col("c"), F.lit(1.0)).alias("x")).first().x is None


def test_packed_masks(spark):
    rng = random.Random(4)
    for size, n in ((1, 5), (8, 2), (13, 4), (63, 3), (100, 2)):
        bits = [[rng.randrange(2) for _ in range(size)] for _ in range(n)]
        flat = [b for frame in bits for b in frame]
        data = np.packbits(np.array(flat, np.uint8), bitorder="little").tobytes()
        df = spark.createDataFrame([(flat, i) for i in (*range(n), n + 8)], "b array<int>, i int").withColumn("data", rasters.packed_bytes(F.col("b")))
        s = F.lit(size)
        rows = df.withColumn("m", rasters.packed_frame(F.col("data"), F.col("i"), s)).withColumn("first", rasters.packed_frame(F.col("data"), F.lit(0), s))
        for r in rows.select("data", "i", "m", rasters.mask_bits(F.col("m"), s).alias("bits"), rasters.mask_count(F.col("m")).alias("count"), rasters.mask_overlap(F.col("m"), F.col("first")).alias("both")).collect():
            assert bytes(r.data) == data
            if r.i > n:
                assert r.m is None and r["count"] is None
                continue
            assert r.bits == bits[r.i] and r["count"] == sum(bits[r.i]) and r.both == sum(a & b for a, b in zip(bits[r.i], bits[0], strict=True))
        whole = rasters.masks_joined(rows.where("m is not null").select(F.lit("k").alias("k"), "m"), "k", mask="m").select(rasters.mask_bits(F.col("m"), s).alias("bits")).first()
        assert whole.bits == [max(c) for c in zip(*bits, strict=True)]
