"""Smoothing, drawing and packed masks over the driver's pictures of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rasters
from .registry import query
from .tables import PIXELS, frames

_BYTES = f"{PIXELS}, b AS (SELECT image_id, place, CAST(floor(value / 16.0) AS INT) AS v, place % 8 AS x, place // 8 AS y FROM px)"


def _grey(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("image_id", F.lit(8).alias("columns"), F.transform("pixels", lambda v: F.floor(v / 16).cast("int")).alias("pixels"))


def _mark(values: str) -> F.Column:
    return F.aggregate(F.transform(values, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)


@query(f"""WITH {_BYTES}, k AS (SELECT dx, dy, (2 - abs(dx)) * (2 - abs(dy)) AS w FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) c(dy)),
s AS (SELECT b.image_id, b.place, any_value(b.v) AS v, sum(k.w * n.v) // 16 AS smooth FROM b, k JOIN b n ON n.image_id = b.image_id AND n.x = greatest(0, least(7, b.x + k.dx)) AND n.y = greatest(0, least(7, b.y + k.dy)) GROUP BY b.image_id, b.place)
SELECT image_id, place, CAST(CASE WHEN image_id % 4 = 0 THEN v ELSE floor(v + (CASE image_id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 1.0 END)::DOUBLE * (smooth - v)) END AS INTEGER) AS value FROM s""")
def denoised_frames(spark: SparkSession, d: str) -> DataFrame:
    strength = F.get(F.array(*map(F.lit, (0.1, 0.5, 0.25, 3.0))), (F.col("image_id") % 4).cast("int"))
    out = _grey(spark, d).select("image_id", rasters.denoised(F.col("pixels"), F.col("columns"), strength).alias("p"))
    return out.select("image_id", F.posexplode("p").alias("place", "value"))


#: Two overlays of each image: a line of a corner that depends on the image, two pixels wide, and a half transparent frame.
_LINES = f"""WITH {_BYTES}, o AS (
  SELECT DISTINCT image_id, 0 AS layer, 0 AS ax, 0 AS ay, CAST(image_id % 8 AS INT) AS ex, CAST((image_id // 8) % 8 AS INT) AS ey, 2 AS t, 200 AS red, 10 AS green, 255 AS alpha FROM b
  UNION ALL SELECT DISTINCT image_id, 1, p.ax, p.ay, p.ex, p.ey, 1, 30, 90, 128 FROM b, (VALUES (1, 2, 6, 2), (6, 2, 6, 5), (6, 5, 1, 5), (1, 5, 1, 2)) p(ax, ay, ex, ey)
), s AS (SELECT *, abs(ex - ax) AS dx, abs(ey - ay) AS dy, unnest(range(0, greatest(abs(ex - ax), abs(ey - ay)) + 1)) AS j FROM o
), m AS (SELECT *, CASE WHEN greatest(dx, dy) > 0 THEN (2 * j * least(dx, dy) + greatest(dx, dy)) // (2 * greatest(dx, dy)) ELSE 0 END AS r FROM s
), p AS (SELECT *, ax + (CASE WHEN ax < ex THEN 1 ELSE -1 END) * (CASE WHEN dx >= dy THEN j ELSE r END) AS x, ay + (CASE WHEN ay < ey THEN 1 ELSE -1 END) * (CASE WHEN dx >= dy THEN r ELSE j END) AS y FROM m
), h AS (SELECT image_id, layer, red, green, alpha, x + i.i AS x, y + j2.i AS y FROM p, (VALUES (-1), (0)) i(i), (VALUES (-1), (0)) j2(i) WHERE t = 2 OR (i.i = 0 AND j2.i = 0)
), t AS (SELECT image_id, y * 8 + x AS place, list({{'layer': layer, 'red': red, 'green': green, 'alpha': alpha}} ORDER BY layer) AS hits FROM h WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY ALL)"""


@query(f"""{_LINES}, c AS (SELECT b.image_id, b.place, b.v, t.hits FROM b LEFT JOIN t ON t.image_id = b.image_id AND t.place = b.place), f AS (
  SELECT image_id, place, v, CASE WHEN hits IS NULL THEN v ELSE list_reduce([v] || list_transform(hits, lambda h: h.red * 1000 + h.alpha), lambda u, h: CASE WHEN h % 1000 = 255 THEN h // 1000 ELSE CAST(floor(u * (1 - 128 / 255.0::DOUBLE) + (h // 1000) * (128 / 255.0::DOUBLE) + 0.5) AS INT) END) END AS red,
    CASE WHEN hits IS NULL THEN v ELSE list_reduce([v] || list_transform(hits, lambda h: h.green * 1000 + h.alpha), lambda u, h: CASE WHEN h % 1000 = 255 THEN h // 1000 ELSE CAST(floor(u * (1 - 128 / 255.0::DOUBLE) + (h // 1000) * (128 / 255.0::DOUBLE) + 0.5) AS INT) END) END AS green FROM c)
SELECT image_id, CAST(sum(red * (3 * place + 1) + green * (3 * place + 2) + red * (3 * place + 3)) AS BIGINT) AS mark FROM f GROUP BY image_id""")
def drawn_frames(spark: SparkSession, d: str) -> DataFrame:
    g = _grey(spark, d)
    share = lambda v: (v / 7.0).cast("double")
    n = F.col("image_id")
    overlay = lambda layer, kind, x0, y0, x1, y1, t, red, green, alpha: F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(t).alias("thickness"), F.lit(8).alias("rows"), F.lit(red).alias("red"), F.lit(green).alias("green"), F.lit(red).alias("blue"), F.lit(alpha).alias("alpha"))
    at = lambda k: share(F.lit(k))
    overlays = g.select("image_id", "columns", F.inline(F.array(overlay(0, "line", F.lit(-0.5), at(0), share(n % 8), share(F.floor(n / 8) % 8), 2, 200, 10, 255), overlay(1, "rectangle", at(1), at(2), at(6), at(5), 1, 30, 90, 128))))
    return rasters.drawn(g, overlays).select("image_id", _mark("rgb").alias("mark"))


#: Three masks of 7 x 9 pixels of each image, one after the other without a gap: pixels above a third of the range, odd ones, and the first.
_MASKS = f"""WITH {PIXELS}, q AS (SELECT image_id, place, CAST(value > 2048 AS INT) AS a, value % 2 AS b, CAST(place = 0 AS INT) AS c FROM px WHERE place < 63)"""


def _packed(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("image_id", F.slice("pixels", 1, 63).alias("p"))
    bits = F.concat(F.transform("p", lambda v: F.when(v > 2048, 1).otherwise(0)), F.transform("p", lambda v: v % 2), F.transform("p", lambda _, i: F.when(i == 0, 1).otherwise(0)))
    return f.select("image_id", rasters.packed_bytes(bits).alias("data"))


@query(f"""{_MASKS} SELECT image_id, CAST(sum(a) AS INT) AS first, CAST(sum(b) AS INT) AS second, CAST(sum(c) AS INT) AS third, CAST(sum(a * b) AS INT) AS overlap, CAST(sum(CASE WHEN a = 1 THEN 5 WHEN b = 1 THEN 7 WHEN c = 1 THEN 9 ELSE 0 END * (place + 1)) AS BIGINT) AS labels FROM q GROUP BY image_id""")
def packed_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks that do not begin with a byte: cut out, counted, compared and joined to a map of labels."""
    size = F.lit(63)
    m = _packed(spark, d).select("image_id", *(rasters.packed_frame(F.col("data"), F.lit(i), size).alias(c) for i, c in enumerate("abc")))
    labels = rasters.label_map([F.lit(5), F.lit(7), F.lit(9)], [F.col(c) for c in "abc"], size)
    return m.withColumn("labels", labels).select("image_id", rasters.mask_count(F.col("a")).alias("first"), rasters.mask_count(F.col("b")).alias("second"), rasters.mask_count(F.col("c")).alias("third"), rasters.mask_overlap(F.col("a"), F.col("b")).alias("overlap"), _mark("labels").alias("labels"))


@query(f"""{_MASKS}, g AS (SELECT image_id % 10 AS volume, place, max(a) AS a, max(b) AS b FROM q GROUP BY ALL) SELECT volume, CAST(sum(a) AS INT) AS first, CAST(sum(b) AS INT) AS second, CAST(sum(a * b) AS INT) AS both FROM g GROUP BY volume""")
def joined_masks(spark: SparkSession, d: str) -> DataFrame:
    """What the masks of all images of a volume hold together."""
    size = F.lit(63)
    m = _packed(spark, d).select((F.col("image_id") % 10).alias("volume"), *(rasters.packed_frame(F.col("data"), F.lit(i), size).alias(c) for i, c in enumerate("ab")))
    a, b = (rasters.masks_joined(m.select("volume", F.col(c).alias("mask")), "volume").withColumnRenamed("mask", c) for c in "ab")
    return a.join(b, "volume").select("volume", rasters.mask_count(F.col("a")).alias("first"), rasters.mask_count(F.col("b")).alias("second"), rasters.mask_overlap(F.col("a"), F.col("b")).alias("both"))
