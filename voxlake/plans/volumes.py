"""Volumes as bricks over the driver's tables: embeddings are the frames of series, parametric maps and multi-frame objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loader, volumes
from .registry import query
from .tables import PIXELS, frames

_VOXELS = f"WITH {PIXELS}, vx AS (SELECT image_id % 50 AS series, image_id, place, CAST(greatest(least(sign(value * 1.5 - 2000) * floor(abs(value * 1.5 - 2000) + 0.5), 32767), -32768) AS INT) AS v FROM px)"


def _mark(values: str) -> Column:
    """A checksum that depends on each value and its place."""
    return F.aggregate(F.transform(values, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _slices(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).select((F.col("image_id") % 50).alias("series_uid"), F.col("image_id").alias("slice_index"), "pixels", F.lit(1.5).alias("slope"), F.lit(-2000.0).alias("intercept"))
    return loader.modality_slices(s)


@query(f"{_VOXELS} SELECT series, min(v) AS low, max(v) AS high FROM vx GROUP BY series")
def volume_ranges(spark: SparkSession, d: str) -> DataFrame:
    return loader.intensity_ranges(_slices(spark, d)).withColumnRenamed("series_uid", "series")


@query(f"""{_VOXELS}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY image_id, place) AS i FROM vx)
SELECT series, count(DISTINCT image_id) AS slices, count(*) AS size, CAST(ceil(count(DISTINCT image_id) / 4) AS BIGINT) AS bricks, CAST(sum(CAST(v AS BIGINT) * i) AS BIGINT) AS mark FROM n GROUP BY series""")
def volume_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Whole volumes out of their bricks: a brick's marks are shifted by the voxels before it."""
    b = volumes.bricks(_slices(spark, d), depth=4)
    before = F.col("byte_offset") / volumes.VOXEL_BYTES
    own = b.select(F.col("series_uid").alias("series"), "slices", F.size("voxels").cast("bigint").alias("size"), (_mark("voxels") + before.cast("bigint") * F.aggregate("voxels", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("mark"))
    return own.groupBy("series").agg(F.sum("slices").alias("slices"), F.sum("size").alias("size"), F.count("*").alias("bricks"), F.sum("mark").alias("mark"))


@query(f"""{_VOXELS}, z AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY image_id) - 1 AS z FROM vx), b AS (SELECT *, CAST(z // 4 AS INT) AS brick, row_number() OVER (PARTITION BY series, z // 4 ORDER BY z, place) AS i FROM z)
SELECT series, brick, min(z) AS first_slice, CAST(count(DISTINCT z) AS INT) AS slices, min(z) * 128 AS byte_offset, CAST(sum(CAST(v AS BIGINT) * i) AS BIGINT) AS mark FROM b GROUP BY series, brick""")
def volume_bricks(spark: SparkSession, d: str) -> DataFrame:
    return volumes.bricks(_slices(spark, d), depth=4).select(F.col("series_uid").alias("series"), "brick", "first_slice", "slices", "byte_offset", _mark("voxels").alias("mark"))


@query(f"""WITH {PIXELS}, f AS (SELECT image_id % 20 AS volume, dense_rank() OVER (PARTITION BY image_id % 20 ORDER BY image_id) - 1 AS z, place, value, image_id % 40 <> 7 AS measured, CASE WHEN image_id % 20 = 3 AND image_id % 40 = 3 THEN 'b' ELSE 'a' END AS u FROM px),
w AS (SELECT volume, bool_and(measured) AS measured, CASE WHEN min(u) = max(u) THEN min(u) END AS units FROM f GROUP BY volume), b AS (SELECT *, row_number() OVER (PARTITION BY volume, z // 4 ORDER BY z, place) AS i FROM f)
SELECT b.volume, CAST(b.z // 4 AS INT) AS brick, CAST(count(DISTINCT b.z) AS INT) AS frames, CAST(sum(CAST(b.value AS BIGINT) * b.i) AS BIGINT) AS mark, CASE WHEN any_value(w.measured) THEN sum(b.value * 0.5::DOUBLE) END AS physical, any_value(w.units) AS units
FROM b JOIN w ON w.volume = b.volume GROUP BY b.volume, b.z // 4""")
def parametric_volumes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("image_id")
    f = frames(spark, d).select((k % 20).alias("volume"), k.alias("frame"), "pixels", F.when(k % 40 != 7, F.transform("pixels", lambda p: p * 0.5)).alias("physical"), F.when((k % 20 == 3) & (k % 40 == 3), "b").otherwise("a").alias("units"))
    b = volumes.scalar_bricks(f, depth=4)
    return b.select("volume", "brick", F.col("slices").alias("frames"), _mark("pixels").alias("mark"), F.aggregate("physical", F.lit(0.0), lambda a, x: a + x).alias("physical"), "units")


#: Objects of each remainder of 7: 0 whole, 1 two frames at each place, 2 a frame without directions, 3 one step too long, 4 in colour, 5 from the last frame to the first, 6 a frame turned.
_ENHANCED = f"""WITH {PIXELS}, fr AS (
  SELECT DISTINCT image_id, image_id % 50 AS object, image_id // 50 AS frame, image_id % 50 % 7 AS kind FROM px
), g AS (
  SELECT object, frame, kind, CASE kind WHEN 1 THEN (frame // 2) * 2.5 WHEN 3 THEN frame * 2.5 + CASE WHEN frame >= 2 THEN 0.4 ELSE 0 END WHEN 5 THEN frame * -3.0 ELSE frame * 2.5 + (frame % 2) * 0.01 END::DOUBLE AS z,
    NOT (kind = 2 AND frame = 3) AS directed, kind = 6 AND frame = 2 AS turned, CASE WHEN frame % 3 = 0 THEN 2.0 END AS own FROM fr
), o AS (
  SELECT *, row_number() OVER (PARTITION BY object ORDER BY CASE WHEN directed THEN CASE WHEN turned THEN 0 ELSE z END END NULLS LAST, frame) - 1 AS place FROM g
), st AS (SELECT *, CASE WHEN directed THEN CASE WHEN turned THEN 0 ELSE z END END AS p FROM o
), d AS (SELECT *, p - lag(p) OVER (PARTITION BY object ORDER BY place) AS step FROM st
), m AS (
  SELECT object, any_value(kind) AS kind, count(*) AS depth, list_sort(list(step) FILTER (WHERE step IS NOT NULL))[count(step) // 2 + 1] AS median, min(step) AS least, max(step) AS most, bool_or(NOT directed) AS undirected, bool_or(turned) AS turned, min(z) FILTER (WHERE place = 0) AS z0, min(own) FILTER (WHERE place = 0) AS own
  FROM d GROUP BY object
), e AS (
  SELECT *, CASE WHEN depth < 2 THEN 'a single frame' WHEN kind = 4 THEN 'not grey' WHEN undirected THEN 'no plane orientation' WHEN turned THEN 'inconsistent orientation' WHEN least <= 1e-9 THEN 'duplicate slice position'
    WHEN greatest(most - median, median - least) > greatest(0.01, median * 0.05) THEN 'variable slice spacing' END AS error FROM m
)"""


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, functional groups and pixels."""
    k = F.col("image_id")
    f = frames(spark, d).select((k % 50).alias("object"), F.floor(k / 50).alias("frame"), (k % 50 % 7).alias("kind"), "pixels")
    frame, kind = F.col("frame"), F.col("kind")
    z = F.when(kind == 1, F.floor(frame / 2) * 2.5).when(kind == 3, frame * 2.5 + F.when(frame >= 2, 0.4).otherwise(0.0)).when(kind == 5, frame * -3.0).otherwise(frame * 2.5 + (frame % 2) * 0.01)
    vector = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    directed = ~((kind == 2) & (frame == 3))
    groups = f.select(
        "object", "frame", F.lit(None).cast("string").alias("stack_id"), F.lit(None).cast("int").alias("in_stack"), F.array(F.lit(-1.0), F.lit(-2.0), z.cast("double")).alias("position"),
        F.when(directed, F.when((kind == 6) & (frame == 2), vector(0, 0, 1)).otherwise(vector(1, 0, 0))).alias("row"), F.when(directed, vector(0, 1, 0)).alias("column"), F.array(F.lit(0.5), F.lit(0.25)).alias("spacing"),
        F.lit(None).cast("double").alias("between"), F.lit(9.0).alias("thickness"), F.when(frame % 3 == 0, 2.0).alias("slope"), F.lit(None).cast("double").alias("intercept"),
    )
    objects = f.groupBy("object", "kind").agg(F.count("*").alias("frames")).select(
        "object", "frames", F.when(kind == 4, 3).otherwise(1).alias("samples"), F.lit("MONOCHROME2").alias("photometric"), F.lit(16).alias("bits_allocated"), (F.col("object") % 2 == 1).alias("signed"), F.lit(1.0).alias("slope"), F.lit(-10.0).alias("intercept")
    )
    # Values of 12 bits as such of 16, below zero in signed objects.
    return objects, groups, f.select("object", "frame", F.transform("pixels", lambda p: p * 16 - F.when(F.col("object") % 2 == 1, 32768).otherwise(0)).alias("pixels"))


@query(f"""{_ENHANCED} SELECT object, error, CASE WHEN error IS NULL THEN depth END AS depth, CASE WHEN error IS NULL THEN round(median, 6) END AS z_spacing, CASE WHEN error IS NULL THEN 0.25 END::DOUBLE AS x_spacing, CASE WHEN error IS NULL THEN round(z0, 6) END AS z_origin, CASE WHEN error IS NULL THEN 1.0 END::DOUBLE AS normal, CASE WHEN error IS NULL THEN coalesce(own, 1.0) END::DOUBLE AS slope FROM e""")
def enhanced_volumes(spark: SparkSession, d: str) -> DataFrame:
    objects, groups, _ = _objects(spark, d)
    g = volumes.enhanced_geometry(objects, groups)
    return g.select("object", "error", "depth", F.round(F.get("spacing", 2), 6).alias("z_spacing"), F.get("spacing", 0).alias("x_spacing"), F.round(F.get("origin", 2), 6).alias("z_origin"), F.get("directions", 8).alias("normal"), "slope")


@query(f"""{_ENHANCED}, b AS (
  SELECT o.object, o.place AS z, CAST(o.place // 4 AS INT) AS brick, o.own, px.place, px.value * 16 - CASE WHEN o.object % 2 = 1 THEN 32768 WHEN px.value * 16 > 32767 THEN 65536 ELSE 0 END AS v, row_number() OVER (PARTITION BY o.object, o.place // 4 ORDER BY o.place, px.place) AS i
  FROM o JOIN e ON e.object = o.object AND e.error IS NULL JOIN px ON px.image_id = o.frame * 50 + o.object
) SELECT object, brick, min(z) AS first_slice, CAST(count(DISTINCT z) AS INT) AS slices, min(z) * 128 AS byte_offset, CAST(sum(CAST(v AS BIGINT) * i) AS BIGINT) AS mark, sum(CASE WHEN place = 0 THEN coalesce(own, 1.0) END)::DOUBLE AS slopes FROM b GROUP BY object, brick""")
def enhanced_bricks(spark: SparkSession, d: str) -> DataFrame:
    objects, groups, pixels = _objects(spark, d)
    b = volumes.enhanced_bricks(objects, groups, pixels, depth=4)
    return b.select("object", "brick", "first_slice", "slices", "byte_offset", _mark("voxels").alias("mark"), F.aggregate("slopes", F.lit(0.0), lambda a, x: a + x).alias("slopes"))
