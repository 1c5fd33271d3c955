"""Volumes as bricks: rows of a fixed number of slices with their place in the volume, however large it is.

A brick's voxels are those of its slices one after the other; the bricks of a volume in order are the volume, and ``byte_offset`` says
where a brick's begin in it at two bytes a voxel. No volume is ever one row, and none has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .loader import GREY
from .running import with_running_sums
from .slices import spatial_order

#: Slices of a brick; bytes of a voxel.
DEPTH, VOXEL_BYTES = 16, 2
#: How far directions, and slice distances, may differ within a volume, and the least distance.
SAME_DIRECTION, SAME_DISTANCE, SAME_SHARE, LEAST_DISTANCE = 1e-4, 0.01, 0.05, 1e-9


def numbered(slices: DataFrame, series: str, order: Sequence[str], size: Column) -> DataFrame:
    """(series, order, z, before): the place of each slice, from 0, and the values of its series before it. Pixels stay where they are."""
    slim = slices.select(series, *order, size.cast("bigint").alias("__size"), F.lit(1).cast("bigint").alias("__one"))
    return with_running_sums(slim, [series], list(order), {"z": "__one", "before": "__size"}).drop("__size", "__one")


def bricks(slices: DataFrame, series: str = "series_uid", order: Sequence[str] = ("slice_index",), values: Sequence[str] = ("voxels",), depth: int = DEPTH) -> DataFrame:
    """(series, brick, first_slice, slices, byte_offset, values...) of slices that ``order`` tells apart; each of ``values`` is an array of a slice's values.

    The values are gathered ``depth`` slices at a time. A column whose array is null in a slice is null in its brick.
    """
    placed = slices.join(numbered(slices, series, order, F.size(values[0])), [series, *order])
    rows = placed.select(series, F.floor(F.col("z") / depth).cast("int").alias("brick"), F.struct("z", "before", *values).alias("slice")).groupBy(series, "brick").agg(F.array_sort(F.collect_list("slice")).alias("s"))
    whole = lambda c: F.flatten(F.transform("s", lambda x: x[c])).alias(c)
    return rows.select(series, "brick", F.col("s")[0]["z"].alias("first_slice"), F.size("s").alias("slices"), (F.col("s")[0]["before"] * VOXEL_BYTES).alias("byte_offset"), *map(whole, values))


def volume_sizes(bricked: DataFrame, series: str = "series_uid", values: str = "voxels") -> DataFrame:
    """(series, bricks, slices, size) of each volume."""
    return bricked.groupBy(series).agg(F.count("*").alias("bricks"), F.sum("slices").alias("slices"), F.sum(F.size(values).cast("bigint")).alias("size"))


def scalar_bricks(frames: DataFrame, volume: str = "volume", order: str = "frame", values: str = "pixels", physical: str = "physical", units: str = "units", depth: int = DEPTH) -> DataFrame:
    """Bricks of parametric maps: physical values only where every frame of the volume has them, units only where all agree."""
    own = frames.groupBy(volume).agg((F.count(physical) == F.count("*")).alias("measured"), F.when(F.min(units) == F.max(units), F.min(units)).alias("units"))
    return bricks(frames, volume, [order], [values, physical], depth).join(own, volume).withColumn(physical, F.when(F.col("measured"), F.col(physical))).drop("measured")


def _cross(a: Column, b: Column) -> Column:
    return F.array(*(F.get(a, i) * F.get(b, j) - F.get(a, j) * F.get(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def _dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, i) * F.get(b, i) for i in range(1, 3)), F.get(a, 0) * F.get(b, 0))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((F.get(a, i) - F.get(b, i)) ** 2 for i in range(1, 3)), (F.get(a, 0) - F.get(b, 0)) ** 2))


def _unit(a: Column) -> Column:
    long = F.sqrt(_dot(a, a))
    return F.transform(a, lambda x: x / long)


def enhanced_geometry(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """Whether each multi-frame object is one volume, and which.

    ``objects``: object, frames, samples, photometric, bits_allocated, and slope and intercept where frames have none of their own. ``frames``, its functional groups: object, frame, stack_id,
    in_stack, position (3 numbers), row and column (directions), spacing (row, column), between, thickness, slope, intercept. The
    result has a row for each object: ``error``, the first rule that it breaks, or null and then ``depth, spacing`` (x, y, z),
    ``directions`` (row, column, normal), ``origin, slope, intercept``. The distance of slices is the upper median of the steps in
    spatial order, all of which must be near it; with one frame it is the first frame's own, or 1.
    """
    normal = _cross(F.col("row"), F.col("column"))
    placed = spatial_order(frames.withColumn("projection", F.when(F.col("row").isNotNull(), _dot(F.col("position"), normal))), "object")
    first = Window.partitionBy("object").orderBy("place")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = (_apart(F.first("row").over(whole), F.col("row")) >= SAME_DIRECTION) | (_apart(F.first("column").over(whole), F.col("column")) >= SAME_DIRECTION)
    problem = (
        F.when(F.col("row").isNull() | F.col("column").isNull(), "no plane orientation").when(F.col("position").isNull(), "no plane position").when(F.col("spacing").isNull(), "no pixel spacing").when(turned, "inconsistent orientation")
    )
    stepped = placed.withColumns({"problem": problem, "step": F.col("projection") - F.lag("projection").over(first)})
    steps = Window.partitionBy("object").orderBy(F.asc_nulls_last("step"))
    ranked = stepped.withColumns({"rank": F.row_number().over(steps) - 1, "n_steps": F.count("step").over(Window.partitionBy("object"))})
    middle = F.max(F.when((F.col("rank") == F.floor(F.col("n_steps") / 2)) & (F.col("n_steps") > 0), F.col("step")))
    at_first = lambda c: F.max(F.when(F.col("place") == 0, F.col(c))).alias(f"own_{c}")
    own = ranked.groupBy("object").agg(
        F.count("*").alias("depth"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("problem"), middle.alias("median"), F.min("step").alias("least"), F.max("step").alias("most"),
        *map(at_first, ("position", "row", "column", "spacing", "between", "thickness", "slope", "intercept")),
    )
    off = F.greatest(F.col("most") - F.col("median"), F.col("median") - F.col("least"))
    rules = (
        (F.col("frames") > 1, "a single frame"), ((F.col("samples") == 1) & F.col("photometric").isin(list(GREY)), "not grey"), (F.col("bits_allocated").isin(8, 16), "bits allocated"), (F.col("depth").isNotNull(), "no functional groups"),
        (F.col("depth") >= F.col("frames"), "functional groups do not cover the frames"),
    )
    error = F.coalesce(
        *(F.when(~F.coalesce(kept, F.lit(False)), name) for kept, name in rules), F.col("problem"), F.when(F.col("least") <= LEAST_DISTANCE, "duplicate slice position"),
        F.when(off > F.greatest(F.lit(SAME_DISTANCE), F.col("median") * SAME_SHARE), "variable slice spacing"),
    )
    z = F.coalesce("median", "own_between", "own_thickness", F.lit(1.0))
    shared = lambda c: F.coalesce(f"own_{c}", c) if c in objects.columns else F.col(f"own_{c}")
    row, column = F.col("own_row"), F.col("own_column")
    result = {
        "depth": F.col("depth"), "spacing": F.array(F.get("own_spacing", 1), F.get("own_spacing", 0), z), "directions": F.flatten(F.array(_unit(row), _unit(column), _unit(_cross(row, column)))), "origin": F.col("own_position"),
        "slope": shared("slope"), "intercept": shared("intercept"),
    }
    judged = objects.join(own, "object", "left").withColumn("error", error)
    return judged.select("object", "error", *(F.when(F.col("error").isNull(), c).alias(name) for name, c in result.items()))


def stored_voxel(value: Column, bits: Column, signed: Column) -> Column:
    """A stored value in 16 signed bits: unsigned ones of 16 bits keep their bits, so the greater half turns negative."""
    return F.when((bits == 16) & ~signed & (value > 32767), value - 65536).otherwise(value).cast("smallint")


def enhanced_bricks(objects: DataFrame, frames: DataFrame, pixels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Bricks of the objects that ``enhanced_geometry`` takes, frames in spatial order, with the ``slopes`` and ``intercepts`` of their slices.

    ``pixels``: object, frame, pixels (stored values); ``objects`` has ``signed``, and slope and intercept for frames without their own.
    """
    good = enhanced_geometry(objects, frames).where("error is null").select("object")
    ordered = spatial_order(frames.withColumn("projection", _dot(F.col("position"), _cross(F.col("row"), F.col("column")))), "object").select("object", "frame", "place", F.col("slope").alias("own_slope"), F.col("intercept").alias("own_intercept"))
    kinds = objects.select("object", "bits_allocated", "signed", "slope", "intercept").join(good, "object", "left_semi")
    slices = pixels.join(kinds, "object").join(ordered, ["object", "frame"])
    voxels = F.transform("pixels", lambda p: stored_voxel(p, F.col("bits_allocated"), F.col("signed")))
    one = lambda own, shared: F.array(F.coalesce(own, shared))
    return bricks(slices.select("object", "place", voxels.alias("voxels"), one("own_slope", "slope").alias("slopes"), one("own_intercept", "intercept").alias("intercepts")), "object", ["place"], ["voxels", "slopes", "intercepts"], depth)
