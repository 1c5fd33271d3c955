"""Order, spacing and consistency of a series' slices; one row per slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key


def _order(projection: str, number: str, name: str | None) -> list:
    last = [natural_key(F.col(name)), F.col(name)] if name else []
    return [F.asc_nulls_last(projection), F.asc_nulls_last(number), *last]


def ordered(slices: DataFrame, series: str = "series_uid", projection: str = "projection", number: str = "instance_number", name: str | None = "file_name") -> DataFrame:
    """``slice_index`` from 0: by projection, instance number, natural file name; missing values last."""
    w = Window.partitionBy(series).orderBy(*_order(projection, number, name))
    return slices.withColumn("slice_index", F.row_number().over(w) - 1)


def deltas(slices: DataFrame, series: str, projection: str, *ties: str) -> DataFrame:
    """``delta``: distance to the slice before."""
    w = Window.partitionBy(series).orderBy(F.asc_nulls_last(projection), *ties)
    return slices.withColumn("delta", F.abs(F.col(projection) - F.lag(projection).over(w)))


def spacing(slices: DataFrame, series: str = "series_uid", projection: str = "projection", absolute: float = 0.05, relative: float = 0.02) -> DataFrame:
    """(series, spacing, max_deviation, variable): the median of positive distances; variable if one is off by more than the larger tolerance.

    Null for a single slice, or without positions. Distances and deviations are summed per series with two shuffles on the same key, which Spark makes one.
    """
    positive = deltas(slices, series, projection).where("delta > 0").select(series, "delta")
    w = Window.partitionBy(series)
    off = positive.withColumn("median", F.median("delta").over(w)).withColumn("off", F.abs(F.col("delta") - F.col("median")))
    found = off.groupBy(series).agg(F.first("median").alias("spacing"), F.max("off").alias("max_deviation"))
    out = slices.select(series).distinct().join(found, series, "left")
    return out.withColumn("variable", F.col("max_deviation") > F.greatest(F.lit(absolute), F.col("spacing") * relative))


def duplicates(slices: DataFrame, series: str = "series_uid", projection: str = "projection", tolerance: float = 1e-3) -> DataFrame:
    """(series, duplicated): whether two neighbours stand at one place."""
    return deltas(slices, series, projection).groupBy(series).agg(F.coalesce(F.bool_or(F.col("delta") <= tolerance), F.lit(False)).alias("duplicated"))


def consistent(slices: DataFrame, columns: list[str], series: str = "series_uid") -> DataFrame:
    """(series, inconsistent): the columns in which the slices of a series differ."""
    differ = [F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) > 1, F.lit(c)) for c in columns]
    return slices.groupBy(series).agg(F.array_compact(F.array(*differ)).alias("inconsistent"))


def first_window(slices: DataFrame, series: str = "series_uid", order: tuple[str, ...] = ("slice_index",), center: str = "center", width: str = "width") -> DataFrame:
    """(series, center, width) of the first slice that has both."""
    both = slices.where(F.col(center).isNotNull() & F.col(width).isNotNull())
    return both.groupBy(series).agg(F.min_by(F.struct(F.col(center).alias("center"), F.col(width).alias("width")), F.struct(*order)).alias("w")).select(series, "w.center", "w.width")


def neighbours(slices: DataFrame, series: str, item: str, *order: str) -> DataFrame:
    """``previous`` and ``next`` of each slice; the ends stay where they are."""
    w = Window.partitionBy(series).orderBy(*order)
    return slices.withColumns({"previous": F.coalesce(F.lag(item).over(w), F.col(item)), "next": F.coalesce(F.lead(item).over(w), F.col(item))})


def spatial_order(frames: DataFrame, image: str = "image_id") -> DataFrame:
    """``place`` of each frame: by stack, position along the normal, position in the stack, frame number."""
    w = Window.partitionBy(image).orderBy(F.coalesce("stack_id", F.lit("")), F.asc_nulls_last("projection"), F.asc_nulls_last("in_stack"), "frame")
    return frames.withColumn("place", F.row_number().over(w) - 1)


def temporal_order(frames: DataFrame, image: str = "image_id") -> DataFrame:
    w = Window.partitionBy(image).orderBy(F.asc_nulls_last("temporal_index"), F.asc_nulls_last("acquisition_number"), "frame")
    return frames.withColumn("place", F.row_number().over(w) - 1)


def flat_hierarchy(records: DataFrame, directory: str, ordinal: str, kind: str = "type", key: str = "key") -> DataFrame:
    """Image records of a flat list with the patient, study and series that stand before them; a new parent clears the levels below."""
    w = Window.partitionBy(directory).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    levels = ("PATIENT", "STUDY", "SERIES")
    out = records
    for i, level in enumerate(levels):
        # The last record of this level or above: a level above clears the key.
        stamp = F.when(F.col(kind) == level, F.struct(F.col(key).alias("k"))).when(F.col(kind).isin(list(levels[:i])), F.struct(F.lit(None).cast("string").alias("k")))
        out = out.withColumn(level.lower(), F.last(stamp, ignorenulls=True).over(w)["k"])
    return out.where(F.col(kind) == "IMAGE")
