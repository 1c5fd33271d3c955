"""Catalogues of studies, series and instances: rows with defaults, groups, merges and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, modality_of

#: SOP classes of objects that are not plain images, with their labels.
OBJECT_KINDS = {
    "1.2.840.10008.5.1.4.1.1.66.4": "SEG",
    "1.2.840.10008.5.1.4.1.1.481.3": "RTSTRUCT",
    "1.2.840.10008.5.1.4.1.1.481.2": "RTDOSE",
    "1.2.840.10008.5.1.4.1.1.481.5": "RTPLAN",
    "1.2.840.10008.5.1.4.1.1.30": "Parametric Map",
    "1.2.840.10008.5.1.4.1.1.88.11": "SR",
    "1.2.840.10008.5.1.4.1.1.88.22": "SR",
    "1.2.840.10008.5.1.4.1.1.88.33": "SR",
    "1.2.840.10008.5.1.4.1.1.88.34": "SR",
    "1.2.840.10008.5.1.4.1.1.88.59": "KOS",
    "1.2.840.10008.5.1.4.1.1.104.1": "Document",
    "1.2.840.10008.5.1.4.1.1.104.2": "Document",
    "1.2.840.10008.5.1.4.1.1.104.3": "Document",
    "1.2.840.10008.5.1.4.1.1.9.1.1": "Waveform",
    "1.2.840.10008.5.1.4.1.1.9.1.2": "Waveform",
    "1.2.840.10008.5.1.4.1.1.9.1.3": "Waveform",
    "1.2.840.10008.5.1.4.1.1.9.2.1": "Waveform",
    "1.2.840.10008.5.1.4.1.1.77.1.1.1": "Video",
    "1.2.840.10008.5.1.4.1.1.77.1.2.1": "Video",
    "1.2.840.10008.5.1.4.1.1.77.1.4.1": "Video",
}


def or_default(column: str | Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def study_metadata(files: DataFrame) -> DataFrame:
    """The flat row of each file, with the scanner's defaults; files without study or series are left out."""
    return files.where((F.coalesce("study_uid", F.lit("")) != "") & (F.coalesce("series_uid", F.lit("")) != "")).select(
        "file_path", or_default("patient_name", "Unknown Patient").alias("patient_name"), or_default("patient_id", "Unknown ID").alias("patient_id"), or_default("patient_sex", "").alias("patient_sex"),
        or_default("patient_age", "Unknown").alias("patient_age"), "study_uid", or_default("study_date", "Unknown Date").alias("study_date"), or_default("study_description", "").alias("study_description"), "series_uid",
        or_default("modality", "OT").alias("modality"), F.coalesce(F.col("instance_number").try_cast("int"), F.lit(0)).alias("instance_number"), or_default("body_part", "").alias("body_part"),
        or_default("institution", "Unknown Location").alias("institution"), "file_size",
    )


def object_kind(sop_class: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in OBJECT_KINDS.items() for x in pair])
    return F.try_element_at(kinds, sop_class)


def is_special(sop_class: Column) -> Column:
    return F.coalesce(sop_class.isin(list(OBJECT_KINDS)), F.lit(False))


def catalog_row(files: DataFrame) -> DataFrame:
    """The catalogue's row of each file: other defaults, and identifiers from the path where the file has none."""
    path = F.col("file_path")
    own = lambda c, kind: F.coalesce(blank_to_null(F.col(c)), F.concat(F.lit(f"file-{kind}-"), path))
    return files.select(
        "file_path", F.coalesce(blank_to_null(F.col("patient_name")), F.lit("Unknown")).alias("patient_name"), *(F.coalesce(blank_to_null(F.col(c)), F.lit("")).alias(c) for c in ("patient_id", "study_date", "study_description", "series_description")),
        own("study_uid", "study").alias("study_uid"), own("series_uid", "series").alias("series_uid"), own("sop_uid", "instance").alias("sop_uid"), F.coalesce(blank_to_null(F.col("modality")), F.lit("OT")).alias("modality"),
        F.coalesce(blank_to_null(F.col("sop_class_uid")), F.lit("")).alias("sop_class_uid"), "instance_number", "file_size",
        F.coalesce((F.col("columns") > 0) & (F.col("rows") > 0), F.lit(False)).__and__(~is_special(F.col("sop_class_uid"))).alias("has_pixels"),
    )


def merged(directory: DataFrame, files: DataFrame, columns: list[str], on: str = "file_path") -> DataFrame:
    """Directory records with what their files say, where they say something; records without a file stay."""
    f = files.select(on, *(F.col(c).alias(f"__{c}") for c in columns))
    found = lambda c: F.coalesce(blank_to_null(F.col(f"__{c}").cast("string")), blank_to_null(F.col(c).cast("string"))).alias(c)
    return directory.join(f, on, "left").select(on, *map(found, columns))


def catalog_order(order_path: str = "file_path") -> list[Column]:
    """Six text keys; the instance number padded to eight signs, missing ones as empty text."""
    number = F.col("instance_number")
    padded = F.when(number < 0, F.concat(F.lit("-"), F.lpad((-number).cast("string"), 7, "0"))).otherwise(F.lpad(number.cast("string"), 8, "0"))
    return [F.coalesce("patient_name", F.lit("")), F.coalesce("study_date", F.lit("")), F.coalesce("study_uid", F.lit("")), F.coalesce("series_uid", F.lit("")), F.coalesce(padded, F.lit("")), F.coalesce(order_path, "sop_uid")]


def group_studies(rows: DataFrame, study: str = "study_uid", series: str = "series_uid") -> DataFrame:
    """Files and different series of each study."""
    return rows.groupBy(study).agg(F.count("*").alias("files"), F.count_distinct(series).alias("series"))


def group_by_modality(rows: DataFrame, modality: str = "modality") -> DataFrame:
    return rows.groupBy(F.coalesce(modality_of(F.col(modality)), F.lit("UNKNOWN")).alias("modality")).agg(F.count("*").alias("n"))


def group_by_date(rows: DataFrame, date: Column) -> DataFrame:
    """Counts by day, written as ``Feb 3, 2026``; without a date Unknown Date."""
    return rows.groupBy(F.coalesce(F.date_format(date, "MMM d, yyyy"), F.lit("Unknown Date")).alias("day")).agg(F.count("*").alias("n"))


def one_per_patient(rows: DataFrame, study: str = "study_uid", patient: str = "patient_id", order: list[str] | None = None) -> DataFrame:
    """The first row of each study and patient."""
    rank = F.row_number().over(Window.partitionBy(study, patient).orderBy(*(order or [study])))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def study_line(description: Column, body_part: Column, modality: Column, images: Column) -> Column:
    """Description or body part, modality and number of images, with dots between."""
    count = F.when(images > 0, F.concat(images.cast("string"), F.when(images == 1, " image").otherwise(" images")))
    return F.concat_ws(" • ", F.coalesce(blank_to_null(description), blank_to_null(body_part)), blank_to_null(modality), count)
