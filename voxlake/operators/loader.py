"""What a series loader takes, refuses and assembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import modality_voxel, rescale

#: Classes of structured reports and key objects, encapsulated documents, waveforms and videos, which have no slices.
NO_IMAGES = tuple(
    f"1.2.840.10008.5.1.4.1.1.{n}" for n in (
        "88.11", "88.22", "88.33", "88.34", "88.35", "88.59", "88.50", "88.65", "88.69",
        "104.1", "104.2", "104.3",
        "9.1.1", "9.1.2", "9.1.3", "9.1.4", "9.2.1", "9.3.1", "9.5.1", "9.6.1",
        "77.1.1.1", "77.1.2.1", "77.1.4.1",
    )
)
#: Bits, and photometric interpretations, of slices.
BITS, GREY = (8, 16, 32), ("MONOCHROME1", "MONOCHROME2")


def is_image(sop_class: Column, modality: Column, has_waveform: Column) -> Column:
    """False for reports, documents, waveforms and videos."""
    return ~(F.coalesce(sop_class.isin(list(NO_IMAGES)), F.lit(False)) | F.coalesce(modality == "DOC", F.lit(False)) | F.coalesce(has_waveform, F.lit(False)))


def slice_support(bits_allocated: Column, bits_stored: Column, representation: Column, samples: Column, photometric: Column, planar: Column, frames: Column) -> Column:
    """Why a picture can't be a slice: the first of the loader's rules that it breaks; null where it can."""
    rules = (
        (bits_allocated.isin(list(BITS)), "bits allocated"), (bits_stored.isin(list(BITS)), "bits stored"), (representation.isin(0, 1), "pixel representation"), (samples == 1, "samples per pixel"),
        (photometric.isin(list(GREY)), "photometric interpretation"), (frames == 1, "frames"), (planar.isNull(), "planar configuration"),
    )
    return F.coalesce(*(F.when(~F.coalesce(kept, F.lit(False)), name) for kept, name in rules))


def decoder_issues(content: Column) -> Column:
    """(valid, issues): an absent or empty file fails; a short one, or one without the mark, is only warned of."""
    size = F.octet_length(content)
    hard = F.array_compact(F.array(F.when(content.isNull(), "File does not exist"), F.when(size == 0, "File is empty")))
    soft = F.array_compact(F.array(F.when((size > 0) & (size < 132), "File smaller than 132 bytes; DICOM preamble may be missing"), F.when((size >= 132) & (F.substring(content, 129, 4) != F.lit(b"DICM")), "Missing DICM signature at offset 128 (preamble optional)")))
    return F.struct((F.size(hard) == 0).alias("valid"), F.concat(hard, soft).alias("issues"))


def decoder_status(parsed_error: Column, columns: Column, rows: Column, has_pixels: Column, compressed: Column) -> Column:
    """(valid, width, height, has_pixels, compressed) of a file after parsing."""
    read = parsed_error.isNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.struct((read & (zero(columns) > 0) & (zero(rows) > 0)).alias("valid"), zero(columns).alias("width"), zero(rows).alias("height"), (read & F.coalesce(has_pixels, F.lit(False))).alias("has_pixels"), F.coalesce(compressed, F.lit(False)).alias("compressed"))


def modality_slices(slices: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Slices with ``voxels``: each pixel rescaled by its slice, rounded and clamped to 16 signed bits. Frames stay arrays."""
    return slices.withColumn("voxels", F.transform(pixels, lambda p: modality_voxel(rescale(p.cast("double"), F.col("slope"), F.col("intercept"))).cast("int")))


def intensity_ranges(slices: DataFrame, series: str = "series_uid") -> DataFrame:
    """Least and greatest voxel of each series, from each slice's own before the shuffle."""
    return slices.select(series, F.array_min("voxels").alias("low"), F.array_max("voxels").alias("high")).groupBy(series).agg(F.min("low").alias("low"), F.max("high").alias("high"))
