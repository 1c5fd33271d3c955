"""Quantities at pixels, what uptake values lack, and small header values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each kind of uptake value needs of the patient.
PATIENT_NEEDS = {"bw": ("weight",), "lbm": ("weight", "size", "sex"), "bsa": ("weight", "size"), "ibw": ("size", "sex")}
#: Least and greatest value of sample types.
SAMPLE_RANGES = {"signed8": (-128, 127), "unsigned8": (0, 255), "signed16": (-32768, 32767), "unsigned16": (0, 65535), "signed32": (-(2**31), 2**31 - 1), "unsigned32": (0, 2**32 - 1)}


def uptake_diagnostics(kind: str, units: Column, dose: Column, factor: Column, half_life: Column, start: Column, acquired: Column, weight: Column, size: Column, sex: Column) -> Column:
    """What is missing, or not fit, for an uptake value of this kind, in the order of the rules."""
    ready = (units == "GML") if kind == "bw" else F.lit(False)
    fits = (units == "BQML") | ready
    lacks = lambda c, name: F.when(c.isNull(), name)
    known = F.when(sex.startswith("M") | sex.startswith("F"), sex)
    patient = {"weight": weight, "size": size, "sex": known}
    about_units = F.when(units.isNull(), "units").when(~fits, "unsupported_pet_units")
    rest = F.array(lacks(dose, "dose"), *(F.when(factor.isNull(), lacks(c, n)) for c, n in ((half_life, "half_life"), (start, "start"), (acquired, "acquired"))), *(lacks(patient[n], n) for n in PATIENT_NEEDS[kind]))
    return F.array_compact(F.when(F.coalesce(ready, F.lit(False)), F.array(about_units)).otherwise(F.concat(F.array(about_units), rest)))


def missing(required: Column, present: Column) -> Column:
    """Required names that are not present, in their order."""
    return F.array_except(required, present)


def stored_at(samples: Column, pixel: Column, sample: Column, samples_per_pixel: Column, planar: Column) -> Column:
    """The stored sample of a pixel, of interleaved or planar data; null outside."""
    n = F.floor(F.size(samples) / samples_per_pixel)
    inside = (pixel >= 0) & (pixel < n) & (sample >= 0) & (sample < samples_per_pixel)
    return F.when(inside, F.get(samples, F.when(planar == 1, sample * n + pixel).otherwise(pixel * samples_per_pixel + sample).cast("int")))


def quantity_at(stored: Column, slope: Column, intercept: Column, unit: Column, mapped: Column, label: Column, mapped_unit: Column) -> Column:
    """(stored, modality, unit, physical, physical_unit, source) of a stored value; null where there is none."""
    value = F.struct(stored.alias("stored"), (stored * slope + intercept).alias("modality"), unit.alias("unit"), mapped.alias("physical"), F.when(mapped.isNotNull(), mapped_unit).alias("physical_unit"), F.when(mapped.isNotNull(), F.concat(F.lit("map:"), label)).alias("source"))
    return F.when(stored.isNotNull(), value)


def in_sample_range(value: Column, kind: Column) -> Column:
    """Whether a value fits a sample type; null for unknown types."""
    out = F.when(F.lit(False), F.lit(True))
    for name, (low, high) in SAMPLE_RANGES.items():
        out = out.when(kind == name, value.between(low, high))
    return out


def window_number(text: Column) -> Column:
    """The number after the first backslash, or of the whole text without one; 0 for what is no number, so for three values or more."""
    rest = F.when(text.contains("\\"), F.substring(text, F.locate("\\", text) + 1, F.length(text))).otherwise(text)
    return F.coalesce(rest.try_cast("double"), F.lit(0.0))


def spacing_of(text: Column) -> Column:
    """(height, width) of exactly two numbers ``row\\column``; 1 and 1 otherwise."""
    parts = F.filter(F.split(text, r"\\"), lambda p: p != "")
    y, x = (F.get(parts, i).try_cast("double") for i in (0, 1))
    good = F.coalesce((F.size(parts) == 2) & y.isNotNull() & x.isNotNull(), F.lit(False))
    return F.struct(F.when(good, y).otherwise(1.0).alias("height"), F.when(good, x).otherwise(1.0).alias("width"))


def frame_file_name(base: Column, frame: Column, frames: Column, extension: str) -> Column:
    """``base_frameNNNN.ext``: counted from 1, of four digits at least."""
    digits = F.greatest(F.lit(4), F.length(F.greatest(frames, F.lit(1)).cast("string")))
    number = (frame + 1).cast("string")
    return F.concat(base, F.lit("_frame"), F.when(F.length(number) < digits, F.lpad(number, digits, F.lit("0"))).otherwise(number), F.lit(f".{extension}"))


def stored_file_name(sop_uid: Column) -> Column:
    """The identifier with all but letters, numbers and points replaced."""
    return F.concat(F.regexp_replace(sop_uid, r"[^\p{L}\p{N}.]", "_"), F.lit(".dcm"))


def contour_points(data: Column, declared: Column) -> Column:
    """Points of three coordinates each; null without any, or where another number is declared."""
    n = F.floor(F.size(data) / 3).cast("int")
    points = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(data, i * 3 + 1, F.lit(3)))
    return F.when((n > 0) & F.coalesce(declared == n, F.lit(True)), points)


def pixel_range(pixels: Column, first: Column, last: Column, samples: int = 1) -> Column:
    """Samples of the pixels from ``first`` to before ``last``; null where the range is not inside."""
    n = F.floor(F.size(pixels) / samples)
    return F.when((first >= 0) & (last <= n) & (first <= last), F.slice(pixels, (first * samples + 1).cast("int"), ((last - first) * samples).cast("int")))


def resized(pixels: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    """Nearest pixels of another size, row by row; the same array for the same size."""
    if (width, height) == (new_width, new_height):
        return pixels
    place = lambda k: F.least(F.lit(height - 1), F.floor(F.floor(k / new_width) * height / new_height)) * width + F.least(F.lit(width - 1), F.floor((k % new_width) * width / new_width))
    return F.transform(F.sequence(F.lit(0), F.lit(new_width * new_height - 1)), lambda k: F.get(pixels, place(k).cast("int")))
