"""Colour pictures: photometric interpretations, lookup tables and packed samples, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import lut_index, scaled_byte, ybr_to_rgb

#: Photometric interpretation, whether it can be shown, samples, planar configurations, allocated bits.
SUPPORT = (
    ("MONOCHROME1", "display-rgb", 1, (), (8, 16)), ("MONOCHROME2", "display-rgb", 1, (), (8, 16)), ("RGB", "display-rgb", 3, (0, 1), (8, 16)), ("PALETTE COLOR", "display-rgb", 1, (), (8, 16)),
    ("YBR_FULL", "display-rgb", 3, (0, 1), (8,)), ("YBR_FULL_422", "display-rgb", 3, (0,), (8,)), ("YBR_PARTIAL_420", "unsupported", 3, (0,), (8,)), ("YBR_RCT", "unsupported", 3, (0,), (8,)), ("YBR_ICT", "unsupported", 3, (0,), (8,)),
)


def display_support(photometric: Column) -> Column:
    """(status, samples, planar, bits) of an interpretation; unsupported without anything for unknown ones."""
    ints = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    row = lambda status, samples, planar, bits: F.struct(F.lit(status).alias("status"), ints((samples,) if samples else ()).alias("samples"), ints(planar).alias("planar"), ints(bits).alias("bits"))
    out = F.when(F.lit(False), row("", None, (), ()))
    for name, *rest in SUPPORT:
        out = out.when(photometric == name, row(*rest))
    return out.otherwise(row("unsupported", None, (), ()))


def planar_supported(photometric: Column, planar: Column) -> Column:
    """An absent planar configuration is always accepted, another one where it is listed."""
    return F.when(planar.isNull(), True).otherwise(F.array_contains(display_support(photometric)["planar"], F.coalesce(planar.cast("int"), F.lit(-1))))


def ybr_422(samples: Column) -> Column:
    """Pixels (r, g, b) of packed samples Y Y Cb Cr, two for each four."""
    at = lambda i, k: F.get(samples, (F.floor(i / 2) * 4 + k).cast("int")).cast("double")
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / 4).cast("int") * 2 - 1), lambda i: ybr_to_rgb(at(i, i % 2), at(i, 2), at(i, 3)))


def palette(samples: Column, red: Column, green: Column, blue: Column, first: Column) -> Column:
    """Pixels (r, g, b) of three lookup tables whose first entry stands for ``first``; values beyond their ends take the end's entry."""
    entry = lambda table, v: F.get(table, lut_index(v, first, F.size(table)).cast("int"))
    return F.transform(samples, lambda v: F.struct(entry(red, v).alias("r"), entry(green, v).alias("g"), entry(blue, v).alias("b")))


def interleaved(samples: Column, planar: Column) -> Column:
    """Pixels (r, g, b) of three samples each, next to each other or plane by plane."""
    n = F.floor(F.size(samples) / 3).cast("int")
    at = lambda i, k: F.get(samples, F.when(planar == 1, n * k + i).otherwise(i * 3 + k).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*(at(i, k).alias(c) for k, c in enumerate("rgb"))))


def rgb48(samples: Column, bits_allocated: Column) -> Column:
    """Samples of 16 bits: 8-bit ones times 257, others as they are, clamped."""
    wide = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(65535))
    return F.transform(samples, lambda v: F.when(bits_allocated == 8, wide(v) * 257).otherwise(wide(v)).cast("int"))


def display_rgb(samples: Column, photometric: Column, planar: Column, bits_stored: Column, tables: tuple[Column, Column, Column, Column]) -> Column:
    """Pixels (r, g, b) by the photometric interpretation; null where it can't be shown. ``tables``: red, green, blue, first value."""
    byte = lambda v: F.struct(v.cast("int").alias("r"), v.cast("int").alias("g"), v.cast("int").alias("b"))
    grey = F.transform(samples, lambda v: byte(scaled_byte(v, bits_stored, photometric == "MONOCHROME1")))
    scaled = F.transform(samples, lambda v: F.when(bits_stored == 8, v).otherwise(scaled_byte(v, bits_stored, F.lit(False))).cast("int"))
    full = F.transform(interleaved(samples, planar), lambda p: ybr_to_rgb(p["r"].cast("double"), p["g"].cast("double"), p["b"].cast("double")))
    return F.when(photometric.isin("MONOCHROME1", "MONOCHROME2"), grey).when(photometric == "RGB", interleaved(scaled, planar)).when(photometric == "PALETTE COLOR", palette(samples, *tables)).when(photometric == "YBR_FULL", full).when(photometric == "YBR_FULL_422", ybr_422(samples))
