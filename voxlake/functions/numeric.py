"""Pixel and physical-value functions: column expressions that stay in whole-stage code generation.

Null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Window presets in lookup order, as (name, centre, width).
PRESETS = (
    ("Lung", -600.0, 1500.0),
    ("Bone", 400.0, 1800.0),
    ("Soft Tissue", 50.0, 350.0),
    ("Brain", 40.0, 80.0),
    ("Liver", 120.0, 200.0),
    ("Mediastinum", 50.0, 350.0),
    ("Abdomen", 60.0, 400.0),
    ("Spine", 50.0, 250.0),
    ("Pelvis", 40.0, 400.0),
    ("Angiography", 300.0, 600.0),
    ("Pulmonary Embolism", 100.0, 500.0),
    ("Mammography", 2000.0, 4000.0),
    ("PET Scan", 2500.0, 5000.0),
    ("Custom", 0.0, 4096.0),
)

#: Other spellings of preset names, lower-cased.
PRESET_ALIASES = {"softtissue": "Soft Tissue", "pulmonaryembolism": "Pulmonary Embolism", "pe": "Pulmonary Embolism", "mammo": "Mammography", "pet": "PET Scan", "petscan": "PET Scan"}

#: Presets suggested for CT by words in the body part, in the order they are tried.
CT_SUGGESTIONS = (
    (("lung", "chest", "thorax"), ("Lung", "Mediastinum", "Bone", "Soft Tissue")),
    (("brain", "head"), ("Brain", "Bone", "Soft Tissue")),
    (("abdomen", "liver"), ("Abdomen", "Liver", "Soft Tissue")),
    (("spine",), ("Spine", "Bone", "Soft Tissue")),
    (("pelvis",), ("Pelvis", "Bone", "Soft Tissue")),
)
#: Presets suggested for other modalities, and for CT without a known body part.
SUGGESTIONS = {"CT": ("Soft Tissue", "Bone", "Lung", "Brain"), "MG": ("Mammography",), "PT": ("PET Scan",), "MR": ("Brain", "Soft Tissue")}


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def away_from_zero(value: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) + 0.5)


def rescale(stored: Column, slope: Column, intercept: Column) -> Column:
    return slope * stored + intercept


def hu_to_stored(hu: Column, slope: Column, intercept: Column) -> Column:
    """0 where the slope is 0."""
    return F.when(slope == 0, 0.0).otherwise((hu - intercept) / F.when(slope == 0, 1.0).otherwise(slope))


def window_level(value: Column, center: Column, width: Column) -> Column:
    """8-bit grey of a stored value: single precision, clipped, cut off. Null for a width of 0 or less."""
    low, high = (center - width / 2.0).cast("float"), (center + width / 2.0).cast("float")
    factor = F.lit(255.0).cast("float") / F.when(width > 0, high - low)
    scaled = value.cast("float") * factor.cast("float") + (-low) * factor.cast("float")
    return F.floor(clamp(scaled, 0.0, 255.0)).cast("int")


def window_bounds(center: Column, width: Column) -> Column:
    half = (F.greatest(width, F.lit(1.0)) - 1.0) / 2.0
    middle = center - 0.5
    return F.struct((middle - half).alias("low"), (middle + half).alias("high"))


def display_value(modality_value: Column, center: Column, width: Column, inverted: Column) -> Column:
    """8-bit grey of a modality value: double precision, rounded; inverted for MONOCHROME1 or an INVERSE shape."""
    part = clamp((modality_value - (center - width / 2.0)) / F.when(width > 0, width), 0.0, 1.0)
    return F.floor(F.when(inverted, 1.0 - part).otherwise(part) * 255.0 + 0.5).cast("int")


def lut_index(stored: Column, first: Column, size: Column) -> Column:
    """Place in a lookup table, from 0, clamped to its ends."""
    return F.greatest(F.least(stored - first, size - 1), F.lit(0))


def lut_value(stored: Column, first: Column, entries: Column) -> Column:
    return F.get(entries, lut_index(stored, first, F.size(entries)).cast("int"))


def lut_normalized(value: Column, bits: Column) -> Column:
    return value / (F.pow(F.lit(2.0), bits) - 1.0)


def modality_value(stored: Column, slope: Column, intercept: Column, first: Column, entries: Column) -> Column:
    """From the lookup table if there is one, else rescaled."""
    return F.coalesce(lut_value(stored, first, entries).cast("double"), rescale(stored.cast("double"), slope, intercept))


def modality_voxel(value: Column) -> Column:
    """Rounded, and clamped to 16 signed bits."""
    return clamp(away_from_zero(value), -32768.0, 32767.0).cast("int")


def stored_bits(raw: Column, bits_stored: int, high_bit: int, signed: bool) -> Column:
    """The stored bits of a raw sample: shifted down, masked, sign-extended."""
    value = F.shiftright(raw, max(0, high_bit - bits_stored + 1)).bitwiseAND(F.lit((1 << bits_stored) - 1))
    return F.when(value >= 1 << (bits_stored - 1), value - (1 << bits_stored)).otherwise(value) if signed else value


def signed_bias(value: Column) -> Column:
    """Signed 16-bit values moved to 0..65535."""
    return value + 32768


def monochrome1(value: Column, bits: int = 16) -> Column:
    return F.lit((1 << bits) - 1) - value


def scaled_byte(value: Column, bits: Column, inverted: Column) -> Column:
    top = F.pow(F.lit(2.0), bits) - 1.0
    part = clamp(value.cast("double"), 0.0, 1e18)
    part = F.least(part, top) / top
    return F.floor(F.when(inverted, 1.0 - part).otherwise(part) * 255.0 + 0.5).cast("int")


def ybr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Full-range BT.601, rounded and clamped to bytes."""
    byte = lambda v: clamp(F.floor(v + 0.5), 0, 255).cast("int")
    b, r = cb - 128.0, cr - 128.0
    return F.struct(byte(y + 1.402 * r).alias("r"), byte(y - 0.344136 * b - 0.714136 * r).alias("g"), byte(y + 1.772 * b).alias("b"))


def real_world_value(stored: Column, first: Column, last: Column, slope: Column, intercept: Column, table: Column) -> Column:
    """Inside first..last the table's entry, else the linear value; null outside."""
    inside = stored.between(first, last)
    listed = F.get(table, (stored - first).cast("int"))
    return F.when(inside & table.isNotNull(), listed.cast("double")).when(inside, slope * stored + intercept)


def parametric_value(stored: Column, a: Column, b: Column, slope: Column, intercept: Column) -> Column:
    """Bounds in either order; without bounds every value is inside."""
    inside = a.isNull() | b.isNull() | stored.between(F.least(a, b), F.greatest(a, b))
    return F.when(inside, slope * stored + intercept)


def decay_seconds(start: Column, acquired: Column) -> Column:
    """Seconds from injection to acquisition; past midnight a day is added."""
    gap = acquired - start
    return F.when(gap < 0, gap + 86400.0).otherwise(gap)


def decayed_dose(dose: Column, factor: Column, half_life: Column, seconds: Column) -> Column:
    """Divided by an explicit decay factor, else decayed by the half-life."""
    return F.when(dose > 0, F.when(factor > 0, dose / factor).when(half_life > 0, dose * F.pow(F.lit(2.0), -seconds / half_life)))


def size_factor(kind: str, weight_kg: Column, height_m: Column, sex: Column) -> Column:
    """Body-size factor in grams (bsa: square centimetres) for bw, lbm, bsa or ibw; null where something is missing or the factor is not positive."""
    cm = F.when(height_m > 0, height_m * 100.0)
    s = F.upper(F.substring(sex, 1, 1))
    if kind == "bw":
        return weight_kg * 1000.0
    if kind == "bsa":
        factor = 0.007184 * F.pow(weight_kg, F.lit(0.425)) * F.pow(cm, F.lit(0.725)) * 10000.0
    elif kind == "lbm":
        ratio = F.pow(weight_kg / cm, F.lit(2.0))
        factor = F.when(s == "M", 1.10 * weight_kg - 120.0 * ratio).when(s == "F", 1.07 * weight_kg - 148.0 * ratio) * 1000.0
    elif kind == "ibw":
        factor = F.when(s == "M", 48.0 + 1.06 * (cm - 152.0)).when(s == "F", 45.5 + 0.91 * (cm - 152.0)) * 1000.0
    else:
        raise ValueError(f"no such uptake value: {kind}")
    return F.when(factor > 0, factor)


def uptake_value(kind: str, concentration: Column, units: Column, dose: Column, factor: Column) -> Column:
    """Concentration times size factor over dose; GML values are body-weight uptake values already."""
    scaled = F.when((dose > 0) & (factor > 0), concentration * factor / dose)
    return F.when(units == "GML", concentration).otherwise(scaled) if kind == "bw" else scaled


def waveform_value(sample: Column, sensitivity: Column, correction: Column, baseline: Column) -> Column:
    """Null without a sensitivity; a missing correction is 1, a missing baseline 0."""
    return sample * sensitivity * F.coalesce(correction, F.lit(1.0)) + F.coalesce(baseline, F.lit(0.0))


def dose_value(stored: Column, scaling: Column) -> Column:
    return stored * scaling


def slice_projection(position: Column, orientation: Column) -> Column:
    """Distance of a slice along its normal: position times the normalised cross product of the orientation's rows."""
    o = [F.get(orientation, i) for i in range(6)]
    n = [o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3]]
    length = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in n]))
    dot = reduce(lambda a, b: a + b, [F.get(position, i) * n[i] for i in range(3)])
    return F.when(length > 0, dot / length)


def valid_orientation(orientation: Column) -> Column:
    """Both rows of unit length within 0.01 and perpendicular within 0.001."""
    o = [F.get(orientation, i) for i in range(6)]
    a = F.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2])
    b = F.sqrt(o[3] * o[3] + o[4] * o[4] + o[5] * o[5])
    dot = o[0] * o[3] + o[1] * o[4] + o[2] * o[5]
    return F.coalesce((F.size(orientation) == 6) & (F.abs(a - 1.0) <= 1e-2) & (F.abs(b - 1.0) <= 1e-2) & (F.abs(dot) <= 1e-3), F.lit(False))


def preset_named(name: Column) -> Column:
    """(name, center, width) of a preset by name or alias, in any case; null if there is none."""
    found = F.lit(None)
    for preset, center, width in PRESETS[:-1]:
        names = [preset.lower(), *(a for a, p in PRESET_ALIASES.items() if p == preset)]
        found = F.when(F.lower(name).isin(names), F.struct(F.lit(preset).alias("name"), F.lit(center).alias("center"), F.lit(width).alias("width"))).otherwise(found)
    return found


def preset_near(center: Column, width: Column, tolerance: float = 50.0) -> Column:
    """Name of the first preset within the tolerance on both values."""
    tests = [F.when((F.abs(F.lit(c) - center) <= tolerance) & (F.abs(F.lit(w) - width) <= tolerance), F.lit(name)) for name, c, w in PRESETS]
    return F.coalesce(*tests)


def suggested_presets(modality: Column, body_part: Column) -> Column:
    names = lambda values: F.array(*map(F.lit, values))
    kind, part = F.upper(modality), F.lower(body_part)
    ct = F.when(F.lit(False), names(("",)))
    for words, presets in CT_SUGGESTIONS:
        ct = ct.when(reduce(lambda a, b: a | b, [part.contains(w) for w in words]), names(presets))
    out = F.when(kind == "CT", ct.otherwise(names(SUGGESTIONS["CT"])))
    for m in ("MG", "PT", "MR"):
        out = out.when(kind == m, names(SUGGESTIONS[m]))
    return out.otherwise(names(("Custom",)))


def chosen_window(decoder_center: Column, decoder_width: Column, centers: Column, widths: Column) -> Column:
    """The window of a header that lists several: the decoder's if its width is positive, else the second pair (the only one of one) if it is valid, else the first valid one."""
    pairs = F.slice(F.arrays_zip(centers.alias("c"), widths.alias("w")), F.lit(1), F.least(F.size(centers), F.size(widths)))
    valid = lambda p: p["c"].isNotNull() & (p["w"] > 0)
    preferred = F.when(F.size(pairs) > 1, F.get(pairs, 1)).otherwise(F.get(pairs, 0))
    given = F.struct(decoder_center.alias("c"), decoder_width.alias("w"))
    return F.when(decoder_center.isNotNull() & (decoder_width > 0), given).when(valid(preferred), preferred).otherwise(F.get(F.filter(pairs, valid), 0))


def recommended_window(center: Column, width: Column, modality: Column, low: Column, high: Column) -> Column:
    """The header's window, else for MR the full range, else soft tissue."""
    span = F.greatest(high - low, F.lit(1.0))
    return F.when(width > 0, F.struct(center.alias("center"), width.alias("width"))).when(F.upper(modality) == "MR", F.struct(((low + high) / 2.0).alias("center"), span.alias("width"))).otherwise(F.struct(F.lit(50.0).alias("center"), F.lit(350.0).alias("width")))


def frame_rate(recommended: Column, cine: Column, frame_ms: Column) -> Column:
    return F.coalesce(F.when(recommended > 0, recommended), F.when(cine > 0, cine), F.when(frame_ms > 0, 1000.0 / F.when(frame_ms > 0, frame_ms)))


def duration_seconds(vector_ms: Column, frames: Column, frame_ms: Column, rate: Column) -> Column:
    """Sum of the frame time vector, else frames times the frame time, else frames over the rate."""
    total = F.when(F.size(vector_ms) > 0, F.aggregate(vector_ms, F.lit(0.0), lambda a, x: a + x) / 1000.0)
    return F.coalesce(total, F.when(frame_ms > 0, frames * frame_ms / 1000.0), F.when(rate > 0, frames / F.when(rate > 0, rate)))


def thumbnail(pixels: Column, columns: Column, width: int, height: int, rows: Column) -> Column:
    """Nearest pixels of a smaller picture, row by row."""
    place = lambda k: F.floor(F.floor(k / width) * rows / height).cast("int") * columns + F.floor((k % width) * columns / width).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: F.get(pixels, place(k).cast("int")))


def stretched(pixels: Column) -> Column:
    """Pixels scaled so that the least is 0 and the greatest 255; even pictures become 0."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return F.transform(pixels, lambda p: F.when(high > low, F.floor((p - low) * 255.0 / (high - low) + 0.5)).otherwise(0).cast("int"))
