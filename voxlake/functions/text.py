"""String, name, date and identifier functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modalities with their display names.
MODALITIES = {
    "CT": "Computed Tomography",
    "MR": "Magnetic Resonance",
    "DX": "Digital Radiography",
    "CR": "Computed Radiography",
    "US": "Ultrasound",
    "MG": "Mammography",
    "RF": "Radiofluoroscopy",
    "XC": "External Photography",
    "SC": "Secondary Capture",
    "PT": "PET Scan",
    "NM": "Nuclear Medicine",
}

#: Sexes with their labels.
SEXES = {"M": "Male", "F": "Female", "O": "Other"}


def trimmed(value: Column) -> Column:
    """Without white space and NUL at both ends."""
    return F.regexp_replace(value, r"^[\s\x00]+|[\s\x00]+$", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(trimmed(value), F.lit(""))


def multi_values(value: Column) -> Column:
    """Values between backslashes, each trimmed; empty ones stay."""
    return F.transform(F.split(value, r"\\", -1), trimmed)


def person_name(value: Column) -> Column:
    """Alphabetic, ideographic and phonetic groups between ``=``, each of five components between ``^``; empty ones are null."""
    groups = F.split(value, "=", -1)
    parts = ("family", "given", "middle", "prefix", "suffix")
    group = lambda i: F.struct(*(F.nullif(trimmed(F.get(F.split(F.get(groups, i), r"\^", -1), k)), F.lit("")).alias(p) for k, p in enumerate(parts)))
    return F.when(blank_to_null(value).isNotNull(), F.struct(group(0).alias("alphabetic"), group(1).alias("ideographic"), group(2).alias("phonetic")))


def sanitized(value: Column) -> Column:
    """For display: runs of control characters become one space, none after a space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"(?<= )\p{Cntrl}+", ""), r"\p{Cntrl}+", " "))


def modality_of(value: Column) -> Column:
    """A known modality code, else UNKNOWN."""
    return F.when(F.upper(value).isin(list(MODALITIES)), F.upper(value)).otherwise("UNKNOWN")


def modality_label(value: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in MODALITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.upper(value)), F.lit("Unknown"))


def sex_of(value: Column) -> Column:
    """M, F or O, else U."""
    code = F.trim(F.upper(value))
    return F.when(code.isin(list(SEXES)), code).otherwise("U")


def sex_label(value: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SEXES.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, sex_of(value)), F.lit("Unknown"))


def tag_text(tag: Column) -> Column:
    """``(GGGG,EEEE)``."""
    return F.format_string("(%04X,%04X)", F.shiftrightunsigned(tag.cast("int"), 16), tag.cast("int").bitwiseAND(F.lit(0xFFFF)))


def is_private(tag: Column) -> Column:
    return F.shiftrightunsigned(tag.cast("int"), 16) % 2 == 1


def vr_of_entry(entry: Column) -> Column:
    """The first two characters of a dictionary entry."""
    return F.substring(entry, 1, 2)


def xml_escaped(value: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def file_id_path(parts: Column) -> Column:
    """Joined parts of a file id; null if a part is empty, ``.``, ``..`` or holds a separator."""
    unsafe = F.exists(parts, lambda p: p.isNull() | (F.trim(p) == "") | p.isin(".", "..") | p.contains("/") | p.contains("\\"))
    return F.when((F.size(parts) > 0) & ~unsafe, F.array_join(parts, "/"))


def zip_entry_disposition(name: Column) -> Column:
    """skip for folders and hidden metadata, reject for paths that leave the archive, else extract."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return F.when(name.isNull() | (name == "") | name.endswith("/") | name.startswith("__MACOSX/"), "skip").when(name.startswith("/") | F.array_contains(parts, "..") | name.rlike("^[A-Za-z]:"), "reject").otherwise("extract")


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*map(blank_to_null, values))


def joined(sign: str, *values: Column) -> Column:
    """Values that are not blank, trimmed, with the sign between them."""
    return F.concat_ws(sign, *map(blank_to_null, values))


def date_parts(value: Column) -> Column:
    """Year, month and day of eight digits; months 1 to 12, days 1 to 31, whatever the month."""
    v = trimmed(value)
    y, m, d = (F.substring(v, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    return F.when(v.rlike("^[0-9]{8}$") & m.between(1, 12) & d.between(1, 31), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def time_parts(value: Column) -> Column:
    """Hour, minute, second and fraction of ``HH[MM[SS[.F]]]``; a second may be 60."""
    v = trimmed(value)
    form = r"^([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:\.([0-9]{1,6}))?)?)?$"
    h, m, s = (F.nullif(F.regexp_extract(v, form, i), F.lit("")).try_cast("int") for i in (1, 2, 3))
    f = F.nullif(F.regexp_extract(v, form, 4), F.lit(""))
    good = v.rlike(form) & (h <= 23) & (F.coalesce(m, F.lit(0)) <= 59) & (F.coalesce(s, F.lit(0)) <= 60)
    return F.when(good, F.struct(h.alias("hour"), m.alias("minute"), s.alias("second"), F.rpad(f, 6, "0").try_cast("int").alias("microsecond")))


def datetime_parts(value: Column) -> Column:
    """Date, time and offset in minutes of ``YYYYMMDD[time][+-HHMM]``."""
    v = trimmed(value)
    form = r"^([0-9]{8})([0-9.]*)([+-][0-9]{4})?$"
    zone = F.nullif(F.regexp_extract(v, form, 3), F.lit(""))
    minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    date, time = date_parts(F.regexp_extract(v, form, 1)), F.regexp_extract(v, form, 2)
    good = v.rlike(form) & date.isNotNull() & ((time == "") | time_parts(time).isNotNull())
    return F.when(good, F.struct(date.alias("date"), time_parts(F.nullif(time, F.lit(""))).alias("time"), minutes.alias("offset_minutes")))


def age_parts(value: Column) -> Column:
    """Value and unit of three digits and D, W, M or Y."""
    v = F.upper(trimmed(value))
    return F.when(v.rlike("^[0-9]{3}[DWMY]$"), F.struct(F.substring(v, 1, 3).try_cast("int").alias("value"), F.substring(v, 4, 1).alias("unit")))


def seconds_of_day(value: Column) -> Column:
    t = time_parts(value)
    return (t["hour"] * 3600 + F.coalesce(t["minute"], F.lit(0)) * 60 + F.coalesce(t["second"], F.lit(0))).cast("double") + F.coalesce(t["microsecond"], F.lit(0)) / 1e6


def study_datetime(date: Column, time: Column) -> Column:
    """A timestamp of both; midnight without a time; null for days that do not exist."""
    t = time_parts(time)
    zero = lambda c: F.coalesce(c, F.lit(0))
    day = F.try_to_date(trimmed(date), "yyyyMMdd").cast("timestamp")
    return F.timestamp_seconds(F.unix_timestamp(day) + zero(t["hour"]) * 3600 + zero(t["minute"]) * 60 + zero(t["second"]))


def display_date(value: Column) -> Column:
    """``3 Feb 2026`` of a date; a text that is none stays."""
    return F.coalesce(F.date_format(F.try_to_date(trimmed(value), "yyyyMMdd"), "d MMM yyyy"), value)


def display_age(age: Column, birth: Column, as_of: Column) -> Column:
    """The given age, else whole years from birth to ``as_of``, else Unknown."""
    years = F.floor(F.months_between(as_of, F.try_to_date(trimmed(birth), "yyyyMMdd")) / 12)
    return F.coalesce(blank_to_null(age), F.when(years >= 0, F.concat(years.cast("string"), F.lit("Y"))), F.lit("Unknown"))


def natural_key(name: Column) -> Column:
    """File names in natural order: lower case, runs of digits padded to twelve."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 12, "0")).otherwise(r)), "")




def deterministic_uid(uid: Column, root: str = "2.25") -> Column:
    """``root.a.b``: a is the 64-bit FNV-1a hash of the identifier's bytes, b a second hash by multiplication with 31; both wrap around."""
    codes = F.transform(F.filter(F.split(uid, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c))
    # Both hashes are kept as two halves of 32 bits in whole numbers of 64, which no product overflows.
    half = F.lit(0xFFFFFFFF)
    pair = lambda high, low: F.struct((high + F.shiftright(low, 32)).bitwiseAND(half).alias("high"), low.bitwiseAND(half).alias("low"))
    start = lambda n: F.struct(F.lit(n >> 32).cast("bigint").alias("high"), F.lit(n & 0xFFFFFFFF).cast("bigint").alias("low"))
    # An exclusive or with a byte changes the lowest byte alone.
    mixed = lambda low, c: low - low.bitwiseAND(F.lit(255)) + low.bitwiseAND(F.lit(255)).bitwiseXOR(c.cast("bigint"))
    # The prime is 2^40 + 435: its first part moves 24 bits into the high half.
    times = lambda high, low: pair(high * 435 + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8), low * 435)
    whole = lambda h: (h["high"].cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + h["low"].cast("decimal(20,0)")).cast("decimal(38,0)")
    fnv = whole(F.aggregate(codes, start(14695981039346656037), lambda h, c: times(h["high"], mixed(h["low"], c))))
    by31 = whole(F.aggregate(codes, start(11400714819323198485), lambda h, c: pair(h["high"] * 31, h["low"] * 31 + c.cast("bigint"))))
    return F.concat_ws(".", F.lit(root), fnv.cast("string"), by31.cast("string"))
