"""Values of data elements as bytes, in columns: explicit representations, least byte first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Representations with 32-bit lengths, and those that are padded with NUL.
LONG_VR = ("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV")
NUL_PADDED = ("UI", "OB", "UN")
#: Bytes of a number.
WIDTH = {"US": 2, "SS": 2, "UL": 4, "SL": 4, "FL": 4, "AT": 4}


def _turned(digits: Column, width: int) -> Column:
    """Hexadecimal digits of a number, least byte first."""
    return F.concat(*(F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1)))


def _hex(number: Column, width: int) -> Column:
    """The low ``width`` bytes of a whole number, as hexadecimal digits."""
    return _turned(F.lpad(F.hex(number.cast("bigint").bitwiseAND(F.lit((1 << 8 * width) - 1).cast("bigint"))), 2 * width, "0"), width)


def number(value: Column, width: int) -> Column:
    """The low ``width`` bytes of a whole number."""
    whole = value.cast("bigint")
    return F.encode(F.concat(*(F.chr(F.shiftright(whole, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))) for i in range(width))), "ISO-8859-1")


def single_bits(value: Column) -> Column:
    """The bits of a number in single precision, as a whole number."""
    x = value.cast("float").cast("double")
    size = F.abs(x)
    whole = lambda c: c.cast("bigint")
    near = F.floor(F.log2(size))
    exponent = F.greatest(F.lit(-126), near + F.when(size >= F.pow(F.lit(2.0), near + 1), 1).when(size < F.pow(F.lit(2.0), near), -1).otherwise(0))
    scaled = size / F.pow(F.lit(2.0), exponent)
    fraction = F.when(scaled >= 1, whole((scaled - 1) * (1 << 23)) + (whole(exponent) + 127) * (1 << 23)).otherwise(whole(scaled * (1 << 23)))
    bits = F.when(F.isnan(x), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).when(size == 0, F.lit(0)).otherwise(fraction)
    # Zero below zero is written as zero.
    return bits + F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0))


def numbers(values: Column, vr: str) -> Column:
    """An array of numbers as the value of an element; null stays null."""
    width = WIDTH[vr]
    one = {"FL": lambda v: _hex(single_bits(v), 4), "AT": lambda v: F.concat(_hex(F.shiftright(v, 16), 2), _hex(v, 2))}.get(vr, lambda v: _hex(v, width))
    return F.unhex(F.array_join(F.transform(values, one), ""))


def texts(values: Column) -> Column:
    """A text, or an array of texts divided by backslashes, in UTF-8."""
    return F.encode(values, "UTF-8")


def decimal(value: Column) -> Column:
    """A number as a decimal string."""
    return value.cast("double").cast("string")


def tag_bytes(tag: Column) -> Column:
    """A tag of eight hexadecimal digits."""
    return F.concat(F.unhex(_turned(F.substring(tag, 1, 4), 2)), F.unhex(_turned(F.substring(tag, 5, 4), 2)))


def padded(vr: Column, value: Column) -> Column:
    """A value of even length."""
    return F.when(F.octet_length(value) % 2 == 0, value).otherwise(F.concat(value, F.when(vr.isin(list(NUL_PADDED)), F.lit(b"\0")).otherwise(F.lit(b" "))))


def head(tag: Column, vr: Column, length: Column) -> Column:
    """What stands before an element's value."""
    long = F.concat(F.lit(b"\0\0"), number(length, 4))
    return F.concat(tag_bytes(tag), F.encode(vr, "UTF-8"), F.when(vr.isin(list(LONG_VR)), long).otherwise(number(length, 2)))


def element(tag: str, vr: str, value: Column) -> Column:
    """An element of a value that is bytes; null without one."""
    long = vr in LONG_VR
    start = bytes.fromhex(f"{tag[2:4]}{tag[:2]}{tag[6:]}{tag[4:6]}") + vr.encode() + b"\0\0" * long
    odd = F.octet_length(value) % 2
    return F.concat(F.lit(start), number(F.octet_length(value) + odd, 4 if long else 2), value, F.when(odd == 1, F.lit(b"\0" if vr in NUL_PADDED else b" ")).otherwise(F.lit(b"")))


def item_head(length: Column) -> Column:
    return F.concat(F.lit(b"\xfe\xff\x00\xe0"), number(length, 4))


def joined(parts: Column) -> Column:
    """An array of byte strings, one after the other."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))
