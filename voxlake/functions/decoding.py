"""Values of data elements out of their bytes, in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a number, and whether it is signed.
WHOLE = {"US": (2, False), "SS": (2, True), "UL": (4, False), "SL": (4, True), "AT": (2, False)}
REAL = {"FL": (4, 8, 23), "OF": (4, 8, 23), "FD": (8, 11, 52), "OD": (8, 11, 52)}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in ``use`` or in functions of elements there."""
    return F.get(F.transform(F.array(value), use), 0)


def _words(data: Column, width: int, big: bool = False) -> Column:
    """Hexadecimal digits of each number of ``width`` bytes, most significant first; bytes left over are dropped."""
    count = F.floor(F.octet_length(data) / width).cast("int")
    order = range(width) if big else range(width - 1, -1, -1)
    word = lambda digits, i: F.concat(*(F.substring(digits, 2 * width * i + 2 * b + 1, F.lit(2)) for b in order))
    words = bound(F.hex(data), lambda digits: F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: word(digits, i)))
    return F.when(count > 0, words).otherwise(F.array().cast("array<string>"))


def whole_numbers(data: Column, width: int, signed: bool = False, big: bool = False) -> Column:
    """Bytes as an array of whole numbers of up to four bytes."""
    top = 1 << 8 * width
    value = lambda w: F.conv(w, 16, 10).cast("bigint")
    return F.transform(_words(data, width, big), lambda w: F.when(value(w) >= top // 2, value(w) - top).otherwise(value(w)) if signed else value(w))


def real_numbers(data: Column, vr: str, big: bool = False) -> Column:
    """Bytes as an array of binary floating-point numbers."""
    width, exponents, fractions = REAL[vr]
    bias, most = (1 << exponents - 1) - 1, (1 << exponents) - 1

    def value(word: Column) -> Column:
        low = F.conv(F.substring(word, -8, 8), 16, 10).cast("bigint")
        high = F.conv(F.substring(word, 1, 8), 16, 10).cast("bigint") if width == 8 else low
        shift = fractions - 32 if width == 8 else fractions
        negative, exponent = high >= 1 << 31, F.shiftright(high, shift).bitwiseAND(F.lit(most))
        part = high.bitwiseAND(F.lit((1 << shift) - 1).cast("bigint"))
        fraction = (part.cast("double") * float(1 << 32) + low if width == 8 else part.cast("double")) / float(1 << fractions)
        size = F.when(exponent == most, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(1 - bias))).otherwise((fraction + 1) * F.pow(F.lit(2.0), exponent - bias))
        return F.when(negative, -size).otherwise(size)

    return F.transform(_words(data, width, big), value)
