"""Scalar column functions: dates, fixed-point text, bit arithmetic and hashes."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Julian day number of 1970-01-01.
EPOCH_JULIAN_DAY = 2440588


def julian_day(date: Column) -> Column:
    """The Julian day number of a date."""
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date")) + EPOCH_JULIAN_DAY


def from_julian_day(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - EPOCH_JULIAN_DAY).cast("int"))


def parse_date(text: Column) -> Column:
    """A date from yyyy-MM-dd; null if there is none such."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def format_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def parse_numeric(text: Column) -> Column:
    """An amount with two decimals as hundredths: 17, 17.5 and 17.50 agree, signs count, other text is null."""
    return (text.try_cast("decimal(15,2)") * 100).cast("long")


def format_numeric(hundredths: Column) -> Column:
    """Hundredths as text with two decimals."""
    return (hundredths.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").cast("string")


def parse_unsigned(text: Column) -> Column:
    """A whole number that isn't negative; null otherwise."""
    value = text.try_cast("bigint")
    return F.when(value >= 0, value)


def compare_prefix(a: Column, b: Column, n: int) -> Column:
    """-1, 0 or 1: the order of the first n characters."""
    x, y = F.substring(a, 1, n), F.substring(b, 1, n)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def fixed_width(text: Column, n: int) -> Column:
    """The text cut to n characters."""
    return F.substring(text, 1, n)


def saturating_add(a: Column, b: Column, most: int) -> Column:
    return F.least(a + b, F.lit(most))


def floored_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def bit_width(x: Column) -> Column:
    """Bits that a positive number takes; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def leading_zeros(x: Column, width: int = 64) -> Column:
    return F.lit(width) - bit_width(x)


def next_power_of_two(x: Column) -> Column:
    """The least power of two that isn't smaller; 1 for 0 and 1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(x > 1, bit_width(x - 1)).otherwise(0))


def table_capacity(entries: Column) -> Column:
    """Slots of a hash table at most half full, a power of two."""
    return next_power_of_two(entries * 2)


def round_up(x: Column, multiple: int) -> Column:
    """The least multiple that isn't smaller."""
    return F.ceil(x / multiple).cast("long") * multiple


def fanout(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line through two points, at x."""
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def packed_chars(a: Column, b: Column) -> Column:
    """Two ASCII characters as one key of 16 bits, the first one in the upper half."""
    return F.shiftleft(F.ascii(a), 8).bitwiseOR(F.ascii(b))


def joined(*columns: Column) -> Column:
    return F.concat_ws(",", *columns)


# Multipliers and shifts of the public 32- and 64-bit finalisers.
_MIX32 = (16, 0x85EBCA6B, 13, 0xC2B2AE35, 16)
_MIX64 = (33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)


def _finalise(values: np.ndarray, kind: type, constants: tuple[int, ...]) -> np.ndarray:
    h = values.astype(kind)
    for i, c in enumerate(constants):
        h = h * kind(c) if i % 2 else h ^ (h >> kind(c))
    return h


def _mixed32(keys: pd.Series) -> pd.Series:
    return pd.Series(_finalise(keys.to_numpy(np.int64) & 0xFFFFFFFF, np.uint32, _MIX32).astype(np.int64))


def _mixed64(keys: pd.Series) -> pd.Series:
    return pd.Series(_finalise(keys.to_numpy(np.int64), np.uint64, _MIX64).view(np.int64))


def murmur3_32(key: Column | str) -> Column:
    """The 32-bit finaliser of a key's low 32 bits, unsigned."""
    return F.pandas_udf(_mixed32, "long")(key)


def murmur3_64(key: Column | str) -> Column:
    """The 64-bit finaliser, as a signed long."""
    return F.pandas_udf(_mixed64, "long")(key)
