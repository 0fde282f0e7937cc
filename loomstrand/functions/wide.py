"""128-bit unsigned keys as structs (hi, lo) of two longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make(hi: Column | int, lo: Column | int) -> Column:
    as_long = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.struct(as_long(hi).alias("hi"), as_long(lo).alias("lo"))


def largest() -> Column:
    return make(-1, -1)


def shift(x: Column, by: int) -> Column:
    """Left by ``by`` bits, right if it is negative."""
    hi, lo, n = x["hi"], x["lo"], abs(by)
    if n == 0:
        return make(hi, lo)
    if n >= 128:
        return make(0, 0)
    if by > 0:
        return make(F.shiftleft(lo, n - 64), 0) if n >= 64 else make(F.shiftleft(hi, n).bitwiseOR(F.shiftrightunsigned(lo, 64 - n)), F.shiftleft(lo, n))
    return make(0, F.shiftrightunsigned(hi, n - 64)) if n >= 64 else make(F.shiftrightunsigned(hi, n), F.shiftrightunsigned(lo, n).bitwiseOR(F.shiftleft(hi, 64 - n)))


def extract(x: Column, first: int, bits: int) -> Column:
    """``bits`` bits from bit ``first`` on, moved to the low end."""
    return shift(shift(x, 128 - first - bits), bits - 128)


def both(x: Column, y: Column) -> Column:
    return make(x["hi"].bitwiseAND(y["hi"]), x["lo"].bitwiseAND(y["lo"]))


def either(x: Column, y: Column) -> Column:
    return make(x["hi"].bitwiseOR(y["hi"]), x["lo"].bitwiseOR(y["lo"]))


def differing(x: Column, y: Column) -> Column:
    return make(x["hi"].bitwiseXOR(y["hi"]), x["lo"].bitwiseXOR(y["lo"]))


def is_zero(x: Column) -> Column:
    return (x["hi"] == 0) & (x["lo"] == 0)


def bits(x: Column) -> Column:
    """All 128 bits, the highest first."""
    return F.concat(F.lpad(F.bin(x["hi"]), 64, "0"), F.lpad(F.bin(x["lo"]), 64, "0"))


def order(x: Column) -> Column:
    """A struct that sorts as the unsigned number does."""
    flip = lambda v: v.bitwiseXOR(F.lit(-(1 << 63)))
    return F.struct(flip(x["hi"]).alias("hi"), flip(x["lo"]).alias("lo"))


def prefix_mask(levels: int, width: int = 3, slots: int = 41) -> Column:
    """Ones over the ``levels`` highest of ``slots`` slots of ``width`` bits."""
    value = ((1 << (levels * width)) - 1) << ((slots - levels) * width)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return make(signed(value >> 64), signed(value & ((1 << 64) - 1)))


def looked_up(rows: DataFrame, keys: DataFrame, key: str = "key", place: str = "place") -> DataFrame:
    """rows with the place that ``keys`` (key, place), each key once, has for their key; -1 for a key that it lacks."""
    side = keys.select(F.col(key)["hi"].alias("key_hi"), F.col(key)["lo"].alias("key_lo"), F.col(place))
    found = rows.join(side, (rows[key]["hi"] == side["key_hi"]) & (rows[key]["lo"] == side["key_lo"]), "left")
    return found.select(*[rows[c] for c in rows.columns], F.coalesce(side[place], F.lit(-1)).alias(place))
