"""Audio sample conversions to signed 16 bits, as column expressions (no Python on the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(x: Column) -> Column:
    return ((x - 128) * 256).cast("int")


def s8(x: Column) -> Column:
    return (x * 256).cast("int")


def s24(x: Column) -> Column:
    """The upper 16 of 24 bits: an arithmetic shift, which floors (integer division would truncate)."""
    return F.shiftright(x.cast("int"), 8)


def s32(x: Column) -> Column:
    return F.shiftright(x.cast("int"), 16)


def f32(x: Column) -> Column:
    """Clamp to [-1, 1], scale in single precision, truncate; NaN and infinities are rejected (null)."""
    x = x.cast("float")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    one = F.lit(1.0).cast("float")
    return F.when(~bad, (F.greatest(-one, F.least(one, x)) * F.lit(32767).cast("float")).cast("int"))


def alaw(code: Column, compat: bool = False) -> Column:
    """G.711 A-law; ``compat`` inverts the polarity as the legacy reader does."""
    a = code.cast("int").bitwiseXOR(0x55)
    seg = F.shiftright(a, 4).bitwiseAND(7)
    low = F.shiftleft(a.bitwiseAND(15), 4)
    size = F.when(seg == 0, low + 8).otherwise(F.call_function("shiftleft", low + 0x108, seg - 1))
    positive = a.bitwiseAND(0x80) != 0
    return F.when(~positive if compat else positive, size).otherwise(-size)


def ulaw(code: Column) -> Column:
    u = F.lit(255) - code.cast("int")
    size = F.call_function("shiftleft", F.shiftleft(u.bitwiseAND(15), 3) + 0x84, F.shiftright(u, 4).bitwiseAND(7)) - 0x84
    return F.when(u.bitwiseAND(0x80) != 0, -size).otherwise(size)
