"""Checksums that can be merged: the CRC of a span from the CRCs of its parts, in any order.

A CRC without its initial value is linear: of a span it is the exclusive or of the CRCs of its parts, each moved on by the bytes
behind it.  Moving on by n bytes is a multiplication by x ** (8 n) modulo the polynomial, so a part's share is known from its
bytes and its place alone, and shares are summed by ``bit_xor``, a partial aggregate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A CRC of ``bits``, highest bit first, that starts from ``start``; the fixed values of a format."""

    bits: int
    polynomial: int
    start: int = 0

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    def times(self, a: int, b: int) -> int:
        """The product of two remainders."""
        out = 0
        while b:
            if b & 1:
                out ^= a
            b >>= 1
            a <<= 1
            if a >> self.bits:
                a = (a & self.mask) ^ self.polynomial
        return out

    def ahead(self, n: int) -> int:
        """x ** (8 n) modulo the polynomial."""
        out, step = 1, self.power_of_byte()
        while n:
            if n & 1:
                out = self.times(out, step)
            step, n = self.times(step, step), n >> 1
        return out

    def power_of_byte(self) -> int:
        x = 1
        for _ in range(8):
            x <<= 1
            if x >> self.bits:
                x = (x & self.mask) ^ self.polynomial
        return x

    def plain(self, data: bytes) -> int:
        """The CRC of some bytes from 0."""
        if (self.bits, self.polynomial) == (32, 0x04C11DB7):
            return _mirrored(data)
        return _bytewise(self, data) if len(data) <= _SHORT else _plain(self, data)

    def of(self, data: bytes) -> int:
        return self.plain(data) ^ (self.times(self.start, self.ahead(len(data))) if self.start else 0)


#: Of Ogg pages, FLAC frames and FLAC frame headers.
OGG, FLAC16, FLAC8 = Kind(32, 0x04C11DB7), Kind(16, 0x8005), Kind(8, 0x07)
#: Bytes taken at once by every lane of ``_plain``.
_LANE = 64
#: Bytes up to which a walk byte by byte is faster than lanes.
_SHORT = 8192
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def _mirrored(data: bytes) -> int:
    """The CRC of 32 bits by that of zlib, which has the same polynomial but takes the lowest bit first."""
    found = zlib.crc32(bytes(data).translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(found.to_bytes(4, "little").translate(_REVERSED), "big")


@cache
def _table(kind: Kind) -> np.ndarray:
    """What the highest byte of a register turns into."""
    out = np.zeros(256, np.uint64)
    for k in range(256):
        r = k << (kind.bits - 8)
        for _ in range(8):
            r = ((r << 1) & kind.mask) ^ (kind.polynomial if r >> (kind.bits - 1) else 0)
        out[k] = r
    return out


@cache
def _steps(kind: Kind) -> list[int]:
    return _table(kind).tolist()


def _bytewise(kind: Kind, data: bytes) -> int:
    table, top, mask, register = _steps(kind), kind.bits - 8, kind.mask, 0
    for b in data:
        register = (register << 8 & mask) ^ table[register >> top ^ b]
    return register


@cache
def _doubling(kind: Kind, n: int) -> int:
    return kind.ahead(n)


def _moved(kind: Kind, registers: np.ndarray, factor: int) -> np.ndarray:
    """All registers times one factor."""
    out, a = np.zeros_like(registers), registers.copy()
    mask, top = np.uint64(kind.mask), np.uint64(kind.bits - 1)
    while factor:
        if factor & 1:
            out ^= a
        factor >>= 1
        a = ((a << np.uint64(1)) & mask) ^ (np.uint64(kind.polynomial) * (a >> top))
    return out


def _plain(kind: Kind, data: bytes) -> int:
    """Lanes of equal length side by side, merged two by two by the rule above."""
    n = len(data)
    if not n:
        return 0
    lanes = 1 << max(0, (n // _LANE).bit_length() - 1)
    size = -(-n // lanes)
    # zeros in front change nothing
    grid = np.frombuffer(bytes(lanes * size - n) + data, np.uint8).reshape(lanes, size).astype(np.uint64)
    table, mask = _table(kind), np.uint64(kind.mask)
    r, up, down = np.zeros(lanes, np.uint64), np.uint64(8), np.uint64(kind.bits - 8)
    for k in range(size):
        r = ((r << up) & mask) ^ table[((r >> down) ^ grid[:, k]) & np.uint64(255)]
    while len(r) > 1:
        r = _moved(kind, r[0::2], _doubling(kind, size)) ^ r[1::2]
        size *= 2
    return int(r[0])


def shares(parts: DataFrame, kind: Kind, data: str, behind: Column, name: str = "share") -> DataFrame:
    """``parts`` with the share of their bytes in the CRC of a span; ``behind``: the bytes of the span after the part."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, far = b.column(data).to_pylist(), b.column("_behind").to_pylist()
            got = [None if d is None or n is None else kind.times(kind.plain(d), kind.ahead(n)) for d, n in zip(bodies, far, strict=True)]
            kept = [k for k in b.schema.names if k != "_behind"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(got, pa.int64())], names=[*kept, name])

    return parts.withColumn("_behind", behind.cast("bigint")).mapInArrow(run, f"{schema}, `{name}` bigint")


def checksums(parts: DataFrame, kind: Kind, by: list[str], offset: str, data: str) -> DataFrame:
    """(by, n_bytes, crc): the CRC of each span from its parts (offset in the span, bytes), which cover it without overlap.

    A span may be of any size and any number of tasks may hold its parts: the end of each span is one aggregate over
    narrow rows, the sum of the shares another.  A span that is not covered has no CRC.
    """
    size = F.octet_length(data).cast("bigint")
    sized = parts.groupBy(*by).agg(F.max(F.col(offset) + size).alias("n_bytes"), F.sum(size).alias("_sum"))
    own = shares(parts.select(*by, offset, data).join(sized, by), kind, data, F.col("n_bytes") - F.col(offset) - size)
    summed = own.groupBy(*by).agg(F.first("n_bytes").alias("n_bytes"), F.first("_sum").alias("_sum"), F.bit_xor("share").alias("crc"))
    if kind.start:
        step = F.udf(lambda n: kind.times(kind.start, kind.ahead(n)), "bigint")  # one row a span
        summed = summed.withColumn("crc", F.col("crc").bitwiseXOR(step("n_bytes")))
    return summed.select(*by, "n_bytes", F.when(F.col("_sum") == F.col("n_bytes"), F.col("crc")).alias("crc"))
