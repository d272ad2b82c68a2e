"""Bounded reading of bytes and bits, and the checksums of the formats."""

from __future__ import annotations

import struct
from functools import cache
from itertools import accumulate


class Bad(Exception):
    """The bytes break a rule of the format; the source is rejected whole."""


def need(ok: object) -> None:
    if not ok:
        raise Bad


def take(data: bytes, at: int, n: int) -> bytes:
    need(0 <= at and 0 <= n and at + n <= len(data))
    return data[at : at + n]


_form = cache(struct.Struct)


def unpack(form: str, data: bytes, at: int = 0) -> tuple:
    layout = _form(form)
    need(0 <= at and at + layout.size <= len(data))
    return layout.unpack_from(data, at)


class Bits:
    """Most significant bit first; reading past the end is Bad."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def read(self, n: int) -> int:
        need(n >= 0 and self.at + n <= self.end)
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def signed_run(self, n: int, many: int) -> list[int]:
        """So many values of ``signed``; whole bytes are read at once."""
        if self.at & 7 or n not in (8, 16, 32):
            return [self.signed(n) for _ in range(many)]
        need(self.at + n * many <= self.end)
        at, self.at = self.at >> 3, self.at + n * many
        return list(struct.unpack_from(f">{many}{'bhi'[n >> 4]}", self.data, at))

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    @property
    def byte(self) -> int:
        return self.at >> 3


@cache
def _table(poly: int, width: int) -> list[int]:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out.append(r)
    return out


def crc(data: bytes, poly: int, width: int, value: int = 0) -> int:
    """Unreflected CRC, most significant bit first."""
    table, shift, mask = _table(poly, width), width - 8, (1 << width) - 1
    for b in data:
        value = ((value << 8) & mask) ^ table[(value >> shift) ^ b]
    return value


def crc8(data: bytes) -> int:
    return crc(data, 0x07, 8)


def crc16(data: bytes, value: int = 0) -> int:
    return crc(data, 0x8005, 16, value)


def crc32_ogg(page: bytes) -> int:
    """Of a page whose checksum field is taken as zero."""
    return crc(page[:22] + b"\0\0\0\0" + page[26:], 0x04C11DB7, 32)


def fnv1a(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h or 1


def prefix(values: list[int]) -> list[int]:
    """Exclusive running sums."""
    return list(accumulate(values[:-1], initial=0)) if values else []
