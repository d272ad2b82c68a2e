"""FLAC: metadata, frame index and decoding, by RFC 9639."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .. import status as S
from .bits import Bad, Bits, crc8, crc16, need, take, unpack

#: Block sizes and sample rates of the header's codes.
_BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8_000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
CODEC = int.from_bytes(b"fLaC", "big")
LEFT_SIDE, RIGHT_SIDE, MID_SIDE = 8, 9, 10


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    total: int
    first: int  # byte offset of the first frame


def open_flac(data: bytes) -> Info:
    need(data[:4] == b"fLaC")
    at, info, last = 4, None, False
    while not last:
        head = unpack(">I", data, at)[0]
        last, kind, size = bool(head >> 31), head >> 24 & 0x7F, head & 0xFFFFFF
        need(kind <= 6 and at + 4 + size <= len(data))
        if info is None:
            need(kind == 0 and size == 34)
            b = Bits(data, at + 4 + 10)
            info = Info(b.read(20), b.read(3) + 1, b.read(5) + 1, b.read(36), 0)
            need(0 < info.rate <= 384_000 and 4 <= info.bits <= 32)
        else:
            need(kind != 0)
        at += 4 + size
    info.first = at
    return info


def flac_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    i = open_flac(data)
    return [(1, S.AUDIO, CODEC, i.rate, i.total, "FLAC")]


def _coded_number(b: Bits) -> int:
    head = b.read(8)
    if head < 0x80:
        return head
    n = 0
    while head & (0x80 >> n):
        n += 1
    need(2 <= n <= 7)
    value = head & (0x7F >> n)
    for _ in range(n - 1):
        more = b.read(8)
        need(more >> 6 == 2)
        value = value << 6 | more & 0x3F
    need(value >= 1 << (5 * (n - 1) + 1 if n > 2 else 7))
    return value


@dataclass
class Header:
    variable: bool
    block: int
    rate: int
    assignment: int
    bits: int
    number: int
    size: int

    @property
    def channels(self) -> int:
        return self.assignment + 1 if self.assignment < 8 else 2


def frame_header(data: bytes, at: int, info: Info) -> Header:
    need(at + 6 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xFE == 0xF8)
    variable, block, rate, assignment, depth = data[at + 1] & 1, data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    need(not data[at + 3] & 1 and assignment <= MID_SIDE and block != 0 and rate != 15 and depth != 3)
    number, end = data[at + 4], at + 5
    if number >= 0x80:
        b = Bits(data, at + 4)
        number, end = _coded_number(b), b.byte
    need(variable or number < 1 << 31)
    wide, far = {6: 1, 7: 2}.get(block, 0), {12: 1, 13: 2, 14: 2}.get(rate, 0)
    more = take(data, end, wide + far)
    size = int.from_bytes(more[:wide], "big") + 1 if wide else _BLOCKS[block]
    hz = info.rate if rate == 0 else int.from_bytes(more[wide:], "big") * {12: 1000, 13: 1, 14: 10}[rate] if far else _RATES[rate]
    end += wide + far
    need(take(data, end, 1)[0] == crc8(data[at:end]))
    h = Header(bool(variable), size, hz, assignment, info.bits if depth == 0 else _DEPTHS[depth], number, end + 1 - at)
    need(h.channels == info.channels and h.rate == info.rate and h.bits == info.bits)
    return h


def _frame_end(data: bytes, at: int, h: Header, info: Info) -> tuple[int, Header | None]:
    """The next frame's start and header, or the end of the data, where the checksum of the frame holds.

    The checksum runs on from candidate to candidate, so the search is linear.
    """
    value, done, place = 0, at, at + h.size + 2
    while True:
        nxt = data.find(b"\xff", place)
        end = nxt if 0 <= nxt else len(data)
        if end < len(data) and (end + 1 >= len(data) or data[end + 1] & 0xFE != 0xF8):
            place = end + 1
            continue
        if end - 2 >= done:
            value, done = crc16(data[done : end - 2], value), end - 2
            if value == int.from_bytes(data[end - 2 : end], "big"):
                if end == len(data):
                    return end, None
                try:
                    return end, frame_header(data, end, info)
                except Bad:
                    pass
        need(end < len(data))
        place = end + 1


def flac_packets(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    info = open_flac(data)
    at, total, out, before = info.first, 0, [], None
    h = frame_header(data, at, info) if at < len(data) else None
    while h is not None:
        if before is not None:
            need(h.variable == before.variable and (h.number > before.number if h.variable else h.number == before.number + 1))
        end, follower = _frame_end(data, at, h, info)
        out.append((at, end - at, 1, total, h.block, S.KEYFRAME))
        need(len(out) <= limits.packets)
        total, at, before, h = total + h.block, end, h, follower
    need(out and (info.total == 0 or total == info.total))
    return out


def _residuals(b: Bits, n: int, order: int) -> list[int]:
    method = b.read(2)
    need(method < 2)
    width, parts = (4, 5)[method], b.read(4)
    need(n % (1 << parts) == 0 and (n >> parts) >= order)
    out: list[int] = []
    for k in range(1 << parts):
        count = (n >> parts) - (order if k == 0 else 0)
        p = b.read(width)
        if p == (1 << width) - 1:
            raw = b.read(5)
            out += [b.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                v = b.unary() << p | b.read(p)
                out.append(v >> 1 if not v & 1 else -(v >> 1) - 1)
    return out


#: Coefficients of the fixed predictors.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(b: Bits, n: int, bits: int) -> list[int]:
    need(not b.read(1))
    kind = b.read(6)
    wasted = b.unary() + 1 if b.read(1) else 0
    bits -= wasted
    need(bits > 0)
    if kind == 0:
        out = [b.signed(bits)] * n
    elif kind == 1:
        out = b.signed_run(bits, n)
    else:
        if 8 <= kind <= 12:
            order, weights, shift = kind - 8, _FIXED[kind - 8], 0
            need(order <= n)
            out = [b.signed(bits) for _ in range(order)]
        else:
            need(kind >= 32)
            order = kind - 31
            need(order <= n)
            out = [b.signed(bits) for _ in range(order)]
            precision = b.read(4) + 1
            need(precision < 16)
            shift = b.signed(5)
            need(shift >= 0)
            weights = [b.signed(precision) for _ in range(order)]
        for r in _residuals(b, n, order):
            k = len(out)
            value = r + (sum(w * out[k - 1 - j] for j, w in enumerate(weights)) >> shift)
            need(-(1 << 63) <= value < 1 << 63)
            out.append(value)
    return [v << wasted for v in out] if wasted else out


def decode_frame(data: bytes, info: Info) -> np.ndarray:
    """Samples (frames, channels) of one whole frame; nothing if any check fails."""
    h = frame_header(data, 0, info)
    need(len(data) > h.size + 2 and crc16(data[:-2]) == int.from_bytes(data[-2:], "big"))
    b = Bits(data[:-2], h.size)
    side = {LEFT_SIDE: 1, RIGHT_SIDE: 0, MID_SIDE: 1}.get(h.assignment)
    found = [_subframe(b, h.block, h.bits + (k == side)) for k in range(h.channels)]
    b.align()
    need(b.byte == len(data) - 2)
    most = 1 << (h.bits - 1)
    if side is None:
        need(all(-most <= min(p) and max(p) < most for p in found))
        return np.array(found, dtype=np.int64).T
    parts = [np.array(p, dtype=np.int64) for p in found]
    if h.assignment == LEFT_SIDE:
        parts[1] = parts[0] - parts[1]
    elif h.assignment == RIGHT_SIDE:
        parts[0] = parts[0] + parts[1]
    elif h.assignment == MID_SIDE:
        mid = parts[0] * 2 + (parts[1] & 1)
        parts = [(mid + parts[1]) >> 1, (mid - parts[1]) >> 1]
    out = np.stack(parts, axis=1)
    need(out.min() >= -most and out.max() < most)
    return out


def decode(data: bytes, packets: list[tuple] | None = None) -> np.ndarray:
    """All samples of a stream: packets must be in order, adjoin in time and cover the declared total."""
    info = open_flac(data)
    packets = flac_packets(data) if packets is None else packets
    out, time, end = [], 0, 0
    for at, size, track, timestamp, duration, _ in packets:
        need(track == 1 and at >= end and timestamp == time and at + size <= len(data))
        got = decode_frame(data[at : at + size], info)
        need(len(got) == duration)
        out.append(got)
        time, end = time + duration, at + size
    need(out and (info.total == 0 or time == info.total))
    return np.concatenate(out)
