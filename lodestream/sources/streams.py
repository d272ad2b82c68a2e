"""ADTS and Ogg (Opus, Vorbis) streams, and AAC decoder configurations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from .. import status as S
from .bits import Bits, crc32_ogg, need, take, unpack

#: Sample rates of AAC's index.
AAC_RATES = (96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350)
OPUS_RATE, OPUS_MOST_TICKS, OPUS_MOST_BYTES = 48_000, 5760, 1275
HEAD_BYTES = 64


@dataclass
class Adts:
    size: int
    profile: int
    rate: int
    channels: int
    blocks: int


def adts_header(data: bytes, at: int) -> Adts:
    b = int.from_bytes(take(data, at, 7), "big")
    need(b >> 44 == 0xFFF and not b >> 41 & 3)
    short, profile, rate, channels, size, blocks = b >> 40 & 1, b >> 38 & 3, b >> 34 & 15, b >> 30 & 7, b >> 13 & 0x1FFF, (b & 3) + 1
    need(rate < len(AAC_RATES) and size >= (7 if short else 9) and at + size <= len(data))
    return Adts(size, profile, AAC_RATES[rate], channels, blocks)


def adts_frames(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple[int, Adts]]:
    at, out = 0, []
    while at < len(data):
        h = adts_header(data, at)
        out.append((at, h))
        need(len(out) <= limits.frames)
        at += h.size
    need(out and len({(h.profile, h.rate, h.channels) for _, h in out}) == 1)
    return out


def adts_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    frames = adts_frames(data, limits)
    return [(1, S.AUDIO, 6, frames[0][1].rate, sum(1024 * h.blocks for _, h in frames), "AAC")]


def adts_packets(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    time, out = 0, []
    for at, h in adts_frames(data, limits):
        out.append((at, h.size, 1, time, 1024 * h.blocks, S.KEYFRAME))
        time += 1024 * h.blocks
    return out


@dataclass
class Page:
    granule: int
    serial: int
    sequence: int
    flags: int
    packets: list[tuple[int, int]]  # (start, size) of the packets that end here
    open: bool  # the last segment's packet goes on in the next page
    end: int


def ogg_page(data: bytes, at: int) -> Page:
    need(take(data, at, 27)[:5] == b"OggS\0")
    flags, granule, serial, sequence, check, n = unpack("<BQIIIB", data, at + 5)
    table = take(data, at + 27, n)
    body = at + 27 + n
    end = body + sum(table)
    need(end <= len(data) and crc32_ogg(data[at:end]) == check)
    packets, start, size = [], body, 0
    for s in table:
        size += s
        if s < 255:
            packets.append((start, size))
            start, size = start + size, 0
    return Page(granule, serial, sequence, flags, packets, bool(n) and table[-1] == 255, end)


def ogg_pages(data: bytes, limits: S.Limits = S.LIMITS) -> list[Page]:
    at, out = 0, []
    while at < len(data):
        p = ogg_page(data, at)
        need(not out or (p.serial == out[0].serial and p.sequence == out[-1].sequence + 1))
        out.append(p)
        need(len(out) <= limits.pages)
        at = p.end
    need(out and out[0].flags & 2 and out[0].packets)
    return out


def _ogg_head(data: bytes, pages: list[Page]) -> tuple[str, int]:
    at, size = pages[0].packets[0]
    head = data[at : at + size]
    need(size <= HEAD_BYTES)
    if head[:8] == b"OpusHead":
        channels, family = head[9] if size >= 19 else 0, head[18] if size >= 19 else 0
        need(size >= 19 and head[8] & 0xF0 == 0 and channels and (family or channels <= 2))
        if family:  # a table of streams and of the channels' places in them
            need(size >= 21 + channels and 0 < head[19] <= channels and head[20] <= head[19])
        return "opus", OPUS_RATE
    need(head[:7] == b"\x01vorbis" and size >= 30)
    version, channels, rate = unpack("<IBI", head, 7)
    need(version == 0 and 0 < channels <= 32 and 0 < rate <= 384_000 and head[29] & 1)
    need(4 <= head[28] & 15 <= head[28] >> 4 <= 13)
    return "vorbis", rate


def _last_granule(pages: list[Page]) -> int:
    return next((p.granule for p in reversed(pages) if p.granule != S.NO_GRANULE), 0)


def ogg_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    pages = ogg_pages(data, limits)
    name, rate = _ogg_head(data, pages)
    return [(1, S.AUDIO, 5 if name == "opus" else 8, rate, _last_granule(pages), name.upper())]


def opus_frame_ticks(toc: int) -> int:
    config = toc >> 3
    if config < 12:
        return (480, 960, 1920, 2880)[config & 3]
    return (480, 960)[config & 1] if config < 16 else 120 << (config & 3)


def _opus_length(packet: bytes, at: int) -> tuple[int, int]:
    need(at < len(packet))
    if packet[at] < 252:
        return packet[at], at + 1
    need(at + 1 < len(packet))
    return packet[at] + 4 * packet[at + 1], at + 2


def opus_duration(packet: bytes) -> int:
    """Ticks of a packet by its table of contents, once its frames are seen to fit."""
    need(packet)
    ticks, code, n = opus_frame_ticks(packet[0]), packet[0] & 3, len(packet)
    if code == 0:
        sizes = [n - 1]
    elif code == 1:
        need((n - 1) % 2 == 0)
        sizes = [(n - 1) // 2] * 2
    elif code == 2:
        first, at = _opus_length(packet, 1)
        need(first <= n - at)
        sizes = [first, n - at - first]
    else:
        need(n >= 2)
        count, at, padding = packet[1] & 63, 2, 0
        need(count)
        if packet[1] & 0x40:
            while True:
                need(at < n)
                more, at = packet[at], at + 1
                padding += 254 if more == 255 else more
                if more < 255:
                    break
        end = n - padding
        need(at <= end)
        if packet[1] & 0x80:
            sizes = []
            for _ in range(count - 1):
                size, at = _opus_length(packet, at)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
            need(sizes[-1] >= 0)
        else:
            need((end - at) % count == 0)
            sizes = [(end - at) // count] * count
    need(max(sizes) <= OPUS_MOST_BYTES and ticks * len(sizes) <= OPUS_MOST_TICKS)
    return ticks * len(sizes)


def _ogg_packets(pages: list[Page]) -> Iterator[tuple[Page, int, int]]:
    """Packets in order; each must begin and end in one page."""
    for p in pages:
        need(not p.open and not p.flags & 1)
        for at, size in p.packets:
            yield p, at, size


def ogg_packets(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    pages = ogg_pages(data, limits)
    name, _ = _ogg_head(data, pages)
    found = list(_ogg_packets(pages))
    out, time = [], 0
    if name == "opus":
        need(len(found) >= 2 and data[found[1][1] : found[1][1] + 8] == b"OpusTags")
        for _, at, size in found[2:]:
            n = opus_duration(data[at : at + size])
            out.append((at, size, 1, time, n, S.KEYFRAME))
            need(len(out) <= limits.packets)
            time += n
        return out
    need(len(found) >= 3 and all(data[at : at + 7] == bytes([k]) + b"vorbis" for k, (_, at, _) in zip((1, 3, 5), found, strict=False)))
    seen: set[int] = {id(p) for p, _, _ in found[:3]}
    for p, at, size in found[3:]:
        need(id(p) not in seen and size and not data[at] & 1 and p.granule not in (S.NO_GRANULE,) and p.granule >= time)
        seen.add(id(p))
        out.append((at, size, 1, time, p.granule - time, S.KEYFRAME))
        need(len(out) <= limits.packets)
        time = p.granule
    need(time == _last_granule(pages))
    return out


@dataclass
class AacConfig:
    object_type: int
    rate: int
    channels: int
    sbr: int = -1  # -1: not signalled
    ps: int = -1
    extension_rate: int = 0


def _object_type(b: Bits) -> int:
    kind = b.read(5)
    if kind == 31:
        extra = b.read(6)
        need(extra)
        kind = 32 + extra
    need(kind)
    return kind


def _rate(b: Bits) -> int:
    k = b.read(4)
    rate = b.read(24) if k == 15 else AAC_RATES[k] if k < len(AAC_RATES) else 0
    need(rate)
    return rate


def aac_config(data: bytes) -> AacConfig:
    """An AudioSpecificConfig of at most 32 bytes, with explicit or trailing SBR and PS signals."""
    need(2 <= len(data) <= 32)
    b = Bits(data)
    kind, rate, channels = _object_type(b), _rate(b), b.read(4)
    need(channels <= 7)
    c = AacConfig(kind, rate, channels)
    if kind in (5, 29):
        c.sbr, c.ps, c.extension_rate = 1, int(kind == 29) or -1, _rate(b)
        c.object_type = _object_type(b)
        need(c.object_type not in (5, 29))
    if c.object_type in (1, 2, 3, 4, 6, 7, 17, 19, 20, 21, 22, 23) and b.at + 3 <= b.end:
        b.read(1)
        if b.read(1):
            b.read(14)
        b.read(1)
        if b.end - b.at >= 16 and b.read(11) == 0x2B7 and _object_type(b) == 5:
            sbr = b.read(1)
            need(c.sbr != 1 or sbr)  # a trailing signal must not contradict an explicit one
            c.sbr = sbr
            if sbr:
                extension = _rate(b)
                need(not c.extension_rate or extension == c.extension_rate)
                c.extension_rate = extension
                if b.end - b.at >= 12 and b.read(11) == 0x548:
                    ps = b.read(1)
                    need(c.ps != 1 or ps)
                    c.ps = ps
    return c
