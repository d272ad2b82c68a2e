"""MP4 boxes and Matroska / WebM elements."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from struct import Struct

from .. import status as S
from .bits import Bad, fnv1a, need, prefix, take, unpack

_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
DEPTH = 8
U64 = 2**64 - 1


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the body, end) of sibling boxes; 64-bit sizes; size 0 is refused."""
    while at < end:
        size, kind = unpack(">I4s", data, at)
        head = 8
        if size == 1:
            (size,), head = unpack(">Q", data, at + 8), 16
        need(size >= head and at + size <= end)
        yield kind, at + head, at + size
        at += size


def _walk(data: bytes, at: int, end: int, wanted: dict[bytes, tuple[int, int]], depth: int = 0) -> None:
    """Collect leaf boxes by type, each at most once."""
    need(depth <= DEPTH)
    for kind, a, e in boxes(data, at, end):
        if kind in _CONTAINERS:
            _walk(data, a, e, wanted, depth + 1)
        else:
            need(kind not in wanted or kind not in _ONCE)
            wanted[kind] = (a, e)


_ONCE = {b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"ctts", b"stsc", b"stsz", b"stco", b"co64", b"stss"}


@dataclass
class Mp4Track:
    id: int
    kind: int
    codec: int
    name: str
    scale: int
    duration: int
    tables: dict[bytes, tuple[int, int]]


def open_mp4(data: bytes, limits: S.Limits = S.LIMITS) -> list[Mp4Track]:
    top = list(boxes(data, 0, len(data)))
    need(top and top[0][0] == b"ftyp" and sum(k == b"ftyp" for k, _, _ in top) == 1 and sum(k == b"moov" for k, _, _ in top) == 1)
    _, at, end = next(b for b in top if b[0] == b"moov")
    out = []
    for kind, a, e in boxes(data, at, end):
        if kind != b"trak":
            continue
        t: dict[bytes, tuple[int, int]] = {}
        _walk(data, a, e, t)
        need({b"tkhd", b"mdhd", b"hdlr", b"stsd"} <= t.keys())
        v = data[t[b"tkhd"][0]]
        (ident,) = unpack(">I", data, t[b"tkhd"][0] + (20 if v else 12))
        m = t[b"mdhd"][0]
        scale, duration = unpack(">IQ", data, m + 20) if data[m] else unpack(">II", data, m + 12)
        handler = take(data, t[b"hdlr"][0] + 8, 4)
        role = {b"soun": S.AUDIO, b"vide": S.VIDEO, b"subt": S.SUBTITLE, b"text": S.SUBTITLE, b"clcp": S.SUBTITLE}.get(handler, S.UNKNOWN_TRACK)
        s, s_end = t[b"stsd"]
        (count,) = unpack(">I", data, s + 4)
        need(count == 1 and s + 16 <= s_end)
        code = data[s + 12 : s + 16]
        need(b"\0" not in code and ident and scale and ident not in {x.id for x in out})
        out.append(Mp4Track(ident, role, int.from_bytes(code, "big"), code.decode("latin-1"), scale, duration, t))
        need(len(out) <= limits.tracks)
    need(out)
    return out


def mp4_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    return [(t.id, t.kind, t.codec, t.scale, t.duration, t.name) for t in open_mp4(data, limits)]


def _rows(data: bytes, place: tuple[int, int], form: str, skip: int = 8) -> list[tuple]:
    at, end = place
    (n,) = unpack(">I", data, at + skip - 4)
    layout = Struct(form)
    need(at + skip + n * layout.size <= end)
    return list(layout.iter_unpack(data[at + skip : at + skip + n * layout.size]))


def expand(runs: list[tuple], most: int) -> list[int]:
    need(sum(n for n, _ in runs) <= most)
    return [v for n, v in runs for _ in range(n)]


def mp4_packets(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    out: list[tuple] = []
    for t in open_mp4(data, limits):
        b = t.tables
        need({b"stsz", b"stts", b"stsc"} <= b.keys() and (b"stco" in b) != (b"co64" in b))
        at, end = b[b"stsz"]
        fixed, n = unpack(">II", data, at + 4)
        need(n <= limits.packets)
        sizes = [fixed] * n if fixed else [s for (s,) in _rows(data, b[b"stsz"], ">I", 12)]
        deltas = expand(_rows(data, b[b"stts"], ">II"), limits.packets)
        if b"ctts" in b:
            shifts = expand(_rows(data, b[b"ctts"], ">Ii" if data[b[b"ctts"][0]] else ">II"), limits.packets)
        else:
            shifts = [0] * n
        groups = _rows(data, b[b"stsc"], ">III")
        need(len(groups) <= 64 and groups and groups[0][0] == 1 and all(x[0] < y[0] for x, y in zip(groups, groups[1:], strict=False)) and all(g[2] == 1 and g[1] for g in groups))
        offsets = [o for (o,) in _rows(data, b.get(b"stco") or b[b"co64"], ">I" if b"stco" in b else ">Q")]
        keys = {k for (k,) in _rows(data, b[b"stss"], ">I")} if b"stss" in b else None
        need(len(deltas) == n and len(shifts) == n)
        k, g = 0, 0
        times = prefix(deltas)
        for chunk, offset in enumerate(offsets, 1):
            while g + 1 < len(groups) and groups[g + 1][0] <= chunk:
                g += 1
            for _ in range(groups[g][1]):
                need(k < n and deltas[k] > 0 and sizes[k] > 0 and offset + sizes[k] <= len(data))
                stamp = times[k] + shifts[k]
                need(0 <= stamp <= U64)
                out.append((offset, sizes[k], t.id, stamp, deltas[k], S.KEYFRAME if keys is None or k + 1 in keys else 0))
                offset += sizes[k]
                k += 1
        need(k == n and len(out) <= limits.packets)
    return out


#: Element ids.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, KIND, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, BLOCK_TIME, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB


def vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next place, all ones) of a variable-length integer."""
    if at >= end or not data[at]:
        raise Bad
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Bad
    raw, most = int.from_bytes(data[at : at + n], "big"), (1 << 7 * n) - 1
    value = raw & most
    return raw if keep_marker else value, at + n, value == most


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of sibling elements.

    Only Segment and Cluster may have an unknown size; such a cluster ends at the next cluster.
    """
    while at < end:
        kind, body, _ = vint(data, at, end, True)
        need(body - at <= 4)
        size, body, unknown = vint(data, body, end)
        if unknown:
            need(kind in (SEGMENT, CLUSTER))
            stop = end if kind == SEGMENT else _cluster_end(data, body, end)
        else:
            stop = body + size
        need(stop <= end)
        yield kind, body, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body, _ = vint(data, at, end, True)
        if kind in (CLUSTER, INFO, TRACKS, 0x1C53BB6B, 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74):
            return at
        size, body, unknown = vint(data, body, end)
        need(not unknown and body + size <= end)
        at = body + size
    return end


def _uint(data: bytes, at: int, end: int, most: int = 8) -> int:
    need(1 <= end - at <= most)
    return int.from_bytes(data[at:end], "big")


@dataclass
class Mkv:
    doctype: str = ""
    scale: int = 1_000_000
    tracks: list[tuple] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)


def doctype(data: bytes) -> str:
    kind, at, end = next(elements(data, 0, len(data)))
    need(kind == EBML)
    names = [data[a:e].rstrip(b"\0").decode("latin-1") for k, a, e in elements(data, at, end) if k == DOCTYPE]
    need(len(names) == 1 and names[0] in ("webm", "matroska"))
    return names[0]


def open_mkv(data: bytes, limits: S.Limits = S.LIMITS) -> Mkv:
    out, segments = Mkv(doctype(data)), 0
    for kind, at, end in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        segments += 1
        need(segments == 1)
        seen = set()
        for k, a, e in elements(data, at, end):
            if k == INFO:
                for k2, a2, e2 in elements(data, a, e):
                    if k2 == SCALE:
                        need(SCALE not in seen)
                        seen.add(SCALE)
                        out.scale = _uint(data, a2, e2, 4)
                        need(out.scale)
                    elif k2 == DURATION:
                        value = unpack({4: ">f", 8: ">d"}.get(e2 - a2, ">"), data, a2)
                        need(value and math.isfinite(value[0]) and value[0] >= 0)
            elif k == TRACKS:
                for k2, a2, e2 in elements(data, a, e):
                    if k2 == ENTRY:
                        got = {k3: (a3, e3) for k3, a3, e3 in elements(data, a2, e2) if k3 in (NUMBER, KIND, CODEC_ID)}
                        need(len(got) == 3)
                        number, role = _uint(data, *got[NUMBER]), _uint(data, *got[KIND])
                        codec = data[slice(*got[CODEC_ID])].rstrip(b"\0")
                        need(0 < number < 2**32 and 0 < len(codec) < 32 and number not in {t[0] for t in out.tracks})
                        out.tracks.append((number, {1: S.VIDEO, 2: S.AUDIO, 0x11: S.SUBTITLE}.get(role, S.UNKNOWN_TRACK), fnv1a(codec), 0, 0, codec.decode("latin-1")))
                        need(len(out.tracks) <= limits.tracks)
            elif k == CLUSTER:
                out.clusters.append((a, e))
    need(segments and out.tracks)
    return out


def mkv_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    m = open_mkv(data, limits)
    return [(n, role, codec, m.scale, 0, name) for n, role, codec, _, _, name in m.tracks]


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [end - at], at
    need(at < end)
    n, at = data[at] + 1, at + 1
    if n == 1:
        return [end - at], at
    if kind == 2:
        need((end - at) % n == 0)
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                need(at < end)
                b, at = data[at], at + 1
                size += b
                if b < 255:
                    break
            sizes.append(size)
    else:
        size, at, unknown = vint(data, at, end)
        need(not unknown)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            raw, at, _ = vint(data, at, end)
            sizes.append(sizes[-1] + raw - ((1 << (7 * (at - start) - 1)) - 1))
            need(sizes[-1] >= 0)
    sizes.append(end - at - sum(sizes))
    need(sizes[-1] > 0)
    return sizes, at


def _block(data: bytes, at: int, end: int, base: int, known: set[int], key: bool, duration: int) -> list[tuple]:
    number, at, _ = vint(data, at, end)
    need(number in known)
    relative, flags = unpack(">hB", data, at)
    sizes, start = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    need(start <= end and min(sizes) > 0 and base + relative >= 0 and (len(sizes) == 1 or not duration))
    return [(start + o, size, number, base + relative, duration, S.KEYFRAME if key else 0) for o, size in zip(prefix(sizes), sizes, strict=True)]


def mkv_packets(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    m = open_mkv(data, limits)
    known, out = {t[0] for t in m.tracks}, []
    for at, end in m.clusters:
        base = None
        for kind, a, e in elements(data, at, end):
            if kind == TIME:
                need(base is None)
                base = _uint(data, a, e)
            elif kind == SIMPLE:
                need(base is not None)
                _, flag_at, _ = vint(data, a, e)
                out += _block(data, a, e, base, known, bool(take(data, flag_at + 2, 1)[0] & 0x80), 0)
            elif kind == GROUP:
                need(base is not None)
                inner = {k: (x, y) for k, x, y in elements(data, a, e)}
                need(BLOCK in inner)
                out += _block(data, *inner[BLOCK], base, known, REFERENCE not in inner, _uint(data, *inner[BLOCK_TIME]) if BLOCK_TIME in inner else 0)
            need(len(out) <= limits.packets)
    return out


__all__ = ["Bad", "boxes", "doctype", "elements", "lace_sizes", "mkv_packets", "mkv_tracks", "mp4_packets", "mp4_tracks", "open_mkv", "open_mp4", "vint"]
