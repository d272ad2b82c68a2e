"""WAV and AVI: chunks of RIFF."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from .. import status as S
from .bits import Bad, need, take, unpack

#: WAVE format tags.
PCM, FLOAT, ALAW, MULAW, IMA, EXTENSIBLE = 1, 3, 6, 7, 0x11, 0xFFFE
_GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")
#: Published names of WAVE formats, in WAV files and in AVI audio.
TAG_NAMES = {PCM: "PCM ", FLOAT: "FL32", ALAW: "ALAW", MULAW: "ULAW", IMA: "IMAD"}
AVI_TAG_NAMES = {PCM: "PCM ", 2: "ADPC", FLOAT: "FL32", ALAW: "ALAW", MULAW: "ULAW", 0x55: "MP3 "}
OTHER_NAME = "WAVE"
U32 = 0xFFFFFFFF
_HEAD, _ROW = struct.Struct("<4sI"), struct.Struct("<4sIII")


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start of the body, size) of chunks; bodies are padded to even sizes."""
    need(end <= len(data) or at + 8 > end)
    while at + 8 <= end:
        name, size = _HEAD.unpack_from(data, at)
        if at + 8 + size > end:
            raise Bad
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def riff(data: bytes, form: bytes) -> int:
    """End of the RIFF body of the wanted form."""
    need(len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == form)
    end = 8 + unpack("<I", data, 4)[0]
    need(12 <= end <= len(data))
    return end


@dataclass
class Wav:
    tag: int
    channels: int
    rate: int
    align: int
    bits: int
    start: int
    size: int
    block_samples: int = 1

    @property
    def samples(self) -> int:
        """Sample frames, saturated to 32 bits."""
        return min(U32, self.size // self.align * self.block_samples)

    def duration_ms(self) -> int:
        return min(U32, self.samples * 1000 // self.rate)


def open_wav(data: bytes) -> Wav:
    end = riff(data, b"WAVE")
    got = body = None
    for name, at, size in chunks(data, 12, end):
        if name == b"fmt ":
            need(got is None and size >= 16)
            tag, channels, rate, _, align, bits = unpack("<HHIIHH", data, at)
            extra = data[at + 18 : at + size]
            if tag == EXTENSIBLE:
                need(size >= 40 and len(extra) >= 22)
                valid = unpack("<H", extra)[0]
                need(valid <= bits and extra[8:22] == _GUID_TAIL)
                (tag,) = unpack("<H", extra, 6)
            need(1 <= channels <= 2 and rate > 0 and align > 0)
            block = 1
            if tag == IMA:
                need(bits == 4 and align > 4 * channels and (align - 4 * channels) % (4 * channels) == 0)
                block = (align - 4 * channels) * 2 // channels + 1
            else:
                allowed = {PCM: (8, 16, 24, 32), FLOAT: (32,), ALAW: (8,), MULAW: (8,)}.get(tag, ())
                need(bits in allowed and align == channels * bits // 8)
            got = Wav(tag, channels, rate, align, bits, 0, 0, block)
        elif name == b"data":
            need(body is None)
            body = (at, size)
    need(got is not None and body is not None)
    got.start, got.size = body
    need(got.size > 0 and got.size % got.align == 0)
    return got


def wav_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    w = open_wav(data)
    return [(1, S.AUDIO, w.tag, w.rate, w.samples, TAG_NAMES[w.tag])]


def wav_packets(data: bytes, frames_per_packet: int = 1, limits: S.Limits = S.LIMITS) -> list[tuple]:
    """One packet a block; ``frames_per_packet`` > 1 groups blocks (our extension, for longer files)."""
    w = open_wav(data)
    step = w.align * frames_per_packet
    out = []
    for k, at in enumerate(range(0, w.size, step)):
        size = min(step, w.size - at)
        n = size // w.align * w.block_samples
        out.append((w.start + at, size, 1, k * frames_per_packet * w.block_samples, n, S.KEYFRAME))
    return out


@dataclass
class Stream:
    kind: int
    handler: bytes
    scale: int
    rate: int
    length: int
    codec: int = 0
    name: str = ""
    width: int = 0
    height: int = 0
    bits: int = 0
    compression: int = 0
    channels: int = 0
    sample_rate: int = 0
    tag: int = 0
    top_down: bool = False


@dataclass
class Avi:
    streams: list[Stream] = field(default_factory=list)
    us_per_frame: int = 0
    frames: int = 0
    movi: int = 0
    movi_end: int = 0
    index: list[tuple[bytes, int, int, int]] = field(default_factory=list)

    def first(self, kind: int) -> Stream | None:
        return next((s for s in self.streams if s.kind == kind), None)

    @property
    def fps(self) -> float:
        """The first video stream's rate overrides the file header's."""
        v = self.first(S.VIDEO)
        if v and v.scale and v.rate:
            return v.rate / v.scale
        return 1_000_000 / self.us_per_frame if self.us_per_frame else 0.0

    @property
    def duration_ms(self) -> int:
        return min(U32, self.frames * self.us_per_frame // 1000)

    def rows(self, kind: int) -> list[tuple[bytes, int, int, int]]:
        """Index rows of video or audio chunks, in index order."""
        ends = (b"dc", b"db") if kind == S.VIDEO else (b"wb",)
        return [r for r in self.index if r[0][2:] in ends]


def _stream(data: bytes) -> Stream:
    head = None
    for name, body, size in chunks(data, 0, len(data)):
        if name == b"strh":
            need(head is None and size >= 48)
            kind = {b"vids": S.VIDEO, b"auds": S.AUDIO, b"txts": S.SUBTITLE}.get(data[body : body + 4], S.UNKNOWN_TRACK)
            scale, rate, _, length = unpack("<IIII", data, body + 20)
            head = Stream(kind, data[body + 4 : body + 8], scale, rate, length)
        elif name == b"strf":
            need(head is not None)
            if head.kind == S.VIDEO:
                need(size >= 40)
                _, head.width, height, _, head.bits, head.compression = unpack("<IiiHHI", data, body)
                need(head.width > 0 and height != 0)
                head.height, head.top_down = abs(height), height < 0
                head.codec = int.from_bytes(data[body + 16 : body + 20], "big")
                head.name = data[body + 16 : body + 20].decode("latin-1")
            elif head.kind == S.AUDIO:
                need(size >= 16)
                head.tag, head.channels, head.sample_rate, _, _, head.bits = unpack("<HHIIHH", data, body)
                head.codec, head.name = head.tag, AVI_TAG_NAMES.get(head.tag, OTHER_NAME)
    need(head is not None)
    return head


#: Headers of streams recur from file to file; what is read of them is never changed.
_short_stream = lru_cache(4096)(_stream)


def open_avi(data: bytes) -> Avi:
    end = riff(data, b"AVI ")
    out, seen = Avi(), set()
    for name, at, size in chunks(data, 12, end):
        form = data[at : at + 4] if name == b"LIST" and size >= 4 else b""
        key = form or name
        if key in (b"hdrl", b"movi", b"idx1"):
            need(key not in seen)
            seen.add(key)
        if form == b"hdrl":
            for n2, a2, s2 in chunks(data, at + 4, at + size):
                if n2 == b"avih":
                    need(s2 >= 56)
                    out.us_per_frame, out.frames = unpack("<I", data, a2)[0], unpack("<I", data, a2 + 16)[0]
                elif n2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                    own = data[a2 + 4 : a2 + s2]
                    out.streams.append((_short_stream if len(own) <= 256 else _stream)(own))
        elif form == b"movi":
            out.movi, out.movi_end = at, at + size
        elif name == b"idx1":
            need(size % 16 == 0)
            out.index = list(_ROW.iter_unpack(data[at : at + size]))
    need(out.streams and out.movi)
    return out


#: Tracks and packets of one file are asked for one after the other.
_opened = lru_cache(1)(open_avi)


def _payload(data: bytes, avi: Avi, row: tuple[bytes, int, int, int]) -> int:
    """Start of an index row's payload; offsets count from the movi list's type, or from the file."""
    name, _, offset, size = row
    for base in (avi.movi, 0):
        at = base + offset
        if avi.movi <= at and at + 8 + size <= avi.movi_end and _HEAD.unpack_from(data, at) == (name, size):
            return at + 8
    raise Bad


def avi_tracks(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    avi = _opened(data)
    need(len(avi.streams) <= limits.tracks)
    out = []
    for k, s in enumerate(avi.streams):
        need(s.kind in (S.AUDIO, S.VIDEO) and s.codec and s.scale)
        need(s.kind == S.AUDIO or all(" " <= c <= "~" for c in s.name))
        out.append((k + 1, s.kind, s.codec, s.scale, s.length * s.scale, s.name))
    return out


def avi_packets(data: bytes, limits: S.Limits = S.LIMITS) -> list[tuple]:
    """Audio and video rows of the index; a stream's time advances by its scale a chunk."""
    avi = _opened(data)
    time = dict.fromkeys(range(len(avi.streams)), 0)
    known: dict[bytes, tuple[int, bool, int]] = {}
    out = []
    for row in avi.index:
        name, flags, _, size = row
        if name not in known:
            if name[2:] not in (b"dc", b"db", b"wb"):
                continue
            need(name[:2].isdigit() and int(name[:2]) in time)
            k, audio = int(name[:2]), name[2:] == b"wb"
            need(avi.streams[k].kind == (S.AUDIO if audio else S.VIDEO))
            known[name] = k, audio, avi.streams[k].scale
        k, audio, scale = known[name]
        if size <= 0:
            raise Bad
        out.append((_payload(data, avi, row), size, k + 1, time[k], scale, S.KEYFRAME if flags & 0x10 and not audio else 0))
        time[k] += scale
    return out


def nth_frame(data: bytes, n: int, kind: int = S.VIDEO) -> bytes:
    """Payload of the n-th video or audio chunk in index order."""
    avi = open_avi(data)
    rows = avi.rows(kind)
    need(0 <= n < len(rows))
    return take(data, _payload(data, avi, rows[n]), rows[n][3])


def audio_at(data: bytes, ms: int) -> tuple[int, int, int]:
    """(chunk, offset in samples, samples left) that holds a time of the first audio stream."""
    avi = open_avi(data)
    a = avi.first(S.AUDIO)
    need(a is not None and a.channels and a.bits in (8, 16))
    width, low, target = a.channels * a.bits // 8, 0, min(U32, ms * a.sample_rate // 1000)
    for k, row in enumerate(avi.rows(S.AUDIO)):
        need(row[3] % width == 0)
        n = row[3] // width
        if target - low < n:
            return k, target - low, n - (target - low)
        low += n
    raise Bad


def frame_time_ms(frame: int, fps: float) -> int:
    return 0 if not fps > 0 or math.isinf(fps) else min(U32, int(frame * 1000.0 / fps))
