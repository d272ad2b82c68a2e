"""Writers of small media files, used for tests and for queries over built blobs.

They share nothing with the readers (not even the checksums), so round trips prove something.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import cache, lru_cache, wraps


@cache
def _bytes(poly: int, width: int) -> list[int]:
    """What each leading byte leaves behind, by shifting bit after bit."""
    out = []
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = ((value << 1) ^ poly) if value & (1 << (width - 1)) else value << 1
            value &= (1 << width) - 1
        out.append(value)
    return out


def _crc(data: bytes, poly: int, width: int) -> int:
    left, value, mask, top = _bytes(poly, width), 0, (1 << width) - 1, width - 8
    for byte in data:
        value = (value << 8 & mask) ^ left[value >> top ^ byte]
    return value


def kept(f: Callable[..., bytes]) -> Callable[..., bytes]:
    """``f`` whose small pieces (first argument: bytes or a tuple) are made once, as files of small tables repeat theirs."""
    known = lru_cache(1 << 16)(f)

    @wraps(f)
    def call(first: bytes | tuple, *rest: object, **more: object) -> bytes:
        return (known if len(first) <= 256 else f)(first, *rest, **more)

    return call


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def wav(payload: bytes, tag: int = 1, channels: int = 1, rate: int = 8000, bits: int = 16, align: int | None = None, extra: bytes = b"") -> bytes:
    align = align or channels * bits // 8
    head = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits) + extra
    body = b"WAVE" + chunk(b"fmt ", head) + chunk(b"data", payload)
    return chunk(b"RIFF", body)


def avi(frames: list[tuple[bytes, bytes]], width: int = 4, height: int = 2, bits: int = 24, codec: bytes = b"MJPG", rate: int = 25, audio: bool = False, sample_rate: int = 8000) -> bytes:
    """``frames``: (chunk id such as b"00dc" or b"01wb", payload)."""
    video = sum(n[2:] != b"wb" for n, _ in frames)
    header, movi, index = _avi_header(video, len(frames), width, height, bits, codec, rate, audio, sample_rate), [b"movi"], []
    at = 4
    for name, payload in frames:
        index.append(struct.pack("<4sIII", name, 0x10, at, len(payload)))
        movi.append(_avi_chunk(payload, name))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


@kept
def _avi_chunk(payload: bytes, name: bytes) -> bytes:
    return chunk(name, payload)


@lru_cache(1024)
def _avi_header(video: int, n: int, width: int, height: int, bits: int, codec: bytes, rate: int, audio: bool, sample_rate: int) -> bytes:
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 0x10, video, 0, 1 + audio, 0, width, height, 0, 0, 0, 0)
    strh = b"vids" + codec + struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, rate, 0, video, 0, 0, 0) + b"\0" * 8
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, bits, codec, 0, 0, 0, 0, 0)
    streams = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    if audio:
        a_head = b"auds" + b"\0" * 4 + struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, sample_rate, 0, n - video, 0, 0, 0) + b"\0" * 8
        streams += chunk(b"LIST", b"strl" + chunk(b"strh", a_head) + chunk(b"strf", struct.pack("<HHIIHH", 1, 1, sample_rate, sample_rate * 2, 2, 16)))
    return chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + streams)


def flac(samples: list[list[int]], rate: int = 8000, bits: int = 16, block: int = 64, constant: bool = False) -> bytes:
    """Verbatim (or constant) subframes; ``samples``: one list of a value per channel for each sample frame."""
    channels = len(samples[0])
    info = struct.pack(">HH", block, block) + b"\0" * 6 + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info
    depth = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits]
    for n, at in enumerate(range(0, len(samples), block)):
        out += _flac_frame(tuple(map(tuple, samples[at : at + block])), n, channels, bits, depth, constant)
    return out


@kept
def _flac_frame(part: tuple[tuple[int, ...], ...], n: int, channels: int, bits: int, depth: int, constant: bool) -> bytes:
    number = chr(n).encode("utf-8")
    head = bytes([0xFF, 0xF8, 7 << 4, (channels - 1) << 4 | depth << 1]) + number + struct.pack(">H", len(part) - 1)
    head += bytes([_crc(head, 7, 8)])
    stream = ""
    for c in range(channels):
        values = [row[c] & ((1 << bits) - 1) for row in part]
        stream += "00000000" + format(values[0], f"0{bits}b") if constant else "00000010" + "".join(format(v, f"0{bits}b") for v in values)
    stream += "0" * (-len(stream) % 8)
    frame = head + int(stream, 2).to_bytes(len(stream) // 8, "big")
    return frame + struct.pack(">H", _crc(frame, 0x8005, 16))


def adts(payloads: list[bytes], rate_index: int = 4, channels: int = 2) -> bytes:
    return b"".join(_adts_frame(p, rate_index, channels) for p in payloads)


@kept
def _adts_frame(p: bytes, rate_index: int, channels: int) -> bytes:
    n = len(p) + 7
    bits = f"{0xFFF:012b}0001{1:02b}{rate_index:04b}0{channels:03b}0000{n:013b}{0x7FF:011b}00"
    return int(bits, 2).to_bytes(7, "big") + p


def ogg_page(packets: list[bytes], granule: int, sequence: int, flags: int = 0, serial: int = 7) -> bytes:
    if len(packets) == 1:
        return _ogg_page(packets[0], granule, sequence, flags, serial)
    return _ogg_pages(packets, granule, sequence, flags, serial)


def _ogg_pages(packets: list[bytes], granule: int, sequence: int, flags: int, serial: int) -> bytes:
    table = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    head = b"OggS\0" + struct.pack("<BQIII", flags, granule & (2**64 - 1), serial, sequence, 0) + bytes([len(table)]) + table
    page = head + b"".join(packets)
    return page[:22] + struct.pack("<I", _crc(page, 0x04C11DB7, 32)) + page[26:]


@kept
def _ogg_page(packet: bytes, *of: int) -> bytes:
    return _ogg_pages([packet], *of)


@cache
def _opus_head() -> bytes:
    head = b"OpusHead" + bytes([1, 1]) + struct.pack("<HIh", 0, 48000, 0) + b"\0"
    return ogg_page([head], 0, 0, 2) + ogg_page([b"OpusTags" + b"\0" * 8], 0, 1)


@lru_cache(1024)
def _vorbis_head(rate: int) -> bytes:
    ident = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, rate, 0, 0, 0, 0xB8) + b"\x01"
    return ogg_page([ident], 0, 0, 2) + ogg_page([b"\x03vorbis\0", b"\x05vorbis\0"], 0, 1)


def ogg_opus(packets: list[bytes], ticks: int = 960) -> bytes:
    out = _opus_head()
    for k, p in enumerate(packets):
        out += ogg_page([p], ticks * (k + 1), k + 2)
    return out


def ogg_vorbis(packets: list[tuple[bytes, int]], rate: int = 44100) -> bytes:
    """``packets``: (payload whose first bit is 0, granule)."""
    out = _vorbis_head(rate)
    for k, (p, granule) in enumerate(packets):
        out += ogg_page([p], granule, k + 2)
    return out


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, body: bytes, version: int = 0) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]) + body)


@lru_cache(1024)
def _mp4_fixed(handler: bytes, codec: bytes) -> tuple[bytes, bytes, bytes, bytes]:
    stsd, hdlr = full(b"stsd", struct.pack(">I", 1) + box(codec, b"\0" * 28)), full(b"hdlr", b"\0" * 4 + handler + b"\0" * 13)
    return box(b"ftyp", b"isom\0\0\0\0isom"), stsd, full(b"tkhd", struct.pack(">IIII", 0, 0, 1, 0) + b"\0" * 64), hdlr


def mp4(payloads: list[bytes], deltas: list[int], scale: int = 1000, shifts: list[int] | None = None, keys: list[int] | None = None, per_chunk: int = 1, handler: bytes = b"soun", codec: bytes = b"mp4a", wide: bool = False) -> bytes:
    """One track; samples lie in chunks of ``per_chunk``."""
    ftyp, stsd, tkhd, hdlr = _mp4_fixed(handler, codec)
    offsets, at = [], len(ftyp) + 8
    for k, p in enumerate(payloads):
        if k % per_chunk == 0:
            offsets.append(at)
        at += len(p)
    table = lambda form, *flat: struct.pack(f">I{len(flat)}{form}", len(flat), *flat)
    pairs = lambda form, flat: struct.pack(f">I{form * len(flat)}", len(flat), *(x for d in flat for x in (1, d)))
    full_chunks, rest = divmod(len(payloads), per_chunk)
    groups = ([(1, per_chunk, 1)] if full_chunks else []) + ([(full_chunks + 1, rest, 1)] if rest else [])
    stbl = stsd + full(b"stts", pairs("II", deltas)) + full(b"stsc", struct.pack(">I", len(groups)) + b"".join(struct.pack(">III", *g) for g in groups))
    stbl += full(b"stsz", struct.pack(f">II{len(payloads)}I", 0, len(payloads), *map(len, payloads)))
    stbl += full(b"co64", table("Q", *offsets)) if wide else full(b"stco", table("I", *offsets))
    if shifts:
        stbl += full(b"ctts", pairs("Ii", shifts), 1)
    if keys is not None:
        stbl += full(b"stss", table("I", *keys))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, scale, sum(deltas)) + b"\0" * 4)
    trak = box(b"trak", tkhd + box(b"mdia", mdhd + hdlr + box(b"minf", box(b"stbl", stbl))))
    return ftyp + box(b"mdat", b"".join(payloads)) + box(b"moov", trak)


def element(kind: int, body: bytes) -> bytes:
    n = (kind.bit_length() + 7) // 8
    return kind.to_bytes(n, "big") + (0x0100000000000000 | len(body)).to_bytes(8, "big") + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(payload: bytes, relative: int = 0, flags: int = 0x80, track: int = 1) -> bytes:
    return bytes([0x80 | track]) + struct.pack(">hB", relative, flags) + payload


def mkv(clusters: list[tuple[int, list[bytes]]], doctype: str = "webm", codec: bytes = b"V_VP8", scale: int = 1_000_000) -> bytes:
    """``clusters``: (time, elements such as ``element(0xA3, block(...))``)."""
    head, body = _mkv_head(doctype, codec, scale)
    return head + element(0x18538067, body + b"".join([_cluster(tuple(parts), time) for time, parts in clusters]))


@lru_cache(1024)
def _mkv_head(doctype: str, codec: bytes, scale: int) -> tuple[bytes, bytes]:
    tracks = element(0x1654AE6B, element(0xAE, uint(0xD7, 1) + uint(0x83, 1) + element(0x86, codec)))
    return element(0x1A45DFA3, element(0x4282, doctype.encode())), element(0x1549A966, uint(0x2AD7B1, scale)) + tracks


def _cluster(parts: tuple[bytes, ...], time: int) -> bytes:
    return element(0x1F43B675, uint(0xE7, time) + b"".join(parts))


def xiph_lace(frames: list[bytes]) -> bytes:
    return bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)


def fixed_lace(frames: list[bytes]) -> bytes:
    return bytes([len(frames) - 1]) + b"".join(frames)


def ebml_lace(frames: list[bytes]) -> bytes:
    """First size as two bytes, then signed differences of two bytes."""
    sizes = [len(f) for f in frames]
    head = struct.pack(">H", 0x4000 | sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        head += struct.pack(">H", 0x4000 | (b - a + 0x1FFF))
    return bytes([len(frames) - 1]) + head + b"".join(frames)
