"""Decoding of uncompressed packets with numpy, and the vectorised functions around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import flac, media, riff
from ..sources.bits import Bad, need


def pcm_to_s16(data: bytes, tag: int, bits: int, signed8: bool = False, compat: bool = False) -> np.ndarray:
    """Interleaved samples as int16; a cut sample or a NaN or infinity is Bad."""
    width = bits // 8
    need(width and len(data) % width == 0)
    raw = np.frombuffer(data, np.uint8)
    if tag == riff.ALAW:
        return _alaw(compat)[raw]
    if tag == riff.MULAW:
        return _ulaw()[raw]
    if tag == riff.FLOAT:
        x = np.frombuffer(data, "<f4")
        need(np.isfinite(x).all())
        return np.trunc(np.clip(x, np.float32(-1), np.float32(1)) * np.float32(32767)).astype(np.int16)
    need(tag == riff.PCM)
    if bits == 8:
        return (raw.view(np.int8).astype(np.int16) * 256) if signed8 else ((raw.astype(np.int16) - 128) * 256).astype(np.int16)
    if bits == 16:
        return np.frombuffer(data, "<i2").copy()
    if bits == 24:
        return (raw.reshape(-1, 3)[:, 1].astype(np.uint16) | raw.reshape(-1, 3)[:, 2].astype(np.uint16) << 8).view(np.int16)
    need(bits == 32)
    return (np.frombuffer(data, "<i4") >> 16).astype(np.int16)


@cache
def _alaw(compat: bool) -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(seg == 0, low + 8, (low + 0x108) << np.maximum(seg - 1, 0))
    positive = (a & 0x80 != 0) != compat
    return np.where(positive, size, -size).astype(np.int16)


@cache
def _ulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 0x84) << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


#: IMA ADPCM index changes and step sizes.
_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)
_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


@cache
def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each of the 16 codes adds to the value, and the step after it, for every step."""
    size, code = np.array(_STEPS)[:, None], np.arange(16)
    change = (size >> 3) + np.where(code & 4, size, 0) + np.where(code & 2, size >> 1, 0) + np.where(code & 1, size >> 2, 0)
    after = np.clip(np.arange(len(_STEPS))[:, None] + np.array(_CHANGE)[code & 7], 0, len(_STEPS) - 1)
    return np.where(code & 8, -change, change), after


def ima_blocks(blocks: list[bytes], channels: int) -> list[np.ndarray]:
    """(frames, channels) of each block: a header a channel, then groups of four bytes a channel.

    Blocks do not depend on each other, so all of a similar length advance together, a code at a time; the longest
    come first, and the shorter ones drop out at their ends.
    """
    out: list[np.ndarray] = [np.zeros((0, channels), np.int16)] * len(blocks)
    head = 4 * channels
    lengths = np.array([len(b) for b in blocks], np.int64)
    need((lengths > head).all() and (lengths % head == 0).all())
    alike = np.frexp(lengths - 1)[1]  # within a factor of two
    for of in np.unique(alike).tolist():
        places = np.flatnonzero(alike == of)
        places = places[np.argsort(-lengths[places], kind="stable")]
        got, frames = _ima_together([blocks[k] for k in places], lengths[places], channels)
        for j, (k, n) in enumerate(zip(places.tolist(), frames.tolist(), strict=True)):
            out[k] = got[j * channels : (j + 1) * channels, :n].T
    return out


def _ima_together(blocks: list[bytes], lengths: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """(channels of all blocks, frames) and each block's number of frames; longest blocks first."""
    change, after = (t.astype(np.int32).ravel() for t in _ima_tables())
    n, head, longest = len(blocks), 4 * channels, int(lengths[0])
    raw = np.frombuffer(b"".join([b.ljust(longest, b"\0") for b in blocks]), np.uint8).reshape(n, longest)
    heads = raw[:, :head].reshape(n, channels, 4)
    value, step = heads[..., :2].copy().view("<i2").ravel().astype(np.int32), heads[..., 2].ravel().astype(np.int32)
    need((step < len(_STEPS)).all())
    groups = raw[:, head:].reshape(n, -1, channels, 4).transpose(1, 3, 0, 2)
    codes = np.stack([groups & 15, groups >> 4], axis=2).reshape(-1, n * channels)
    frames = (lengths - head) // head * 8
    live = n - np.searchsorted(frames[::-1], np.arange(len(codes)), side="right")
    got = np.zeros((len(codes) + 1, n * channels), np.int16)
    got[0] = value
    for k, (code, m) in enumerate(zip(codes, (live * channels).tolist(), strict=True), 1):
        at, v = step[:m] * 16 + code[:m], value[:m]
        v += change.take(at)
        np.minimum(np.maximum(v, -32768, out=v), 32767, out=v)
        after.take(at, out=step[:m], mode="clip")
        got[k, :m] = v
    return np.ascontiguousarray(got.T), frames + 1


def ima_block(block: bytes, channels: int) -> np.ndarray:
    return ima_blocks([block], channels)[0]


def raw_frame(data: bytes, width: int, height: int, bits: int, bgr: bool = True, top_down: bool = False) -> np.ndarray:
    """(height, width) ARGB of an uncompressed frame with rows padded to four bytes, bottom row first."""
    need(1 <= width <= 4096 and 1 <= height <= 4096 and width * height <= 16_777_216 and bits in (16, 24, 32))
    stride = (width * bits // 8 + 3) & ~3
    need(len(data) >= stride * height)
    rows = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)[:, : width * bits // 8]
    if not top_down:
        rows = rows[::-1]
    if bits == 16:
        p = rows.copy().view("<u2").astype(np.uint32)
        r, g, b = (p >> 11 & 31) << 3, (p >> 5 & 63) << 2, (p & 31) << 3
        if bgr:
            r, b = b, r
        return np.uint32(0xFF000000) | r << 16 | g << 8 | b
    px = rows.reshape(height, width, bits // 8).astype(np.uint32)
    r, g, b = (px[..., 2], px[..., 1], px[..., 0]) if bgr else (px[..., 0], px[..., 1], px[..., 2])
    a = px[..., 3] if bits == 32 else np.uint32(255)
    return np.uint32(a) << 24 | r << 16 | g << 8 | b


def decode_packets(data: bytes, packets: list[tuple], tag: int, bits: int, channels: int, total: int = 0, limits: media.S.Limits = media.S.LIMITS, signed8: bool = False) -> np.ndarray:
    """Samples (frames, channels) of a packet table of one uncompressed track.

    Packets must follow each other in the source without overlap and in time without a gap, hold
    whole sample frames that agree with their durations, and cover ``total`` if it is known.
    """
    width, time, end, out = channels * bits // 8, 0, 0, []
    need(0 < len(packets) <= limits.packets and 1 <= channels <= 32 and width)
    for at, size, track, timestamp, duration, _ in packets:
        need(track == packets[0][2] and at >= end and at + size <= len(data) and size <= media.S.MAX_PACKET_BYTES)
        need(timestamp == time and size == duration * width)
        out.append(pcm_to_s16(data[at : at + size], tag, bits, signed8).reshape(-1, channels))
        time, end = time + duration, at + size
    need(not total or time == total)
    return np.concatenate(out)


def _decode_flac(data: bytes, limits: media.S.Limits) -> tuple[np.ndarray, int]:
    return flac.decode(data, flac.flac_packets(data, limits)), flac.open_flac(data).rate


def _decode_wav(data: bytes, limits: media.S.Limits) -> tuple[np.ndarray, int]:
    w = riff.open_wav(data)
    body = data[w.start : w.start + w.size]
    if w.tag == riff.IMA:
        return np.concatenate(ima_blocks([body[k : k + w.align] for k in range(0, w.size, w.align)], w.channels)), w.rate
    return pcm_to_s16(body, w.tag, w.bits).reshape(-1, w.channels), w.rate


#: container id: decoder of a whole source to (samples (frames, channels), rate); the extension point for further ones, which raise Bad.
DECODERS: dict[int, Callable[[bytes, media.S.Limits], tuple[np.ndarray, int]]] = {media.S.FLAC: _decode_flac, media.S.WAV: _decode_wav}


def decode_source(data: bytes, max_bytes: int = media.S.MAX_SOURCE_BYTES, limits: media.S.Limits = media.S.LIMITS) -> tuple[int, np.ndarray, int]:
    """(status, samples (frames, channels), sample rate) of a source of a container in DECODERS; all or nothing."""
    nothing = np.zeros((0, 1), np.int64)
    status, container, _ = media.inspect(data, max_bytes, limits)
    if status:
        return status, nothing, 0
    if container not in DECODERS:
        return media.S.UNSUPPORTED, nothing, 0
    try:
        return 0, *DECODERS[container](data, limits)
    except Bad:
        return media.S.MALFORMED, nothing, 0


class _Held:
    """Rows of several sources until they are one batch; a column that is None is null."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds = names, kinds
        self.n, self.idents, self.counts, self.columns = 0, [], [], [[] for _ in names]

    def add(self, ident: str, columns: list[np.ndarray | None], n: int) -> None:
        self.idents.append(ident)
        self.counts.append(n)
        self.n += n
        for held, c, kind in zip(self.columns, columns, self.kinds, strict=True):
            held.append(pa.nulls(n, kind) if c is None else pa.array(c).cast(kind))

    def batch(self) -> pa.RecordBatch:
        ids = pa.array(self.idents, pa.string()).take(pa.array(np.repeat(np.arange(len(self.idents)), self.counts).astype(np.int64)))
        found = [ids, *(pa.concat_arrays(c) if c else pa.array([], k) for c, k in zip(self.columns, self.kinds, strict=True))]
        self.__init__(self.names, self.kinds)
        return pa.RecordBatch.from_arrays(found, names=["source_id", *self.names])


def decoded(sources: DataFrame, rows_at_once: int = 500_000, max_bytes: int = media.S.MAX_SOURCE_BYTES, limits: media.S.Limits = media.S.LIMITS) -> DataFrame:
    """(source_id, status, frame, channel, value): the samples of a source, or one row with its status and nulls (also for one without samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(["status", "frame", "channel", "value"], [pa.int32(), pa.int64(), pa.int32(), pa.int32()])
        for b in batches:
            for ident, data in zip(b.column("source_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                status, got, _ = decode_source(data or b"", max_bytes, limits)
                frames, channels = got.shape
                if status or not frames:
                    held.add(ident, [np.array([status]), None, None, None], 1)
                for at in range(0, 0 if status else frames, rows_at_once):
                    part = got[at : at + rows_at_once]
                    n = len(part)
                    held.add(ident, [np.zeros(n * channels, np.int32), np.repeat(np.arange(at, at + n), channels), np.tile(np.arange(channels, dtype=np.int32), n), part.ravel()], n * channels)
                    if held.n >= rows_at_once:
                        yield held.batch()
            yield held.batch()

    return sources.select(F.col("source_id").cast("string"), "content").mapInArrow(run, "source_id string, status int, frame bigint, channel int, value int")


def samples(sources: DataFrame, rows_at_once: int = 500_000, max_bytes: int = media.S.MAX_SOURCE_BYTES, limits: media.S.Limits = media.S.LIMITS) -> DataFrame:
    """(source_id, frame, channel, value) of all sources that decode; ``decoded`` has a row for the others as well."""
    return decoded(sources, rows_at_once, max_bytes, limits).where("frame is not null").drop("status")


#: Frames of a source that are one span of ``bounded_read``.
READ_SPAN = 4096


def bounded_read(found: DataFrame, requests: DataFrame, source: str = "source_id", at_once: int = 1024) -> DataFrame:
    """(source, request columns, frame, channel, value) of each request's frames: from ``position`` on, at most ``max_frames`` and ``at_once``.

    ``found`` is a relation of samples; ``requests`` has the source, position and max_frames.  A request that begins at or
    beyond the end, or asks for none, has no rows.  Requests meet the spans of READ_SPAN frames that they touch, by equality.
    """
    last = F.col("position") + F.least(F.col("max_frames"), F.lit(at_once))
    span = lambda c: F.call_function("div", c.cast("bigint"), F.lit(READ_SPAN))
    asked = requests.where((F.col("position") >= 0) & (F.col("max_frames") > 0)).withColumn("_span", F.explode(F.sequence(span(F.col("position")), span(last - 1))))
    met = found.withColumn("_span", span(F.col("frame"))).join(asked, [source, "_span"])
    return met.where((F.col("frame") >= F.col("position")) & (F.col("frame") < last)).drop("_span")


def resampled(found: DataFrame, rate: int, wanted: int, span: int = 4096) -> DataFrame:
    """Samples at another rate, by linear interpolation between neighbours (toward the earlier one); the last holds on.

    Each sample makes the output frames up to its successor.  Sources are cut into spans of frames, and the first
    sample of a span is also the end of the one before, so a long source is not one task.
    """
    frame, at = F.col("frame"), F.floor(F.col("frame") / span)
    cut = found.withColumn("_span", F.explode(F.when((frame % span == 0) & (frame > 0), F.array(at, at - 1)).otherwise(F.array(at))))
    w = Window.partitionBy("source_id", "channel", "_span").orderBy("frame")
    pairs = cut.withColumn("_next", F.coalesce(F.lead("value").over(w), F.col("value"))).where(F.col("_span") == at)
    first = lambda k: F.call_function("div", k * wanted + rate - 1, F.lit(rate))
    many = pairs.withColumns({"_from": first(frame), "_to": first(frame + 1) - 1}).where("_from <= _to")
    each = many.withColumn("_out", F.explode(F.sequence("_from", "_to")))
    moved = F.call_function("div", (F.col("_next") - F.col("value")).cast("bigint") * (F.col("_out") * rate - frame * wanted), F.lit(wanted))
    return each.select("source_id", F.col("_out").alias("frame"), "channel", (F.col("value") + moved).cast("int").alias("value"))


def remixed(found: DataFrame, channels: int) -> DataFrame:
    """Samples with so many channels: one is the mean of all (toward zero); more repeat those there are, in turn."""
    if channels == 1:
        mean = F.call_function("div", F.sum("value").cast("bigint"), F.count("*"))
        return found.groupBy("source_id", "frame").agg(mean.cast("int").alias("value")).select("source_id", "frame", F.lit(0).alias("channel"), "value")
    had = found.groupBy("source_id").agg((F.max("channel") + 1).alias("_had"))
    out = found.join(had, "source_id").withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    return out.where(F.col("_to") % F.col("_had") == F.col("channel")).select("source_id", "frame", F.col("_to").alias("channel"), "value")


#: The status of the row after the last frame of a source.
END = 1


def video(sources: DataFrame, first: int = 0, frames: int | None = None) -> DataFrame:
    """(source_id, status, frame_index, timestamp_ns, width, height, pixels) of uncompressed AVI video, from frame ``first`` on, so many at most.

    A source whose last frame is among what is asked for, or before it, has a row of status END behind it, with the number
    of its frames as frame_index; one that cannot be decoded has one row with its status.  Only the frames asked for are cut and decoded.
    """
    from decimal import Decimal

    names = ["source_id", "status", "frame_index", "timestamp_ns", "width", "height", "pixels"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.decimal128(20, 0), pa.int32(), pa.int32(), pa.binary()]

    def rows(ident: str, data: bytes) -> Iterator[tuple]:
        try:
            avi = riff.open_avi(data)
            v = avi.first(media.S.VIDEO)
            need(v is not None and v.compression in (0, int.from_bytes(b"DIB ", "little")) and v.rate)
        except Bad:
            yield ident, media.S.UNSUPPORTED, None, None, None, None, None
            return
        n = len(avi.rows(media.S.VIDEO))
        until = n if frames is None else min(n, first + frames)
        found = []
        try:
            for k in range(first, until):
                pixels = raw_frame(riff.nth_frame(data, k), v.width, v.height, v.bits, True, v.top_down)
                found.append((ident, media.S.OK, k, Decimal(k * v.scale * 1_000_000_000 // v.rate), v.width, v.height, pixels.astype("<u4").tobytes()))
        except Bad:
            yield ident, media.S.MALFORMED, None, None, None, None, None
            return
        yield from found
        if until == n:
            yield ident, END, n, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, data in zip(b.column("source_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                columns = zip(*rows(ident, data or b""), strict=True)
                if found := list(columns):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=names)

    return sources.select(F.col("source_id").cast("string"), "content").mapInArrow(run, "source_id string, status int, frame_index bigint, timestamp_ns decimal(20,0), width int, height int, pixels binary")


def video_frames(sources: DataFrame) -> DataFrame:
    """(source_id, frame_index, timestamp_ns, width, height, pixels): the frames of ``video``, without its other rows."""
    return video(sources).where(F.col("status") == media.S.OK).drop("status")
