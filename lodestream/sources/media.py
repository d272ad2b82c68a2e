"""Binary media to relations: probe, inspect and index in one pass over each source's bytes.

A source is one row (source_id string, content binary).  Everything about it comes out of a
single call, so content crosses to Python once, and a source that breaks any rule has a status
and no rows at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .. import status as S
from . import boxes, flac, riff, streams
from .bits import Bad, need, unpack

TrackReader = Callable[..., list[tuple]]
#: container id: (tracks, packets); the extension point for further containers
INDEXERS: dict[int, tuple[TrackReader, TrackReader]] = {
    S.MP4: (boxes.mp4_tracks, boxes.mp4_packets),
    S.WEBM: (boxes.mkv_tracks, boxes.mkv_packets),
    S.MATROSKA: (boxes.mkv_tracks, boxes.mkv_packets),
    S.AVI: (riff.avi_tracks, riff.avi_packets),
    S.WAV: (riff.wav_tracks, riff.wav_packets),
    S.FLAC: (flac.flac_tracks, flac.flac_packets),
    S.OGG: (streams.ogg_tracks, streams.ogg_packets),
    S.ADTS: (streams.adts_tracks, streams.adts_packets),
}


def probe(data: bytes, max_bytes: int = S.MAX_SOURCE_BYTES) -> int:
    """Container id by the leading bytes, or 0."""
    try:
        need(0 < len(data) <= max_bytes)
        if data[:4] == b"fLaC":
            return S.FLAC
        if data[:4] == b"OggS":
            need(len(data) >= 27 and data[4] == 0)
            n = data[26]
            need(len(data) >= 27 + n + sum(data[27 : 27 + n]))
            return S.OGG
        if len(data) >= 7 and data[0] == 0xFF and data[1] & 0xF6 == 0xF0:
            streams.adts_header(data, 0)
            return S.ADTS
        if data[:4] == b"RIFF":
            need(len(data) >= 12 and 8 + unpack("<I", data, 4)[0] <= len(data))
            return {b"AVI ": S.AVI, b"WAVE": S.WAV}.get(data[8:12], 0)
        if data[:4] == b"\x1aE\xdf\xa3":
            return {"webm": S.WEBM, "matroska": S.MATROSKA}[boxes.doctype(data)]
        for kind, _, _ in boxes.boxes(data, 0, len(data)):
            if kind == b"ftyp":
                return S.MP4
    except (Bad, StopIteration):
        pass
    return 0


def inspect(data: bytes, max_bytes: int = S.MAX_SOURCE_BYTES, limits: S.Limits = S.LIMITS) -> tuple[int, int, list[tuple]]:
    """(status, container, tracks)."""
    if not data or len(data) > max_bytes:
        return S.INVALID, 0, []
    container = probe(data, max_bytes)
    if not container:
        return S.UNSUPPORTED, 0, []
    try:
        return S.OK, container, INDEXERS[container][0](data, limits=limits)
    except (Bad, StopIteration):
        return S.UNSUPPORTED, container, []


def index(data: bytes, max_bytes: int = S.MAX_SOURCE_BYTES, frames_per_packet: int = 1, limits: S.Limits = S.LIMITS) -> tuple[int, int, list[tuple], list[tuple]]:
    """(status, container, tracks, packets in order of their offsets); all or nothing, and a source without packets is unsupported.

    ``frames_per_packet`` groups the sample frames of a WAV source.
    """
    status, container, tracks = inspect(data, max_bytes, limits)
    if status != S.OK:
        return status, container, [], []
    try:
        packets = INDEXERS[container][1](data, *([frames_per_packet] if container == S.WAV else []), limits=limits)
        need(0 < len(packets) <= limits.packets)
        known = {t[0] for t in tracks}
        need(all(p[2] in known for p in packets))
    except (Bad, StopIteration):
        return S.UNSUPPORTED, container, [], []
    return S.OK, container, tracks, sorted(packets, key=lambda p: p[0])  # sorted() is stable


_PACKET_NAMES = [f.split(" ")[0] for f in schemas.PACKET.split(", ")]


def _arrow(name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T._parse_datatype_string(schemas.INDEXED)
    return to_arrow_type(schema[name].dataType)


def _lists(rows: list[list[tuple]], kind: pa.DataType) -> pa.ListArray:
    """A list of structs for each source, column by column."""
    fields = list(kind.value_type)
    columns = list(zip(*(r for own in rows for r in own), strict=True)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if pa.types.is_decimal(kind):
        try:
            return pa.array(values, pa.int64()).cast(pa.decimal128(19, 0)).cast(kind)
        except (pa.ArrowInvalid, OverflowError):
            pass
    return pa.array(values, kind)


def indexed(sources: DataFrame, packets: bool = True, max_bytes: int = S.MAX_SOURCE_BYTES, frames_per_packet: int = 1, limits: S.Limits = S.LIMITS) -> DataFrame:
    """source_id, status, container_id, tracks, packets: one row a source, whatever becomes of it."""
    track_type, packet_type = _arrow("tracks"), _arrow("packets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [index(d or b"", max_bytes, frames_per_packet, limits) if packets else (*inspect(d or b"", max_bytes, limits), []) for d in b.column("content").to_pylist()]
            tracks = _lists([g[2] for g in got], track_type)
            rows = _lists([[(k, *p) for k, p in enumerate(g[3])] for g in got], packet_type)
            codes = [pa.array([g[k] for g in got], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("source_id"), *codes, tracks, rows], names=["source_id", "status", "container_id", "tracks", "packets"])

    return sources.select(F.col("source_id").cast("string"), "content").mapInArrow(run, f"source_id string, {schemas.INDEXED}")


def tracks(found: DataFrame) -> DataFrame:
    return found.where("status = 0").select("source_id", "container_id", F.inline("tracks"))


def packets(found: DataFrame) -> DataFrame:
    return found.where("status = 0").select("source_id", F.inline("packets"))


def statuses(found: DataFrame, stage: str = "index") -> DataFrame:
    return found.select("source_id", F.lit(stage).alias("stage"), F.col("status").alias("code"))


def read_files(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = S.MAX_SOURCE_BYTES) -> DataFrame:
    """(source_id, content) of all files; the bytes of oversized ones are not read, their content is null (status: invalid)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    read = files.where(F.col("length") <= max_bytes).select(F.col("path").alias("source_id"), "content")
    return read.union(files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary")))


def packet_payloads(found: DataFrame, sources: DataFrame, max_bytes: int = S.MAX_PACKET_BYTES) -> DataFrame:
    """All packets with a status and their bytes; an oversized packet is invalid and has no payload.

    A source's content meets its list of packets once, and all payloads are cut there.
    """
    content = sources.select(F.col("source_id").cast("string"), "content")
    both = found.where("status = 0").select("source_id", "packets").join(content, "source_id")

    def cut(p: Column) -> Column:
        fits = p["byte_size"] <= max_bytes
        body = F.when(fits, F.substring("content", p["byte_offset"].cast("int") + 1, p["byte_size"].cast("int")))
        return F.struct(*(p[n].alias(n) for n in _PACKET_NAMES), F.when(fits, S.OK).otherwise(S.INVALID).alias("packet_status"), body.alias("payload"))

    return both.select("source_id", F.inline(F.transform("packets", cut)))


def indexed_payloads(sources: DataFrame, max_packet_bytes: int = S.MAX_PACKET_BYTES, max_bytes: int = S.MAX_SOURCE_BYTES, frames_per_packet: int = 1, limits: S.Limits = S.LIMITS) -> DataFrame:
    """All packets of ``packet_payloads``, cut in the pass that indexes them, so that a source's bytes are made and moved once.

    Columns: source_id, status, those of a packet, packet_status and payload.  A source that is rejected has one row with its status.
    """
    fields = list(_arrow("packets").value_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            source, payloads = [], []
            for at, data in enumerate(b.column("content").to_pylist()):
                status, _, _, found = index(data or b"", max_bytes, frames_per_packet, limits)
                if status:
                    found = [(None, None, None, None, None, None)]
                    payloads.append(None)
                    rows.append((status, None, *found[0], None))
                else:
                    for k, p in enumerate(found):
                        fits = p[1] <= max_packet_bytes
                        rows.append((S.OK, k, *p, S.OK if fits else S.INVALID))
                        payloads.append(data[p[0] : p[0] + p[1]] if fits else None)
                source += [at] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * (len(fields) + 2)
            kinds = [pa.int32(), *(f.type for f in fields), pa.int32()]
            # decimals are cast from integers where these fit, which is much faster than from Python's values
            made = [_column(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("source_id").take(pa.array(source, pa.int32())), *made, pa.array(payloads, pa.binary())], names=["source_id", "status", *_PACKET_NAMES, "packet_status", "payload"])

    return sources.select(F.col("source_id").cast("string"), "content").mapInArrow(run, f"source_id string, status int, {schemas.PACKET}, packet_status int, payload binary")


def samples_by_packets(sources: DataFrame, frames_per_packet: int = 1, max_bytes: int = S.MAX_SOURCE_BYTES, limits: S.Limits = S.LIMITS) -> DataFrame:
    """(source_id, status, packet, frame, channel, value): uncompressed WAV decoded by its packet table, a source's rows or its status only.

    Packets must cover the source's samples without a gap; a source that fails has one row with its status.
    """
    from ..functions.codecs import decode_packets

    names = ["source_id", "status", "packet", "frame", "channel", "value"]

    def one(data: bytes) -> tuple[int, list[tuple], np.ndarray]:
        status, container, _, found = index(data, max_bytes, frames_per_packet, limits)
        if status or container != S.WAV:
            return status or S.UNSUPPORTED, [], np.zeros((0, 1), np.int64)
        w = riff.open_wav(data)
        try:
            return S.OK, found, decode_packets(data, found, w.tag, w.bits, w.channels, w.samples, limits)
        except Bad:
            return S.MALFORMED, [], np.zeros((0, 1), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, data in zip(b.column("source_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                status, found, got = one(data or b"")
                n, channels = got.shape
                packet = np.repeat(np.arange(len(found)), [p[4] for p in found]) if found else np.zeros(0, np.int64)
                columns = [np.repeat(packet, channels), np.repeat(np.arange(n), channels), np.tile(np.arange(channels), n), got.ravel()]
                rows = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)] if n else [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                many = max(n * channels, 1)
                yield pa.RecordBatch.from_arrays([pa.array([ident], pa.string()).take(pa.array(np.zeros(many, np.int32))), pa.array(np.full(many, status, np.int32)), *rows], names=names)

    return sources.select(F.col("source_id").cast("string"), "content").mapInArrow(run, "source_id string, status int, packet bigint, frame bigint, channel int, value int")


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.CODECS, "codec_id int, name string")


def find_capability(names: DataFrame, spark: SparkSession, name_col: str = "name") -> DataFrame:
    """codec_id of each name, -1 for unknown ones; the table is a constant of seven rows."""
    return names.join(F.broadcast(capabilities(spark).withColumnRenamed("name", name_col)), name_col, "left").withColumn("codec_id", F.coalesce("codec_id", F.lit(-1)))
