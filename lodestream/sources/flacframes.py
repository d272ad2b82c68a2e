"""FLAC sources as relations: a walk finds the frames, Spark checks their order and decodes them frame by frame.

A frame is a row with its header and its bytes.  One blocking strategy, numbers without a gap, the declared total, running timestamps,
limits and statuses are windows over these rows; decoding takes rows, so a source's frames may be decoded by many tasks, and a source of which
one frame is wrong has no samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import status as S
from . import flac
from .bits import Bad

FRAMES = "source_id string, status int, inspect_status int, seq bigint, byte_offset bigint, byte_size bigint, variable boolean, number bigint, block bigint, total bigint, rate bigint, channels int, bits int, payload binary"
_NAMES = [f.split(" ")[0] for f in FRAMES.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
SAMPLES = "source_id string, frame bigint, channel int, value int"


def walked(sources: DataFrame, max_bytes: int = S.MAX_SOURCE_BYTES) -> DataFrame:
    """FRAMES of all sources; one row with the status of a source in which the frames do not lead from the metadata to the last byte.

    inspect_status is that of the metadata alone.
    """
    kinds = [_TYPES[f.split(" ")[1]] for f in FRAMES.split(", ")]

    def rows(ident: str, data: bytes | None) -> list[tuple]:
        one = lambda status, inspect, info=None: [(ident, status, inspect, *[None] * 6, *((info.total, info.rate, info.channels, info.bits) if info else [None] * 4), None)]
        if not data or len(data) > max_bytes:
            return one(S.INVALID, S.INVALID)
        try:
            info = flac.open_flac(data)
        except Bad:
            return one(S.UNSUPPORTED, S.UNSUPPORTED)
        at, out = info.first, []
        try:
            h = flac.frame_header(data, at, info) if at < len(data) else None
            while h is not None:
                end, follower = flac._frame_end(data, at, h, info)
                out.append((ident, S.OK, S.OK, len(out), at, end - at, h.variable, h.number, h.block, info.total, info.rate, info.channels, info.bits, data[at:end]))
                at, h = end, follower
        except Bad:
            return one(S.UNSUPPORTED, S.OK, info)
        return out or one(S.UNSUPPORTED, S.OK, info)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for ident, data in zip(b.column("source_id").to_pylist(), b.column("content").to_pylist(), strict=True) for r in rows(ident, data)]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)

    return sources.select(F.col("source_id").cast("string").alias("source_id"), "content").mapInArrow(run, FRAMES)


def _source() -> WindowSpec:
    return Window.partitionBy("source_id")


def checked(frames: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """FRAMES with index_status, timestamp_ticks and duration_ticks."""
    c = F.col
    along = _source().orderBy("seq")
    before = F.lag("number").over(along)
    follows = before.isNull() | F.when(c("variable"), c("number") > before).otherwise(c("number") == before + 1)
    marked = frames.withColumn("follows", follows)
    n, samples = F.count("*").over(_source()), F.sum("block").over(_source())
    right = (c("status") == S.OK) & (F.min(c("follows").cast("int")).over(_source()) == 1) & (F.min("variable").over(_source()) == F.max("variable").over(_source()))
    right &= (n <= limits.packets) & ((c("total") == 0) | (samples == c("total")))
    code = F.when(c("status") != S.OK, c("status")).when(F.coalesce(right, F.lit(False)), S.OK).otherwise(S.UNSUPPORTED)
    time = F.coalesce(F.sum("block").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumns({"index_status": code, "timestamp_ticks": time, "duration_ticks": c("block")}).drop("follows")


def tracks(frames: DataFrame) -> DataFrame:
    """TRACKS: one row a source, of its metadata."""
    one = frames.where(F.col("inspect_status") == S.OK).groupBy("source_id").agg(F.first("rate").alias("time_scale"), F.first("total").alias("total"))
    return one.select("source_id", F.lit(S.FLAC).alias("container_id"), F.lit(1).cast("bigint").alias("track_id"), F.lit(S.AUDIO).alias("kind"), F.lit(flac.CODEC).cast("bigint").alias("codec_id"), "time_scale", F.col("total").cast("decimal(20,0)").alias("duration_ticks"), F.lit("FLAC").alias("codec_name"))


def packets(found: DataFrame) -> DataFrame:
    """PACKETS of ``checked`` frames."""
    good = found.where(F.col("index_status") == S.OK)
    return good.select("source_id", F.col("seq").cast("int").alias("seq"), "byte_offset", "byte_size", F.lit(1).cast("bigint").alias("track_id"), F.col("timestamp_ticks").cast("decimal(20,0)").alias("timestamp_ticks"), "duration_ticks", F.lit(S.KEYFRAME).alias("flags"))


def statuses(found: DataFrame) -> DataFrame:
    """(source_id, stage, code, n_packets), one row a source."""
    n = F.sum(F.when(F.col("index_status") == S.OK, 1).otherwise(0))
    return found.groupBy("source_id").agg(F.first("index_status").alias("code"), n.alias("n_packets")).select("source_id", F.lit("index").alias("stage"), "code", "n_packets")


def samples(found: DataFrame) -> DataFrame:
    """SAMPLES of ``checked`` frames: each frame by itself; sources of which a frame cannot be decoded have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[np.ndarray | None] = []
            for block, rate, channels, bits, payload in zip(*(b.column(k).to_pylist() for k in ("block", "rate", "channels", "bits", "payload")), strict=True):
                try:
                    got = flac.decode_frame(payload, flac.Info(rate, channels, bits, 0, 0))
                    found.append(got.ravel() if len(got) == block else None)
                except Bad:
                    found.append(None)
            sizes, whole = np.array([0 if g is None else len(g) for g in found], np.int64), [g for g in found if g is not None]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([*(g is None for g in found), False]))
            values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(whole).astype(np.int32) if whole else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("source_id"), b.column("timestamp_ticks"), b.column("channels"), values], names=["source_id", "time", "channels", "values"])

    good = found.where(F.col("index_status") == S.OK).select("source_id", "timestamp_ticks", "block", "rate", "channels", "bits", "payload")
    decoded = good.mapInArrow(run, "source_id string, time bigint, channels int, values array<int>").withColumn("_bad", F.max(F.col("values").isNull().cast("int")).over(_source()))
    each = decoded.where("_bad = 0").select("source_id", "time", "channels", F.posexplode("values").alias("at", "value"))
    return each.select("source_id", (F.col("time") + F.call_function("div", F.col("at"), F.col("channels"))).alias("frame"), (F.col("at") % F.col("channels")).alias("channel"), "value")
