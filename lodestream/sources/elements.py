"""Matroska and WebM sources as relations: a small walk per source yields its elements as lists, Spark does the rest.

A source is one row: its document types, segments, scales, durations and track entries, and its blocks in the order of the file, each with
the time of its cluster that was ahead of it.  Which of them may be there once, how tracks are unique, which track a block
belongs to, laces as rows and statuses are column expressions over these lists, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import status as S
from . import boxes as B
from .bits import Bad, fnv1a, need, take, unpack

ENTRY = "value decimal(20,0), role bigint, text string, start bigint"
BLOCK = "value bigint, base decimal(20,0), relative int, is_key boolean, duration decimal(20,0), start bigint, sizes array<bigint>"
ROWS = f"source_id string, status int, doctypes array<string>, segments int, scales array<bigint>, finite array<boolean>, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, broken boolean"
_UNSIGNED = pa.uint64()  # decimals in Spark, which has no such type
_ENTRY = [("value", _UNSIGNED), ("role", pa.int64()), ("text", pa.string()), ("start", pa.int64())]
_BLOCK = [("value", pa.int64()), ("base", _UNSIGNED), ("relative", pa.int32()), ("is_key", pa.bool_()), ("duration", _UNSIGNED), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))]


class _Walk:
    """What a walk finds in one source."""

    def __init__(self) -> None:
        self.status, self.segments, self.broken = S.OK, 0, False
        self.doctypes: list[str] = []
        self.scales: list[int] = []
        self.finite: list[bool] = []
        self.entries: list[tuple] = []
        self.blocks: list[tuple] = []

    def info(self, data: bytes, at: int, end: int) -> None:
        for kind, a, e in B.elements(data, at, end):
            if kind == B.SCALE:
                self.scales.append(B._uint(data, a, e, 4))
            elif kind == B.DURATION:
                value = unpack({4: ">f", 8: ">d"}.get(e - a, ">"), data, a)
                self.finite.append(bool(value) and math.isfinite(value[0]) and value[0] >= 0)

    def tracks(self, data: bytes, at: int, end: int) -> None:
        for kind, a, e in B.elements(data, at, end):
            if kind == B.ENTRY:
                got = {k: (x, y) for k, x, y in B.elements(data, a, e) if k in (B.NUMBER, B.KIND, B.CODEC_ID)}
                need(len(got) == 3)
                codec = data[slice(*got[B.CODEC_ID])].rstrip(b"\0")
                self.entries.append((B._uint(data, *got[B.NUMBER]), min(B._uint(data, *got[B.KIND]), 2**32), codec.decode("latin-1"), fnv1a(codec)))

    def block(self, data: bytes, at: int, end: int, base: int | None, key: bool | None, duration: int) -> None:
        number, at, _ = B.vint(data, at, end)
        relative, flags = unpack(">hB", data, at)
        sizes, start = B.lace_sizes(data, at + 3, end, flags >> 1 & 3)
        need(start <= end)
        self.blocks.append((number, base, relative, bool(flags & 0x80) if key is None else key, duration, start, sizes))

    def cluster(self, data: bytes, at: int, end: int) -> None:
        base = None
        for kind, a, e in B.elements(data, at, end):
            if kind == B.TIME:
                need(base is None)
                base = B._uint(data, a, e)
            elif kind == B.SIMPLE:
                take(data, B.vint(data, a, e)[1] + 2, 1)
                self.block(data, a, e, base, None, 0)
            elif kind == B.GROUP:
                inner = {k: (x, y) for k, x, y in B.elements(data, a, e)}
                need(B.BLOCK in inner)
                self.block(data, *inner[B.BLOCK], base, B.REFERENCE not in inner, B._uint(data, *inner[B.BLOCK_TIME]) if B.BLOCK_TIME in inner else 0)

    def whole(self, data: bytes) -> None:
        """All of a source; a cluster that breaks a rule ends the walk as broken, anything else before it ends all."""
        clusters = []
        first, at, end = next(B.elements(data, 0, len(data)))
        need(first == B.EBML)
        self.doctypes += [data[a:e].rstrip(b"\0").decode("latin-1") for k, a, e in B.elements(data, at, end) if k == B.DOCTYPE]
        for kind, a, e in B.elements(data, 0, len(data)):
            if kind == B.SEGMENT:
                self.segments += 1
                for k, x, y in B.elements(data, a, e):
                    if k == B.INFO:
                        self.info(data, x, y)
                    elif k == B.TRACKS:
                        self.tracks(data, x, y)
                    elif k == B.CLUSTER:
                        clusters.append((x, y))
        try:
            for a, e in clusters:
                self.cluster(data, a, e)
        except Bad:
            self.broken = True


def _walked(data: bytes | None, max_bytes: int) -> _Walk:
    found = _Walk()
    if not data or len(data) > max_bytes:
        found.status = S.INVALID
        return found
    try:
        found.whole(data)
    except (Bad, StopIteration):
        found = _Walk()
        found.status = S.UNSUPPORTED
    return found


def _lists(rows: list[list], kind: pa.DataType | list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """A list for each source: of plain values, or of structs made column by column."""
    flat = [r for own in rows for r in own]
    if isinstance(kind, list):
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*flat, strict=True) if flat else [()] * len(kind), kind, strict=True)]
        values = pa.StructArray.from_arrays([c.cast(pa.decimal128(20, 0)) if c.type == _UNSIGNED else c for c in columns], names=[k for k, _ in kind])
    else:
        values = pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def walked(sources: DataFrame, max_bytes: int = S.MAX_SOURCE_BYTES) -> DataFrame:
    """ROWS of all sources, one row each, with empty lists where a source is no such file or breaks off ahead of its clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_walked(data, max_bytes) for data in b.column("content").to_pylist()]
            lists = {k: _lists([getattr(w, k) for w in found], t) for k, t in (("doctypes", pa.string()), ("scales", pa.int64()), ("finite", pa.bool_()), ("entries", _ENTRY), ("blocks", _BLOCK))}
            lists |= {k: pa.array([getattr(w, k) for w in found], t) for k, t in (("status", pa.int32()), ("segments", pa.int32()), ("broken", pa.bool_()))} | {"source_id": b.column("source_id")}
            names = ["source_id", "status", "doctypes", "segments", "scales", "finite", "entries", "blocks", "broken"]
            yield pa.RecordBatch.from_arrays([lists[k] for k in names], names=names)

    return sources.select(F.col("source_id").cast("string").alias("source_id"), "content").mapInArrow(run, ROWS)


def inspected(rows: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """source_id, status, container_id and tracks (array), one row a source; its blocks go along."""
    c = F.col
    role = lambda r: F.when(r == 1, S.VIDEO).when(r == 2, S.AUDIO).when(r == 0x11, S.SUBTITLE).otherwise(S.UNKNOWN_TRACK)
    right = lambda t: (t["value"] > 0) & (t["value"] < 2**32) & F.length(t["text"]).between(1, 31)
    doctype, scale, n = F.get("doctypes", F.lit(0)), F.get("scales", F.lit(0)), F.size("entries")
    named = (F.size("doctypes") == 1) & F.coalesce(doctype.isin("webm", "matroska"), F.lit(False))
    whole = named & (c("segments") == 1) & (F.size("scales") <= 1) & F.coalesce(scale > 0, F.lit(True)) & ~F.array_contains("finite", False) & n.between(1, limits.tracks)
    whole = whole & F.forall("entries", right) & (F.size(F.array_distinct("entries.value")) == n)
    status = F.when(c("status") != S.OK, c("status")).when(whole, S.OK).otherwise(S.UNSUPPORTED)
    container = F.when(named, F.when(doctype == "webm", S.WEBM).otherwise(S.MATROSKA)).otherwise(0)

    def made(t: Column) -> Column:
        return F.struct(t["value"].cast("bigint").alias("track_id"), role(t["role"]).alias("kind"), t["start"].alias("codec_id"), F.coalesce(scale, F.lit(1_000_000)).alias("time_scale"), F.lit(0).cast("decimal(20,0)").alias("duration_ticks"), t["text"].alias("codec_name"))

    return rows.select("source_id", status.alias("status"), container.alias("container_id"), F.when(status == S.OK, F.transform("entries", made)).alias("tracks"), "blocks", "broken")


def tracks(found: DataFrame) -> DataFrame:
    return found.where(F.col("status") == S.OK).select("source_id", "container_id", F.inline("tracks"))


def packets(rows: DataFrame, found: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """PACKETS of the inspected sources (``found``, made of ``rows``) whose blocks all hold."""
    stamp = lambda b: b["base"] + b["relative"]
    laced = lambda b: F.forall(b["sizes"], lambda s: s > 0) & ((F.size(b["sizes"]) == 1) | (b["duration"] == 0))
    good = lambda b: F.array_contains("ids", b["value"]) & b["base"].isNotNull() & (stamp(b) >= 0) & laced(b) & (b["duration"] <= F.lit(2**63 - 1))
    many = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.size(b["sizes"]))
    own = found.where((F.col("status") == S.OK) & ~F.col("broken")).select("source_id", "blocks", F.col("tracks.track_id").alias("ids"))
    whole = own.where((many <= limits.packets) & F.forall("blocks", good))

    def laces(b: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(b["sizes"], F.lit(1), i), F.lit(0).cast("bigint"), lambda a, s: a + s)
        return F.transform(b["sizes"], lambda size, i: F.struct(b.alias("b"), (b["start"] + before(i)).alias("byte_offset"), size.alias("byte_size")))

    each = whole.select("source_id", F.posexplode(F.flatten(F.transform("blocks", laces))).alias("seq", "p"))  # offsets rise along a file
    b = F.col("p.b")
    return each.select(
        "source_id", "seq", "p.byte_offset", "p.byte_size", b["value"].alias("track_id"), stamp(b).cast("decimal(20,0)").alias("timestamp_ticks"), b["duration"].cast("bigint").alias("duration_ticks"),
        F.when(b["is_key"], S.KEYFRAME).otherwise(0).alias("flags"),
    )
