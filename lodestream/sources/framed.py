"""ADTS and Ogg sources as relations: a small walk per source yields frames or pages, Spark does the rest.

Constant formats, sequence numbers, checksums, headers, granules, running timestamps and statuses are windows and conditions over the
rows of frames and pages.  A source is one value of at most ``max_bytes`` here, which bounds its windows; longer files
go through ``longstreams``, whose frames and pages have the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import status as S
from ..functions.scalars import read_be, read_le
from . import longstreams
from .bits import Bad
from .streams import AAC_RATES, HEAD_BYTES, OPUS_RATE, opus_duration


@dataclass(frozen=True)
class OggPackets(longstreams.Ogg):
    """Pages with what their packets begin with, and the ticks of each as an Opus packet (-1: it is none)."""

    fields: str = longstreams.OGG_PAGES.fields + ", heads array<binary>, sizes array<int>, ticks array<int>, open boolean"

    def record(self, data: bytes, at: int, size: int) -> tuple:
        page = super().record(data, at, size)
        lacing = page[-1]
        low, n, heads, sizes, ticks = at + 27 + len(lacing), 0, [], [], []
        for s in lacing:
            n += s
            if s < 255:
                packet = bytes(data[low : low + n])
                heads.append(packet[: HEAD_BYTES if packet[:4] == b"Opus" else 32])
                sizes.append(n)
                try:
                    ticks.append(opus_duration(packet))
                except Bad:
                    ticks.append(-1)
                low, n = low + n, 0
        return *page, heads, sizes, ticks, bool(lacing) and lacing[-1] == 255


OGG = OggPackets()
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}


def walked(sources: DataFrame, form: longstreams.Adts | longstreams.Ogg, max_bytes: int = S.MAX_SOURCE_BYTES) -> DataFrame:
    """(source_id, status, seq, byte_offset, byte_size, the form's fields): the records of a source, or one row with its status if they do not lead from its first byte to its last."""
    fields = [f.split(" ", 1) for f in form.fields.split(", ")]
    names = ["source_id", "status", "seq", "byte_offset", "byte_size", *(f[0] for f in fields)]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *(_KINDS[f[1]] for f in fields)]

    def rows(ident: str, data: bytes | None) -> list[tuple]:
        bad = lambda code: [(ident, code, *[None] * (len(names) - 2))]
        if not data or len(data) > max_bytes:
            return bad(S.INVALID)
        places, sizes = form.places(data)
        step, at, out = dict(zip(places.tolist(), sizes.tolist(), strict=True)), 0, []
        while at < len(data):
            size = step.get(at)
            if size is None or at + size > len(data):
                return bad(S.UNSUPPORTED)
            out.append((ident, S.OK, len(out), at, size, *form.record(data, at, size)))
            at += size
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for ident, data in zip(b.column("source_id").to_pylist(), b.column("content").to_pylist(), strict=True) for r in rows(ident, data)]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = f"source_id string, status int, seq bigint, byte_offset bigint, byte_size bigint, {form.fields}"
    return sources.select(F.col("source_id").cast("string").alias("source_id"), "content").mapInArrow(run, schema)


def _source() -> WindowSpec:
    return Window.partitionBy("source_id")


def _same(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.min(c).over(_source()) == F.max(c).over(_source())
    return out


def _before(value: Column, order: list[str]) -> Column:
    return F.coalesce(F.sum(value).over(_source().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def adts(frames: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """``walked`` frames with ``index_status``, timestamp_ticks, duration_ticks and rate_hz; a source's frames have one format, and are as many as allowed."""
    n = F.count("*").over(_source())
    right = (F.col("status") == S.OK) & _same("profile", "rate", "channels") & (n <= limits.packets) & (n <= limits.frames)
    code = F.when(F.col("status") != S.OK, F.col("status")).when(right, S.OK).otherwise(S.UNSUPPORTED)
    ticks = F.col("blocks").cast("bigint") * 1024
    hz = F.element_at(F.array(*(F.lit(r) for r in AAC_RATES)), F.col("rate") + 1)
    return frames.withColumns({"index_status": code, "timestamp_ticks": _before(ticks, ["seq"]), "duration_ticks": ticks, "rate_hz": hz})


def _unsigned(c: Column) -> Column:
    return F.when(c < 0, c.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)"))


def ogg(pages: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """Packets of ``walked`` pages, headers included, with ``index_status`` and, of audio packets (``audio``), timestamps and durations.

    (source_id, index_status, codec, rate_hz, n, page, audio, byte_offset, byte_size, timestamp_ticks, duration_ticks); a source without packets has one row.
    """
    c = F.col
    step = c("sequence") - c("seq")
    first = _source().orderBy("seq")
    sound = (c("status") == S.OK) & c("crc_ok") & ~c("open") & (c("page_flags").bitwiseAND(1) == 0)
    framed = (F.min(F.coalesce(sound, F.lit(False)).cast("int")).over(_source()) == 1) & (F.min("serial").over(_source()) == F.max("serial").over(_source())) & (F.min(step).over(_source()) == F.max(step).over(_source()))
    framed &= (F.first("page_flags").over(first).bitwiseAND(2) != 0) & (F.first(F.size("sizes")).over(first) > 0) & (F.count("*").over(_source()) <= limits.pages)
    granule = F.when(c("granule") != -1, _unsigned(c("granule")))
    last = F.coalesce(F.last(granule, ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0).cast("decimal(20,0)"))
    marked = pages.select("source_id", "status", "seq", "byte_offset", "lacing", "sizes", F.coalesce(framed, F.lit(False)).alias("framed"), granule.alias("granule"), last.alias("last_granule"), F.arrays_zip("heads", F.col("sizes").alias("size"), "ticks").alias("packets"))
    rows = marked.select("*", F.posexplode_outer("packets").alias("place", "p"))
    ahead = F.coalesce(F.aggregate(F.slice("sizes", F.lit(1), F.coalesce("place", F.lit(0))), F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0))
    flat = rows.select("source_id", "status", "framed", "granule", "last_granule", c("seq").alias("page"), "place", (c("byte_offset") + 27 + F.octet_length("lacing") + ahead).alias("byte_offset"), c("p.size").alias("byte_size"), c("p.heads").alias("head"), c("p.ticks").alias("ticks"))
    flat = flat.where(c("place").isNotNull() | (c("page").isNull() | (c("page") == 0)))  # pages without packets drop out, but each source keeps a row
    order = ["page", "place"]
    flat = flat.withColumn("n", _before(c("place").isNotNull().cast("int"), order).cast("int"))
    along = _source().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.first(F.when(c("n") == k, c("head")), ignorenulls=True).over(along)
    flat = flat.withColumns({"h0": at(0), "h1": at(1), "h2": at(2), "size0": F.first(F.when(c("n") == 0, c("byte_size")), ignorenulls=True).over(along), "header_page": F.max(F.when(c("n") < 3, c("page"))).over(_source())})
    h, size = c("h0"), c("size0")
    byte = lambda k: read_be(h, F.lit(k), 1)
    starts = lambda col, b: F.coalesce(F.substring(c(col), 1, len(b)) == F.lit(b), F.lit(False))
    family = byte(18)
    opus = starts("h0", b"OpusHead") & (size >= 19) & (size <= HEAD_BYTES) & (byte(8).bitwiseAND(0xF0) == 0) & (byte(9) > 0) & ((family > 0) | (byte(9) <= 2))
    opus &= (family == 0) | ((size >= 21 + byte(9)) & (byte(19) > 0) & (byte(19) <= byte(9)) & (byte(20) <= byte(19)))
    opus = F.coalesce(opus, F.lit(False))
    blocks = byte(28)
    vorbis = starts("h0", b"\x01vorbis") & (size >= 30) & (size <= HEAD_BYTES) & (read_le(h, 7, 4) == 0) & byte(11).between(1, 32) & read_le(h, 12, 4).between(1, 384_000) & (byte(29).bitwiseAND(1) == 1)
    vorbis &= (blocks.bitwiseAND(15) >= 4) & (blocks.bitwiseAND(15) <= F.call_function("shiftright", blocks.cast("int"), F.lit(4))) & (F.call_function("shiftright", blocks.cast("int"), F.lit(4)) <= 13)
    vorbis = F.coalesce(vorbis, F.lit(False))
    flat = flat.withColumns({"codec": F.when(opus, "opus").when(vorbis, "vorbis"), "rate_hz": F.when(opus, F.lit(OPUS_RATE).cast("bigint")).when(vorbis, read_le(h, 12, 4))})
    audio = c("place").isNotNull() & (c("n") >= F.when(c("codec") == "opus", 2).otherwise(3))
    flat = flat.withColumn("audio", F.coalesce(audio, F.lit(False)))
    ends = F.lag(F.when(c("audio"), c("granule"))).over(_source().orderBy(*order))
    opus_time, vorbis_time = _before(F.when(c("audio"), c("ticks")), order).cast("decimal(20,0)"), F.coalesce(ends, F.lit(0).cast("decimal(20,0)"))
    alone = F.count(F.when(c("audio"), 1)).over(Window.partitionBy("source_id", "page")) == 1
    flat = flat.withColumns({"timestamp_ticks": F.when(c("codec") == "opus", opus_time).otherwise(vorbis_time), "alone": alone})
    flat = flat.withColumn("duration_ticks", F.when(c("codec") == "opus", c("ticks").cast("decimal(20,0)")).otherwise(c("granule") - c("timestamp_ticks")))
    good_opus = c("ticks") >= 0
    good_vorbis = c("alone") & (c("page") > c("header_page")) & (c("byte_size") > 0) & (read_be(c("head"), F.lit(0), 1).bitwiseAND(1) == 0) & c("granule").isNotNull() & (c("duration_ticks") >= 0)
    each = F.when(~c("audio"), F.lit(True)).when(c("codec") == "opus", good_opus).otherwise(good_vorbis)
    n_audio = F.sum(c("audio").cast("int")).over(_source())
    whole = F.when(c("codec") == "opus", starts("h1", b"OpusTags")).when(c("codec") == "vorbis", starts("h1", b"\x03vorbis") & starts("h2", b"\x05vorbis") & (F.max(F.when(c("audio"), c("granule"))).over(_source()) == c("last_granule")))
    right = c("framed") & F.coalesce(whole, F.lit(False)) & (F.min(F.coalesce(each, F.lit(False)).cast("int")).over(_source()) == 1) & n_audio.between(1, limits.packets)
    code = F.when(c("status") != S.OK, c("status")).when(F.coalesce(right, F.lit(False)), S.OK).otherwise(S.UNSUPPORTED)
    return flat.select("source_id", code.alias("index_status"), "codec", "rate_hz", "n", "page", "audio", "byte_offset", "byte_size", "timestamp_ticks", "duration_ticks")


def packets(found: DataFrame) -> DataFrame:
    """PACKETS of ``adts`` or ``ogg``."""
    audio = found.where((F.col("index_status") == S.OK) & (F.col("audio") if "audio" in found.columns else F.lit(True)))
    seq = F.row_number().over(_source().orderBy("byte_offset")) - 1
    return audio.select("source_id", seq.alias("seq"), "byte_offset", F.col("byte_size").cast("bigint").alias("byte_size"), F.lit(1).cast("bigint").alias("track_id"), F.col("timestamp_ticks").cast("decimal(20,0)").alias("timestamp_ticks"), F.col("duration_ticks").cast("bigint").alias("duration_ticks"), F.lit(S.KEYFRAME).alias("flags"))


def statuses(found: DataFrame) -> DataFrame:
    """(source_id, stage, code, n_packets), one row a source."""
    audio = F.col("audio") if "audio" in found.columns else F.lit(True)
    n = F.sum(F.when((F.col("index_status") == S.OK) & audio, 1).otherwise(0))
    return found.groupBy("source_id").agg(F.first("index_status").alias("code"), n.alias("n_packets")).select("source_id", F.lit("index").alias("stage"), "code", "n_packets")
