"""Streams of frames or pages far larger than a task: indexed by pieces (``operators.chains``) that are read by position.

No file is read whole by any task, and there is no limit on records but the one a caller sets.  A source is right if its
chain of records leads from its first byte to its last; else it has no rows but its status.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import status as S
from ..functions.checksums import OGG
from ..operators import chains
from ..operators.timeline import running
from . import positional, store

#: Bytes of a file that one walk covers, beside what a record may reach beyond.
PIECE = 1 << 20


@dataclass(frozen=True)
class Adts:
    """AAC frames with their own headers."""

    ahead: int = 8191 + 7
    fields: str = "profile int, rate int, channels int, blocks int"

    def places(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where a record could begin, and its size there."""
        b = np.frombuffer(data, np.uint8).astype(np.int64)
        if len(b) < 7:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((b[:-6] == 0xFF) & (b[1:-5] & 0xF6 == 0xF0))
        size = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5
        good = ((b[at + 2] >> 2 & 15) < 13) & (size >= np.where(b[at + 1] & 1, 7, 9))
        return at[good], size[good]

    def record(self, data: bytes, at: int, size: int) -> tuple:
        b2, b3, b6 = data[at + 2], data[at + 3], data[at + 6]
        return b2 >> 6, b2 >> 2 & 15, (b2 & 1) << 2 | b3 >> 6, (b6 & 3) + 1


@dataclass(frozen=True)
class Ogg:
    """Pages; their checksums are verified where the page is read."""

    ahead: int = 27 + 255 + 255 * 255
    fields: str = "page_flags int, granule bigint, serial bigint, sequence bigint, crc_ok boolean, lacing binary"

    def places(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, found = data.find(b"OggS\0"), []
        while at >= 0:
            if at + 27 <= len(data) and at + 27 + data[at + 26] <= len(data):
                n = data[at + 26]
                found.append((at, 27 + n + sum(data[at + 27 : at + 27 + n])))
            at = data.find(b"OggS\0", at + 1)
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def record(self, data: bytes, at: int, size: int) -> tuple:
        page = data[at : at + size]
        field = lambda low, n, sign=False: int.from_bytes(page[low : low + n], "little", signed=sign)
        right = OGG.of(page[:22] + b"\0\0\0\0" + page[26:]) == field(22, 4)
        return page[5], field(6, 8, True), field(14, 4), field(18, 4), right, page[27 : 27 + page[26]]


ADTS, OGG_PAGES = Adts(), Ogg()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, n_bytes) of the files of a folder, empty ones included (Spark's own file sources leave those out)."""
    return spark.createDataFrame([(f.path, f.size) for f in store.listed(path)], "source_id string, n_bytes bigint")


def pieces(spark: SparkSession, path: str, form: Adts | Ogg, piece: int = PIECE) -> DataFrame:
    """(source_id, n_bytes, piece, byte_offset, byte_size): planned from the lengths of the files alone."""
    cut = listing(spark, path).where("n_bytes > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("n_bytes") - 1, F.lit(piece)))).alias("piece"))
    begin = F.col("piece") * piece
    return cut.select("*", begin.alias("byte_offset"), F.least(F.col("n_bytes") - begin, F.lit(piece + form.ahead)).alias("byte_size"))


def _next(form: Adts | Ogg, data: bytes, base: int, end: int, n_bytes: int) -> dict[int, int]:
    """From each place in the piece (absolute) to where the record there ends; records beyond the end of the file are none."""
    at, size = form.places(data)
    at = at + base
    good = (at < end) & (at + size <= n_bytes)
    return dict(zip(at[good].tolist(), (at + size)[good].tolist(), strict=True))


def links(cut: DataFrame, form: Adts | Ogg, piece: int = PIECE) -> DataFrame:
    """(source_id, entry, exit, n): walks through each piece from every place at which one could enter it."""
    schema = "source_id string, entry bigint, exit bigint, n bigint"

    def walk(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for source, n_bytes, base, data in zip(*(b.column(c).to_pylist() for c in ("source_id", "n_bytes", "byte_offset", "payload")), strict=True):
            if data is None:
                continue
            end = min(base + piece, n_bytes)
            step = _next(form, data, base, end, n_bytes)
            done: dict[int, tuple[int, int]] = {}
            for at in sorted(step, reverse=True):
                to = step[at]
                if to >= end:
                    done[at] = to, 1
                elif to in done:
                    done[at] = done[to][0], done[to][1] + 1
            out += [(source, at, to, n) for at, (to, n) in done.items() if (at < base + form.ahead if base else at == 0)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["source_id", "entry", "exit", "n"])

    return positional.read_packets(cut, piece + form.ahead, then=walk, schema=schema)


def records(spark: SparkSession, path: str, form: Adts | Ogg, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(source_id, seq, byte_offset, byte_size, the form's fields) of the sources whose chain is whole, and (source_id, whole) of all."""
    cut = pieces(spark, path, form, piece)
    reached = chains.ranked(links(cut, form, piece), "source_id", "entry", "exit", "n")
    files = listing(spark, path)
    last = reached.groupBy("source_id").agg(F.max("entry").alias("last"))
    whole = files.join(last, "source_id", "left").select("source_id", F.coalesce((F.col("last") == F.col("n_bytes")) & (F.col("n_bytes") > 0), F.lit(False)).alias("whole"))
    entries = reached.join(whole.where("whole"), "source_id").select("source_id", F.call_function("div", F.col("entry"), F.lit(piece)).alias("piece"), "entry", "rank")
    names = [f.split(" ")[0] for f in form.fields.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *(kinds[f.split(" ")[1]] for f in form.fields.split(", "))]

    def expand(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for source, n_bytes, base, entry, rank, data in zip(*(b.column(c).to_pylist() for c in ("source_id", "n_bytes", "byte_offset", "entry", "rank", "payload")), strict=True):
            if data is None:
                continue
            end = min(base + piece, n_bytes)
            step, at = _next(form, data, base, end, n_bytes), entry
            while at < end:
                to = step[at]
                out.append((source, rank, at, to - at, *form.record(data, at - base, to - at)))
                at, rank = to, rank + 1
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source_id", "seq", "byte_offset", "byte_size", *names])

    schema = f"source_id string, seq bigint, byte_offset bigint, byte_size bigint, {form.fields}"
    return positional.read_packets(cut.join(entries, ["source_id", "piece"]), piece + form.ahead, then=expand, schema=schema), whole


def _codes(whole: DataFrame, right: DataFrame) -> DataFrame:
    """STATUS of the index: of whole sources those that are ``right`` as well."""
    found = whole.join(right, "source_id", "left")
    code = F.when(F.col("whole") & F.coalesce("right", F.lit(False)), S.OK).otherwise(S.UNSUPPORTED)
    return found.select("source_id", F.lit("index").alias("stage"), code.alias("code"))


def adts_index(spark: SparkSession, path: str, piece: int = PIECE, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_id, seq, byte_offset, byte_size, timestamp_ticks, duration_ticks) of the ADTS files of a folder, and their statuses.

    All frames of a source have one profile, rate and number of channels; ``most``: frames a source at most.
    """
    found, whole = records(spark, path, ADTS, piece)
    kept = found.checkpoint()  # it is read twice, and the files need not be
    same = [F.min(c) == F.max(c) for c in ("profile", "rate", "channels")]
    right = kept.groupBy("source_id").agg((same[0] & same[1] & same[2] & (F.count("*") <= most if most else F.lit(True))).alias("right"))
    good = kept.join(right.where("right").select("source_id"), "source_id").withColumn("duration_ticks", F.col("blocks").cast("bigint") * 1024)
    timed = running(good, "source_id", ["seq"], {"timestamp_ticks": F.col("duration_ticks")})
    return timed.select("source_id", "seq", "byte_offset", "byte_size", "timestamp_ticks", "duration_ticks"), _codes(whole, right)


def ogg_page_index(spark: SparkSession, path: str, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The pages of the Ogg files of a folder, and their statuses: checksums right, one serial number, sequence without a gap, a first page that begins a stream."""
    found, whole = records(spark, path, OGG_PAGES, piece)
    kept = found.checkpoint()
    step = F.col("sequence") - F.col("seq")
    right = kept.groupBy("source_id").agg((F.min("crc_ok") & (F.min("serial") == F.max("serial")) & (F.min(step) == F.max(step)) & F.max((F.col("seq") == 0) & (F.col("page_flags").bitwiseAND(2) != 0))).alias("right"))
    return kept.join(right.where("right").select("source_id"), "source_id"), _codes(whole, right)
