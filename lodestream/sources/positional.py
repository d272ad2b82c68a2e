"""Packets read from files by position: only the bytes that packets name cross from the store to a task.

Packets are dealt by file and span of SPAN bytes, so a large file is read by many tasks at once, each
from its own part; within a task they are read in the order of their offsets.  Neighbours closer than
GAP are one extent, and a request to the store asks for at most CHUNK bytes.

A packet has the status ``OK`` and its payload, or no payload and ``INVALID`` (no size or offset,
a size of 0 or over the maximum, an extent beyond 64 bits), ``SOURCE_FAILED`` (the file cannot be opened or a read fails),
``SOURCE_STALLED`` (the file ends before the packet does) or ``CANCELLED``.  ``fetched`` counts the bytes asked of and given by the
store for the extent that begins with the packet, so its sum is what was read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import status as S
from . import store

CHUNK = 64 * 1024
GAP = 4096
#: Bytes of a file that are one task's part.
SPAN = 64 * 1024 * 1024
#: Bytes of payloads in one batch of rows.
BATCH = 32 * 1024 * 1024


class Source:
    """One open file; ``take`` reads an extent in bounded requests and says how it ended."""

    def __init__(self, path: str, opener: Callable[[str], Any], cancelled: Callable[[], bool] | None):
        self.cancelled, self.file, self.failed = cancelled, None, False
        try:
            self.file = opener(path)
        except Exception:  # noqa: BLE001 - whatever a store raises is the status of its packets
            self.failed = True

    def take(self, offset: int, size: int) -> tuple[int, bytes]:
        if self.failed:
            return S.SOURCE_FAILED, b""
        parts, have = [], 0
        while have < size:
            if self.cancelled is not None and self.cancelled():
                return S.CANCELLED, b""
            ask = min(CHUNK, size - have)
            try:
                self.file.seek(offset + have)
                got = self.file.read(ask)
            except Exception:  # noqa: BLE001
                return S.SOURCE_FAILED, b"".join(parts)
            if len(got) > ask:
                return S.INVALID, b""
            if not got:
                return S.SOURCE_STALLED, b"".join(parts)
            parts.append(got)
            have += len(got)
        return S.OK, b"".join(parts)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def extents(packets: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, size, which packets) of runs of packets (offset, size), given in the order of their offsets."""
    start = end = 0
    run: list[int] = []
    for k, (offset, size) in enumerate(packets):
        if run and (offset - end > GAP or max(end, offset + size) - start > max(CHUNK, end - start)):
            yield start, end - start, run
            run = []
        if not run:
            start = end = offset
        run.append(k)
        end = max(end, offset + size)
    if run:
        yield start, end - start, run


def read_packets(packets: DataFrame, max_bytes: int = S.MAX_PACKET_BYTES, span: int = SPAN, source: str = "source_id", opener: Callable[[str], Any] = store.opened, cancelled: Callable[[], bool] | None = None, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """``packets`` (a path in ``source``, byte_offset, byte_size, ...) with packet_status, fetched and payload.

    One row a packet, whatever becomes of it.  ``cancelled`` is asked before each request, in the task.  ``then`` makes other
    rows, of ``schema``, of each batch while the payloads are there, so that they need not leave the task.
    """
    names = packets.columns
    last = 2**63 - 1  # offsets are signed here; files cannot be longer

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in given(batches):
            yield got if then is None else then(got)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None

        def batch(b: pa.RecordBatch, rows: list[int], found: dict[int, tuple[int, int, bytes | None]]) -> pa.RecordBatch:
            part = b.take(pa.array(rows))
            got = [found[k] for k in rows]
            more = [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())]
            return pa.RecordBatch.from_arrays([*part.columns, *more], names=[*b.schema.names, "packet_status", "fetched", "payload"])

        try:
            for b in batches:
                paths, offsets, sizes = (b.column(c).to_pylist() for c in (source, "byte_offset", "byte_size"))
                found: dict[int, tuple[int, int, bytes | None]] = {}
                rows: list[int] = []
                held = k = 0
                while k < b.num_rows:
                    until = k
                    while until < b.num_rows and paths[until] == paths[k]:
                        until += 1
                    good = []
                    for i in range(k, until):
                        o, n = offsets[i], sizes[i]
                        if paths[i] is None or o is None or n is None or not 0 < n <= max_bytes or not 0 <= o <= last - n:
                            found[i] = S.INVALID, 0, None
                            rows.append(i)
                        else:
                            good.append(i)
                    if good and paths[k] != now:
                        if file is not None:
                            file.close()
                        now, file = paths[k], Source(paths[k], opener, cancelled)
                    for at, size, which in extents([(int(offsets[i]), int(sizes[i])) for i in good]):
                        status, data = file.take(at, size)
                        for j, w in enumerate(which):
                            i = good[w]
                            low = int(offsets[i]) - at
                            whole = low + int(sizes[i]) <= len(data)
                            found[i] = (S.OK if whole else status), len(data) if not j else 0, data[low : low + int(sizes[i])] if whole else None
                            rows.append(i)
                        held += len(data)
                        if held > BATCH:
                            yield batch(b, rows, found)
                            rows, held = [], 0
                    k = until
                if rows:
                    yield batch(b, rows, found)
        finally:
            if file is not None:
                file.close()

    part = F.call_function("div", F.col("byte_offset").cast("bigint"), F.lit(span))
    dealt = packets.withColumn("_part", part).repartition(F.col(source), F.col("_part")).sortWithinPartitions(source, "byte_offset").drop("_part")
    kept = ", ".join(f"`{n}` {packets.schema[n].dataType.simpleString()}" for n in names)
    return dealt.mapInArrow(read, schema or f"{kept}, packet_status int, fetched bigint, payload binary")
