"""Decoded packets to frames of a fixed size, in a stream and in batch.

Packets of a source bring samples of any number; frames have ``frame`` sample frames each.  What does not fill a frame is
pending state of the source.  A source ends when no packet came for ``idle_ms`` of event time: a timer then drains it, which gives
a last frame of what is pending, if any, and one row that says so (``last``, with the number of frames before it), and its state
goes.  Packets that came too early wait for those before them; if these never come, the drain takes what there is and its row has
the status MALFORMED instead of OK.  A packet that was there before is left out.

The result does not depend on how packets fall into micro-batches, and equals that of ``pumped``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import status as S
from ..operators.timeline import running

#: Bytes of a sample frame: two of 16 bits.
WIDTH = 4
#: Packets of a source beyond which ``pumped`` cuts it into pieces: they carry their samples, so far fewer than other rows fill a task.
ROWS = 4096
RESULT = "source_id string, frame_index bigint, n_samples int, samples binary, last boolean, status int"
_COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]


class Pump(StatefulProcessor):
    def __init__(self, frame: int, idle_ms: int, width: int = WIDTH):
        self.size, self.width, self.idle = frame * width, width, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pending binary, due bigint, frames bigint, time bigint")
        self.early = handle.getMapState("early", "seq bigint", "samples binary")

    def _cut(self, key: str, pending: bytes, frames: int) -> tuple[list[tuple], bytes, int]:
        whole = len(pending) // self.size
        rows = [(key, frames + k, self.size // self.width, pending[k * self.size : (k + 1) * self.size], False, S.OK) for k in range(whole)]
        return rows, pending[whole * self.size :], frames + whole

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, due, frames, time = self.state.get() if self.state.exists() else (b"", 0, 0, 0)
        pending = bytes(pending)
        for part in rows:
            for seq, samples, at in zip(part["seq"], part["samples"], part["time"], strict=True):
                time = max(time, int(at.timestamp() * 1000))
                if seq >= due and not self.early.containsKey((int(seq),)):
                    self.early.updateValue((int(seq),), (bytes(samples),))
        out: list[tuple] = []
        while self.early.containsKey((due,)):
            pending += bytes(self.early.getValue((due,))[0])
            self.early.removeKey((due,))
            due += 1
            made, pending, frames = self._cut(key[0], pending, frames)
            out += made
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(time + self.idle)
        self.state.update((pending, due, frames, time))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, _, frames, _ = self.state.get()
        left = sorted((int(k[0]), bytes(v[0])) for k, v in self.early.iterator())
        out, pending, frames = self._cut(key[0], bytes(pending) + b"".join(v for _, v in left), frames)
        if pending:
            out.append((key[0], frames, len(pending) // self.width, pending, False, S.OK))
            frames += 1
        out.append((key[0], frames, 0, None, True, S.MALFORMED if left else S.OK))
        self.early.clear()
        self.state.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def pump(packets: DataFrame, frame: int, idle_ms: int, late: str = "0 seconds", width: int = WIDTH) -> DataFrame:
    """RESULT for a stream of (source_id string, seq bigint, samples binary, time timestamp); needs the RocksDB state store."""
    own = packets.select("source_id", "seq", "samples", "time").withWatermark("time", late)
    return own.groupBy("source_id").transformWithStateInPandas(Pump(frame, idle_ms, width), RESULT, "Append", "EventTime")


def pumped(packets: DataFrame, frame: int, width: int = WIDTH, **options: Any) -> DataFrame:
    """RESULT for packets at rest: the place of each packet's samples is a running sum, and frames gather what overlaps them.

    A frame has ``frame`` sample frames at most, so a group is bounded; a source is in as many groups as it has frames.
    """
    options = {"least": ROWS} | options
    n = F.call_function("div", F.octet_length("samples"), F.lit(width)).cast("bigint")
    own = packets.select("source_id", "seq", "samples").dropDuplicates(["source_id", "seq"])
    placed = running(own, "source_id", ["seq"], {"at": n}, **options).withColumn("n", n)
    touched = placed.where("n > 0").withColumn("frame_index", F.explode(F.sequence(F.call_function("div", F.col("at"), F.lit(frame)), F.call_function("div", F.col("at") + F.col("n") - 1, F.lit(frame)))))
    low = F.greatest(F.col("frame_index") * frame - F.col("at"), F.lit(0))
    high = F.least((F.col("frame_index") + 1) * frame - F.col("at"), F.col("n"))
    parts = touched.select("source_id", "frame_index", "at", F.hex(F.substring("samples", (low * width + 1).cast("int"), ((high - low) * width).cast("int"))).alias("part"))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), ""))
    frames = parts.groupBy("source_id", "frame_index").agg(joined.alias("samples"))
    shown = frames.select("source_id", "frame_index", F.call_function("div", F.octet_length("samples"), F.lit(width)).cast("int").alias("n_samples"), "samples", F.lit(False).alias("last"), F.lit(S.OK).alias("status"))
    totals = placed.groupBy("source_id").agg(F.sum("n").alias("n"), (F.max("seq") + 1 - F.count("*")).alias("missing"))
    ends = totals.select("source_id", F.ceil(F.col("n") / frame).cast("bigint").alias("frame_index"), F.lit(0).alias("n_samples"), F.lit(None).cast("binary").alias("samples"), F.lit(True).alias("last"), F.when(F.col("missing") > 0, S.MALFORMED).otherwise(S.OK).alias("status"))
    return shown.unionByName(ends)
