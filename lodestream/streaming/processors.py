"""Playback state machines over streams: keyed state, one key's events in order of arrival.

The generation is the only notion of lateness here, and it is compared with the state itself, so
no watermark is set.  The state of a key is one row of bigints.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MachineProcessor(StatefulProcessor):
    """Runs a machine of ``operators.machines`` on each key."""

    def __init__(self, machine: Any, key: str, seq: str):
        self.machine, self.key, self.seq = machine, key, seq
        self.fields = list(machine.START)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"`{f}` bigint" for f in self.fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = dict(zip(self.fields, self.state.get(), strict=True)) if self.state.exists() else dict(self.machine.START)
        names = [r.split(" ")[0] for r in self.machine.RESULT.split(", ")]
        events = pd.concat(list(rows)).sort_values(self.seq, kind="stable").to_dict("records")  # one micro-batch of one key
        out = [(key[0], e[self.seq], *self.machine.step(state, e)) for e in events]
        self.state.update(tuple(int(state[f]) for f in self.fields))
        yield pd.DataFrame(out, columns=[self.key, self.seq, *names])

    def close(self) -> None:
        pass


def run_machine(events: DataFrame, machine: Any, key: str = "session", seq: str = "seq") -> DataFrame:
    """The streaming twin of ``operators.replay.replay``."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, {machine.RESULT}"
    return events.groupBy(key).transformWithStateInPandas(MachineProcessor(machine, key, seq), schema, "Update", "none")


def reconcile(decisions: DataFrame, act: Any, checkpoint: str) -> Any:
    """Hand each micro-batch to ``act(batch_frame, batch_id)``, which must be idempotent by batch id."""
    return decisions.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode("update").start()
