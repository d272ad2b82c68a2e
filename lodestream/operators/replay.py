"""Batch replay of ordered events through a state machine, one key after the other.

Events are hash-partitioned by the key and sorted within partitions; a task streams its rows and
holds one key's state, so memory does not grow with the length of a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def replay(events: DataFrame, machine: object, key: str, order: list[str]) -> DataFrame:
    """The key and order columns of every event with the machine's results."""
    names = [*([key] if key not in order else []), *order]
    kept = ", ".join(f"`{n}` {events.schema[n].dataType.simpleString()}" for n in names)
    results = [r.split(" ")[0] for r in machine.RESULT.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    types = [kinds[r.split(" ")[1]] for r in machine.RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for b in batches:
            rows = b.to_pylist()
            out = []
            for e in rows:
                if e[key] != now:
                    now, state = e[key], dict(machine.START)
                out.append(machine.step(state, e))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *columns], names=[*names, *results])

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kept}, {machine.RESULT}")
