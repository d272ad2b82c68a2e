"""Media as Spark data sources, in batch and as a stream, and sinks that commit.

``spark.read.format("media").load(folder)`` has the relations ``packets`` (the default), ``tracks``, ``status`` and
``track_packets`` (packets with the kind and codec of their track).  Comparisons of single columns with constants are
pushed into the reader: those on ``source_id`` leave files out before any is opened, the others leave out rows before
they leave the reader, so a track or kind that is not asked for costs nothing beyond its index.

``spark.readStream.format("media")`` has the same rows.  An offset is the last file that is whole behind it, and the number
of packets behind it in the next file.  Files are taken in the order of their paths or, with ``order=time``, of their
last change; a file must not come later in that order than it appears, and must not change.

``format("media_files")`` writes rows (source_id, content) as files, ``format("media_rows")`` any rows as Parquet files.  A task
writes into a folder of its own under ``_staging``; the commit moves the folders of the tasks that succeeded, one move a task, and
removes the others, so a task that failed or ran twice leaves nothing.  A batch of a stream that was committed before is left as it is.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .. import schemas
from .. import status as S
from . import store
from .media import index, inspect

TRACK_PACKETS = schemas.PACKETS + ", kind int, codec_id bigint"
RELATIONS = {"packets": schemas.PACKETS, "tracks": schemas.TRACKS, "status": schemas.STATUS, "track_packets": TRACK_PACKETS}
#: Bytes of files in one task, beside ``filesPerPartition``.
PARTITION_BYTES = 128 * 1024 * 1024

Test = Callable[[Any], bool]


def test_of(f: D.Filter) -> tuple[str, Test] | None:
    """The column a filter is about and what it says of a value; None if it is not of a kind that is known here."""
    if isinstance(f, D.Not):
        inner = test_of(f.child)
        # of a null, a comparison and its negation are both not true
        return None if inner is None or isinstance(f.child, (D.IsNull, D.IsNotNull, D.EqualNullSafe)) else (inner[0], lambda v: v is not None and not inner[1](v))
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    column = f.attribute[0]
    if isinstance(f, D.IsNull):
        return column, lambda v: v is None
    if isinstance(f, D.IsNotNull):
        return column, lambda v: v is not None
    value = f.value
    if isinstance(f, D.EqualNullSafe):
        return column, lambda v: v == value
    if isinstance(f, D.In):
        return column, lambda v: v is not None and v in value
    if value is None:
        return column, lambda v: False
    kinds: list[tuple[type, Callable[[Any], bool]]] = [
        (D.EqualTo, lambda v: v == value),
        (D.GreaterThanOrEqual, lambda v: v >= value),
        (D.GreaterThan, lambda v: v > value),
        (D.LessThanOrEqual, lambda v: v <= value),
        (D.LessThan, lambda v: v < value),
        (D.StringStartsWith, lambda v: v.startswith(value)),
        (D.StringEndsWith, lambda v: v.endswith(value)),
        (D.StringContains, lambda v: value in v),
    ]
    for kind, said in kinds:
        if isinstance(f, kind):
            return column, lambda v: v is not None and said(v)
    return None


class FilePartition(D.InputPartition):
    """Files, each with the packets to leave out at its start and the one to stop before (None: all)."""

    def __init__(self, files: list[tuple[str, int, int, int | None]]):
        self.files = files  # path, size, from, to


def partitioned(files: list[tuple[str, int, int, int | None]], at_once: int) -> list[FilePartition]:
    parts: list[list[tuple[str, int, int, int | None]]] = []
    held = 0
    for f in files:
        if not parts or len(parts[-1]) >= at_once or held + f[1] > PARTITION_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(f)
        held += f[1]
    return [FilePartition(p) for p in parts]


class Files:
    """What batch and stream readers share: options, one file's rows, and the tests on them.

    Options: relation, filesPerPartition, maxBytes (larger files are not read and have the status of an invalid
    source), framesPerPacket, maxPackets and maxTracks (a source of more has none).
    """

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.relation, self.at_once = options["path"], options.get("relation", "packets"), int(options.get("filesperpartition", 64))
        if self.relation not in RELATIONS:
            raise ValueError(f"unknown relation {self.relation}")
        self.max_bytes, self.frames = int(options.get("maxbytes", S.MAX_SOURCE_BYTES)), int(options.get("framesperpacket", 1))
        self.limits = S.Limits(packets=int(options.get("maxpackets", S.MAX_PACKETS)), tracks=int(options.get("maxtracks", S.MAX_TRACKS)))
        self.columns = [p.split(" ")[0] for p in RELATIONS[self.relation].replace("(20,0)", "").split(", ")]
        self.tests: list[tuple[int, Test]] = []
        self.file_tests: list[Test] = []

    def push(self, f: D.Filter) -> bool:
        """Whether the filter is taken over whole."""
        said = test_of(f)
        if said is None or said[0] not in self.columns:
            return False
        if said[0] == "source_id":
            self.file_tests.append(said[1])
        else:
            self.tests.append((self.columns.index(said[0]), said[1]))
        return True

    def wanted(self, path: str) -> bool:
        return all(t(path) for t in self.file_tests)

    def rows(self, path: str, size: int, chosen: bool = False) -> list[tuple]:
        """All rows of a file; ``chosen``: none if the tests leave none of its tracks, whose packets are not walked then."""
        status, container, tracks, packets = S.INVALID, 0, [], []
        if size <= self.max_bytes:
            with store.opened(path) as f:
                data = f.read()
            if chosen and not self.asked(data):
                return []
            status, container, tracks, packets = index(data, self.max_bytes, self.frames, self.limits)
        if self.relation == "status":
            return [(path, "index", status)]
        if self.relation == "tracks":
            return [(path, container, *t[:4], Decimal(t[4]), t[5]) for t in tracks]
        of = {t[0]: (t[1], t[2]) for t in tracks} if self.relation == "track_packets" else {}
        return [(path, k, p[0], p[1], p[2], Decimal(p[3]), p[4], p[5], *of.get(p[2], ())) for k, p in enumerate(packets)]

    def asked(self, data: bytes) -> bool:
        """Whether some track of a file passes the tests on its number, kind and codec; if none does, its packets have no rows."""
        places = {self.columns.index(c): k for k, c in enumerate(("track_id", "kind", "codec_id"))}
        tests = [(places[at], t) for at, t in self.tests if at in places]
        return not tests or any(all(t(track[k]) for k, t in tests) for track in inspect(data, self.max_bytes, self.limits)[2])

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for path, size, low, high in partition.files:
            for row in self.rows(path, size, self.relation == "track_packets")[low:high]:
                if all(t(row[k]) for k, t in self.tests):
                    yield row


class MediaReader(Files, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        for f in filters:
            if not self.push(f):
                yield f

    def partitions(self) -> Sequence[FilePartition]:
        return partitioned([(f.path, f.size, 0, None) for f in store.listed(self.path) if self.wanted(f.path)], self.at_once)


#: The offset before all files.
BEGINNING = {"time": 0, "path": "", "packet": 0}


class MediaStream(Files, D.DataSourceStreamReader):
    """Further options: order (``path`` or ``time``), filesPerBatch, packetsPerBatch (of the relation's rows), progress.

    ``packetsPerBatch`` has the driver index the files of a batch as well, to know where in a file it ends; it is meant for files
    of few packets or slow consumers.  A source is not told where a query stands when it is asked how far a batch may go, so the two
    limits need ``progress``, a folder beside the query's checkpoint (new with it) in which the end of the last planned batch is
    kept; without it a batch has all there is.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        options = {k.lower(): v for k, v in options.items()}
        self.by_time = options.get("order", "path") == "time"
        self.files_a_batch, self.packets_a_batch = int(options.get("filesperbatch", 0)), int(options.get("packetsperbatch", 0))
        self.progress = options.get("progress")
        if (self.files_a_batch or self.packets_a_batch) and not self.progress:
            raise ValueError("filesPerBatch and packetsPerBatch need a folder named by progress")
        self.known: dict | None = None

    def key(self, f: store.Listed) -> tuple[int, str]:
        return (f.time if self.by_time else 0), f.path

    def files(self) -> list[store.Listed]:
        return sorted(store.listed(self.path), key=self.key)

    def initialOffset(self) -> dict:  # noqa: N802
        return dict(BEGINNING)

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.files()
        if not self.progress:
            return self.after(files[-1]) if files else dict(BEGINNING)
        if self.known is None:  # the query began or began again; a batch that was planned and not done is planned first
            self.known = dict(BEGINNING)
            if store.exists(f"{self.progress}/end.json"):
                with store.opened(f"{self.progress}/end.json") as f:
                    self.known = json.loads(f.read())
        at = self.known
        rest = files[bisect_right([self.key(f) for f in files], (at["time"], at["path"])) :]
        left = self.packets_a_batch or None
        for f in rest[: self.files_a_batch or None]:
            if left is not None:
                n = len(self.rows(f.path, f.size)) - at["packet"]
                if n > left:
                    at = at | {"packet": at["packet"] + left}
                    break
                left -= n
            at = self.after(f)
            if left == 0:
                break
        return at

    def after(self, f: store.Listed) -> dict:
        time, path = self.key(f)
        return {"time": time, "path": path, "packet": 0}

    def partitions(self, start: dict, end: dict) -> Sequence[FilePartition]:
        if self.progress and end != self.known:
            self.known = end
            store.write_file(f"{self.progress}/end.json", json.dumps(end).encode())
        files = self.files()
        keys = [self.key(f) for f in files]
        low, high = (bisect_right(keys, (o["time"], o["path"])) for o in (start, end))
        if end["packet"]:
            high += 1
        if (start["path"] and start["path"] not in {p for _, p in keys}) or (end["path"] and end["path"] not in {p for _, p in keys}):
            raise ValueError("a file that an offset names is gone")
        found = []
        for k in range(low, high):
            f = files[k]
            until = end["packet"] if k == high - 1 and end["packet"] else None
            found.append((f.path, f.size, start["packet"] if k == low else 0, until))
        return partitioned(found, self.at_once)


class MediaSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return RELATIONS[self.options.get("relation", "packets")]

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader(dict(self.options))

    def streamReader(self, schema: StructType) -> MediaStream:  # noqa: N802
        return MediaStream(dict(self.options))


# --- sinks ---


@dataclass
class Written(D.WriterCommitMessage):
    folder: str  # of one attempt of one task, in the staging folder
    rows: int


class Writer:
    """Writes a partition into a folder of its own, and moves folders in place at the commit."""

    def __init__(self, options: dict, schema: StructType, files: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.schema, self.files = options["path"].rstrip("/"), schema, files
        #: Written rows a Parquet file at most.
        self.at_once = int(options.get("rowsperfile", 1_000_000))
        self.staging = f"{self.path}/_staging/{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        n = 0
        if self.files:
            names: set[str] = set()
            for row in rows:
                name = posixpath.basename(str(row["source_id"]))
                if not name or name[0] in "._" or name in names or row["content"] is None:
                    raise ValueError(f"a file needs a name of its own that is not hidden, and content: {row['source_id']!r}")
                names.add(name)
                store.write_file(f"{folder}/{name}", bytes(row["content"]), n > 0)
                n += 1
            return Written(folder, n)
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held, k = to_arrow_schema(self.schema), [], 0

        def flush() -> None:
            nonlocal k
            data = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_pylist(held, schema), data)
            store.write_file(f"{folder}/part-{k:05d}.parquet", data.getvalue().to_pybytes())
            held.clear()
            k += 1

        for row in rows:
            held.append(row.asDict(recursive=True))
            n += 1
            if len(held) >= self.at_once:
                flush()
        if held:
            flush()
        return Written(folder, n)

    def publish(self, messages: list, name: str) -> None:
        """Moves the tasks' folders below ``name``; a mark says that all are there."""
        mark = f"{self.path}/_committed/{name}"
        if store.exists(mark):  # a batch that ran before
            store.remove(self.staging)
            return
        store.remove(f"{self.path}/{name}")  # of a commit that broke off
        for k, m in enumerate(m for m in messages if m is not None and m.rows):
            store.move(m.folder, f"{self.path}/{name}/{k:05d}")
        store.write_file(mark, b"")
        store.remove(self.staging)


class BatchWriter(Writer, D.DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, f"job-{posixpath.basename(self.staging)}")

    def abort(self, messages: list) -> None:
        store.remove(self.staging)


class StreamWriter(Writer, D.DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        store.remove(self.staging)


class Sink(D.DataSource):
    FILES = False

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("this sink appends")
        return BatchWriter(dict(self.options), schema, self.FILES)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(dict(self.options), schema, self.FILES)


class MediaFiles(Sink):
    FILES = True

    @classmethod
    def name(cls) -> str:
        return "media_files"


class MediaRows(Sink):
    @classmethod
    def name(cls) -> str:
        return "media_rows"


def register(spark: SparkSession) -> None:
    """The sources and sinks of this module; filters are pushed into Python readers from here on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in (MediaSource, MediaFiles, MediaRows):
        spark.dataSource.register(kind)
