"""Positional reads, pushed filters, the stream of packets and the sinks, on files."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestream import status as S
from lodestream.plans.queries import MAKERS
from lodestream.sources import datasource, media, positional, store


@pytest.fixture
def blob(tmp_path):
    rng = random.Random(5)
    (tmp_path / "in").mkdir()
    data = {f"{tmp_path}/in/{k}.bin": rng.randbytes(n) for k, n in {"a": 700_000, "b": 3_000, "c": 0}.items()}
    for p, d in data.items():
        with open(p, "wb") as f:
            f.write(d)
    return data


def reads(spark, rows, **options):
    df = spark.createDataFrame(rows, "source_id string, seq int, byte_offset bigint, byte_size bigint")
    return {r.seq: r for r in positional.read_packets(df.repartition(3), **options).collect()}


def test_packets_are_read_by_position(spark, blob, tmp_path):
    a, b, c = blob
    rng = random.Random(6)
    rows = [(a, k, rng.randrange(0, 600_000), rng.choice([1, 17, 4000, 70_000])) for k in range(60)]
    rows += [(a, 100, 699_990, 10), (b, 101, 0, 3000), (b, 102, 1, 1), (b, 102 + 1, 1, 1), (f"file:{a}", 104, 5, 7)]
    bad = [(a, 200, 699_990, 11), (b, 201, 5000, 1), (c, 202, 0, 1), (f"{tmp_path}/none", 203, 0, 5), (a, 204, 0, 0), (a, 205, -1, 4), (a, 206, 2**63 - 2, 9), (a, 207, 3, S.MAX_PACKET_BYTES + 1), (None, 208, 0, 1), (a, 209, None, 1), (a, 210, 1, None), (str(tmp_path), 211, 0, 1)]
    for span in (positional.SPAN, 50_000):
        got = reads(spark, rows + bad, span=span)
        for path, seq, offset, size in rows:
            whole = blob[path.removeprefix("file:")]
            assert got[seq].packet_status == S.OK and bytes(got[seq].payload) == whole[offset : offset + size], seq
        want = {200: S.SOURCE_STALLED, 201: S.SOURCE_STALLED, 202: S.SOURCE_STALLED, 203: S.SOURCE_FAILED, **dict.fromkeys(range(204, 211), S.INVALID), 211: S.SOURCE_FAILED}
        assert {k: got[k].packet_status for k in want} == want and all(got[k].payload is None for k in want)
    assert reads(spark, []) == {}


def test_only_what_packets_name_is_fetched(spark, blob):
    a = next(iter(blob))
    rows = [(a, k, 60_000 * k, 100) for k in range(10)]
    assert sum(r.fetched for r in reads(spark, rows).values()) == 1000
    near = [(a, k, 1000 * k, 100) for k in range(10)]  # nearer than a gap: one extent
    got = reads(spark, near)
    assert sum(r.fetched for r in got.values()) == 9100 and sum(r.fetched > 0 for r in got.values()) == 1
    assert all(n <= positional.CHUNK for _, n, _ in positional.extents([(k * 50, 40) for k in range(9000)]))
    runs = [k for _, _, r in positional.extents([(0, 200_000), (10, 5), (100_000, 90_000), (200_001, 1)]) for k in r]
    assert runs == [0, 1, 2, 3]


class Odd:
    """A file that gives few bytes at a time, too many, or fails after some."""

    def __init__(self, kind):
        self.kind, self.at = kind, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        if self.kind == "fails" and self.at >= 100:
            raise OSError
        return b"x" * {"slow": min(n, 3), "fails": min(n, 50), "much": n + 1}[self.kind]

    def close(self):
        pass


def test_short_failing_and_cancelled_reads(spark):
    got = reads(spark, [("slow", 1, 0, 10), ("fails", 2, 0, 90), ("fails", 3, 95, 60), ("much", 4, 0, 5)], opener=Odd)
    assert {k: r.packet_status for k, r in got.items()} == {1: S.OK, 2: S.OK, 3: S.SOURCE_FAILED, 4: S.INVALID}
    got = reads(spark, [("slow", 1, 0, 10), ("slow", 2, 9_000, 1)], opener=Odd, cancelled=lambda: True)
    assert {r.packet_status for r in got.values()} == {S.CANCELLED} and all(r.payload is None for r in got.values())


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "media"
    at.mkdir()
    for k, (kind, make) in enumerate(sorted(MAKERS.items())):
        (at / f"{k:02d}-{kind}.bin").write_bytes(make([3, 4, 5, k + 1]))
    (at / "90-junk.bin").write_bytes(b"not media")
    (at / "_hidden.bin").write_bytes(MAKERS["wav"]([1]))
    return at


def load(spark, at, **options):
    datasource.register(spark)
    reader = spark.read.format("media")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(at))


def test_filters_are_pushed_into_the_reader(spark, folder):
    whole = load(spark, folder, relation="track_packets")
    rows = whole.collect()
    assert len({r.source_id for r in rows}) == len(MAKERS) and {r.kind for r in rows} >= {S.AUDIO}
    some = sorted({r.source_id for r in rows})[2]
    cases = [
        (F.col("track_id") == 1, lambda r: r.track_id == 1),
        (F.col("kind") == S.VIDEO, lambda r: r.kind == S.VIDEO),
        ((F.col("kind") != S.AUDIO) & (F.col("seq") < 2), lambda r: r.kind != S.AUDIO and r.seq < 2),
        (F.col("source_id") == some, lambda r: r.source_id == some),
        (F.col("source_id").endswith("wav.bin") & F.col("byte_offset").isNotNull() & (F.col("timestamp_ticks") >= 1), lambda r: r.source_id.endswith("wav.bin") and r.timestamp_ticks >= 1),
        (F.col("seq").isin(0, 3) & (F.col("flags") <= 1), lambda r: r.seq in (0, 3) and r.flags <= 1),
        (F.col("kind").isNull(), lambda r: r.kind is None),
    ]
    for condition, plain in cases:
        found = whole.where(condition)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan media" in plan and not re.search(r"\bFilter\b", plan), plan
        assert sorted(found.collect()) == sorted(r for r in rows if plain(r))
    # what is not pushed stays above the scan
    odd = whole.where((F.col("seq") == 1) | (F.col("track_id") == 2)).where(F.col("byte_size") % 2 == 0)
    assert sorted(odd.collect()) == sorted(r for r in rows if (r.seq == 1 or r.track_id == 2) and r.byte_size % 2 == 0)


def test_rows_and_files_left_out_never_leave_the_reader(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringContains

    reader = datasource.MediaReader({"path": str(folder), "relation": "track_packets"})
    left = [StringContains(("other",), "x"), GreaterThan(("a", "b"), 1)]
    assert list(reader.pushFilters([EqualTo(("kind",), S.VIDEO), Not(EqualTo(("track_id",), 7)), StringContains(("source_id",), "avi"), *left])) == left
    parts = reader.partitions()
    assert [os.path.basename(f[0]) for p in parts for f in p.files] == [n for n in sorted(os.listdir(folder)) if "avi" in n]
    got = [r for p in parts for r in reader.read(p)]
    assert got and all(r[8] == S.VIDEO and r[3] != 7 for r in got)


def started(spark, at, out, mark, **options):
    stream = spark.readStream.format("media")
    for k, v in options.items():
        stream = stream.option(k, v)
    query = stream.load(str(at)).writeStream.format("media_rows").option("path", str(out)).option("checkpointLocation", str(mark)).start()
    query.processAllAvailable()
    return query


@pytest.mark.parametrize("options", [{"filesPerBatch": "2"}, {"packetsPerBatch": "3"}, {"order": "time"}], ids=str)
def test_stream_resumes_without_loss_or_repeats(spark, folder, tmp_path, options):
    datasource.register(spark)
    out, mark, later = tmp_path / "out", tmp_path / "mark", tmp_path / "later"
    if "order" not in options:
        options = options | {"progress": f"{tmp_path}/progress"}
    later.mkdir()
    names = sorted(os.listdir(folder))
    for n in names[4:]:
        os.rename(folder / n, later / n)
    query = started(spark, folder, out, mark, **options)
    batches = query.lastProgress["batchId"]
    query.stop()
    assert sorted(spark.read.parquet(f"{out}/batch-*/*").collect()) == sorted(load(spark, folder).collect())
    if "packetsPerBatch" in options:
        assert batches >= load(spark, folder).count() // 3 - 1  # batches that end within files
    elif "filesPerBatch" in options:
        assert batches == 1
    for n in names[4:]:
        os.utime(later / n)
        os.rename(later / n, folder / n)
    started(spark, folder, out, mark, **options).stop()
    started(spark, folder, out, mark, **options).stop()  # nothing new
    assert sorted(spark.read.parquet(f"{out}/batch-*/*").collect()) == sorted(load(spark, folder).collect())


def test_stream_offsets_split_files(tmp_path):
    with pytest.raises(ValueError, match="progress"):
        datasource.MediaStream({"path": "/none", "packetsPerBatch": "5"})
    options = {"path": "/none", "packetsPerBatch": "5", "progress": f"{tmp_path}/p"}
    reader = datasource.MediaStream(options)
    files = [store.Listed(f"/f{k}", 10, 0) for k in range(3)]
    reader.files = lambda: files
    reader.rows = lambda path, size: list(range({"/f0": 7, "/f1": 3, "/f2": 4}[path]))
    at, seen = reader.initialOffset(), []
    for _ in range(6):
        end = reader.latestOffset()
        for p in reader.partitions(at, end):
            seen += [(f[0], i) for f in p.files for i in reader.rows(f[0], 0)[f[2] : f[3]]]
        at = end
        again = datasource.MediaStream(options)  # begun again, it goes on from what was planned last
        again.files, again.rows = reader.files, reader.rows
        reader = again
    assert seen == [(f"/f{k}", i) for k, n in enumerate((7, 3, 4)) for i in range(n)]
    assert at == {"time": 0, "path": "/f2", "packet": 0}


def test_sink_of_files_and_failing_tasks(spark, tmp_path):
    datasource.register(spark)
    rows = spark.range(20).select(F.format_string("f%02d.bin", "id").alias("source_id"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartition(4)
    out = tmp_path / "files"
    rows.write.format("media_files").option("path", str(out)).mode("append").save()
    assert {os.path.basename(f.path): f.size for f in store.listed(str(out))} == {f"f{k:02d}.bin": len(str(k)) for k in range(20)}
    back = media.read_files(spark, str(out), "*.bin")
    assert {bytes(r.content) for r in back.collect()} == {str(k).encode() for k in range(20)}
    before = len(store.listed(str(out)))
    bad = rows.withColumn("content", F.when(F.col("source_id") != "f07.bin", F.col("content")))
    with pytest.raises(Exception, match="name of its own"):  # one task fails: nothing of the job is there
        bad.write.format("media_files").option("path", str(out)).mode("append").save()
    assert len(store.listed(str(out))) == before and not store.exists(f"{out}/_staging/x")
    assert not os.listdir(out / "_staging") if (out / "_staging").exists() else True


def test_a_repeated_batch_and_a_second_attempt_leave_each_row_once(spark, tmp_path):
    schema = spark.range(1).schema
    make = lambda: datasource.StreamWriter({"path": str(tmp_path)}, schema, False)
    rows = lambda low, high: iter(spark.range(low, high).collect())
    w = make()
    lost = w.write(rows(0, 5))  # an attempt whose message never comes
    w.commit([w.write(rows(0, 5)), w.write(rows(5, 9)), w.write(iter([])), None], 3)
    again = make()
    again.commit([again.write(rows(0, 9))], 3)
    other = make()
    other.abort([other.write(rows(50, 60)), None], 4)
    last = make()
    last.commit([last.write(rows(9, 11))], 4)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/batch-*/*").collect()) == list(range(11))
    assert not store.exists(lost.folder) and os.listdir(tmp_path / "_staging") == []


def test_packets_of_tracks_left_out_are_not_walked(tmp_path, monkeypatch):
    """Of files that hold no track of the kind asked for the packets are not read; the rows are those of a reader without the filter."""
    from pyspark.sql import datasource as D

    from lodestream.sources import datasource, encode

    (tmp_path / "a.mp4").write_bytes(encode.mp4([b"abc", b"de"], [3, 4]))
    (tmp_path / "b.webm").write_bytes(encode.mkv([(0, [encode.element(0xA3, encode.block(b"x"))])]))
    (tmp_path / "c.avi").write_bytes(encode.avi([(b"00dc", b"xy"), (b"01wb", b"ab")], audio=True))
    (tmp_path / "d.avi").write_bytes(encode.avi([(b"00dc", b"xy")]))
    (tmp_path / "e.mp4").write_bytes(b"no media")
    walked, index = [], datasource.index
    monkeypatch.setattr(datasource, "index", lambda data, *rest: walked.append(data) or index(data, *rest))

    def rows(*filters):
        reader = datasource.MediaReader({"path": str(tmp_path), "relation": "track_packets"})
        assert list(reader.pushFilters(list(filters))) == []
        return [r for p in reader.partitions() for r in reader.read(p)]

    everything = rows()
    assert len(everything) == 6 and len(walked) == 5
    walked.clear()
    assert rows(D.EqualTo(("kind",), 1)) == [r for r in everything if r[-2] == 1] and len(walked) == 2
    walked.clear()
    assert rows(D.EqualTo(("kind",), 2), D.EqualTo(("track_id",), 2)) == [] and walked == []
