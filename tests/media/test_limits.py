"""Limits as parameters, a status row for everything refused, bounded reads and header checks."""

from pyspark.sql import functions as F

from lodestream.functions import codecs
from lodestream.operators import validity
from lodestream.sources import datasource, encode, media


def test_every_source_has_a_status(spark, tmp_path):
    for name, n in (("small", 10), ("large", 400)):
        (tmp_path / f"{name}.wav").write_bytes(encode.wav(bytes(2 * n)))
    (tmp_path / "empty.avi").write_bytes(encode.avi([]))
    files = media.read_files(spark, str(tmp_path), max_bytes=500)
    got = {r["source_id"].rsplit("/", 1)[1]: (r["status"], r["n"]) for r in media.indexed(files, max_bytes=500).select("source_id", "status", F.size("packets").alias("n")).collect()}
    assert got == {"small.wav": (0, 10), "large.wav": (-1, 0), "empty.avi": (-2, 0)}
    datasource.register(spark)
    read = lambda **o: {r["source_id"].rsplit("/", 1)[1]: r["code"] for r in spark.read.format("media").options(relation="status", **o).load(str(tmp_path)).collect()}
    assert read(maxBytes="500") == {"small.wav": 0, "large.wav": -1, "empty.avi": -2}
    assert read() == {"small.wav": 0, "large.wav": -2, "empty.avi": -2}  # 400 packets are too many
    assert read(framesPerPacket="100") == {"small.wav": 0, "large.wav": 0, "empty.avi": -2}


def test_oversized_packets_keep_their_row(spark):
    data = encode.avi([(b"00dc", b"abcdef"), (b"00dc", b"xy")])
    sources = spark.createDataFrame([("a", data)], "source_id string, content binary")
    got = media.packet_payloads(media.indexed(sources), sources, max_bytes=4).orderBy("seq").collect()
    assert [(r["packet_status"], r["payload"] and bytes(r["payload"])) for r in got] == [(-1, None), (0, b"xy")]


def test_bounded_reads_and_packet_tables(spark):
    values = [k * 3 - 50 for k in range(40)]
    data = encode.wav(b"".join(v.to_bytes(2, "little", signed=True) for v in values))
    sources = spark.createDataFrame([("a", data), ("b", b"RIFF"), ("c", None)], "source_id string, content binary")
    asked = spark.createDataFrame([("a", 0, 3), ("a", 38, 9), ("a", 40, 5), ("a", 5, 0), ("b", 0, 9)], "source_id string, position bigint, max_frames bigint")
    got = codecs.bounded_read(codecs.samples(sources), asked, at_once=2).collect()
    assert sorted((r["position"], r["frame"], r["value"]) for r in got) == [(0, 0, values[0]), (0, 1, values[1]), (38, 38, values[38]), (38, 39, values[39])]
    rows = media.samples_by_packets(sources, frames_per_packet=16).collect()
    assert [(r["packet"], r["frame"], r["value"]) for r in rows if r["source_id"] == "a"] == [(k // 16, k, v) for k, v in enumerate(values)]
    assert sorted((r["source_id"], r["status"], r["frame"]) for r in rows if r["source_id"] != "a") == [("b", -2, None), ("c", -1, None)]


def test_headers_and_revisions(spark):
    top = 2**64 - 1
    cases = [(0, 5), (1, 0), (1, 9), (1, 8), (top, 1), (top - 1, 1), (top - 7, 8)]
    df = spark.createDataFrame([(str(a), n) for a, n in cases], "a string, n int").selectExpr("cast(a as decimal(20,0)) a", "n")
    assert [r[0] for r in df.select(validity.request_range_ok(F.col("a"), F.col("n"), 8)).collect()] == [a > 0 and 0 < n <= 8 and a + n <= top for a, n in cases]
    info = lambda revision, flags, published: spark.range(1).select(
        validity.session_info_ok(F.lit(1), F.lit(3), F.lit(0), F.lit(0), F.lit(str(revision)).cast("decimal(20,0)"), F.lit("t"), F.lit(""), F.lit(""), published, F.lit(flags))
    ).first()[0]
    assert info(0, 0, False) and info(7, 3, True) and not info(7, 4, True) and not info(top, 0, True) and info(top - 1, 0, True) and not info(0, 0, True)


def test_decisions_reach_a_sink_once(spark, tmp_path):
    """``reconcile`` hands each micro-batch to its action; a batch that comes again is known by its number."""
    from lodestream.streaming import processors

    schema = "session bigint, granted int"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    seen = {}

    def act(batch, number):
        seen.setdefault(number, sorted(tuple(r) for r in batch.collect()))

    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(f'{{"session": {k}, "granted": {j}}}' for j in range(2)))
        run = processors.reconcile(stream, act, str(tmp_path / "state"))
        run.processAllAvailable()
        run.stop()
    assert sorted(r for rows in seen.values() for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]
