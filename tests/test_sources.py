"""Files to relations, and the relational steps on cases that the driver's tables do not have."""

from pyspark.sql import functions as F

from lodestream.functions import codecs, scalars
from lodestream.operators import timeline
from lodestream.plans.queries import MAKERS
from lodestream.sources import datasource, encode, media


def test_files(spark, tmp_path):
    for kind, make in MAKERS.items():
        (tmp_path / f"{kind}.bin").write_bytes(make([3, 4, 5]))
    (tmp_path / "junk.bin").write_bytes(b"not media")
    files = media.read_files(spark, str(tmp_path), "*.bin")
    found = media.indexed(files)
    codes = {r["source_id"].rsplit("/", 1)[1]: r["code"] for r in media.statuses(found).collect()}
    assert codes == {f"{k}.bin": 0 for k in MAKERS} | {"junk.bin": -2}
    assert media.tracks(found).count() == len(MAKERS)
    datasource.register(spark)
    for relation, want in (("packets", media.packets(found)), ("tracks", media.tracks(found)), ("status", media.statuses(found))):
        got = spark.read.format("media").option("relation", relation).load(str(tmp_path))
        cut = lambda df: sorted((r[0].rsplit("/", 1)[1], *tuple(r)[1:]) for r in df.collect())
        assert cut(got) == cut(want)


def test_payloads_and_frames(spark):
    pixels = bytes(range(24))
    data = encode.avi([(b"00db", pixels), (b"00db", pixels[::-1])], codec=b"DIB ")
    sources = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"?")), ("c", None)], "source_id string, content binary")
    got = media.packet_payloads(media.indexed(sources), sources).orderBy("seq").collect()
    assert [bytes(r["payload"]) for r in got] == [pixels, pixels[::-1]]
    frames = codecs.video_frames(sources).orderBy("frame_index").collect()
    assert [(r["width"], r["height"], int(r["timestamp_ns"]), len(r["pixels"])) for r in frames] == [(4, 2, 0, 32), (4, 2, 40_000_000, 32)]
    assert codecs.samples(sources).count() == 0


def test_asof_across_spans(spark):
    step = timeline.ASOF_SPAN
    entries = spark.createDataFrame([("s", 5, 1), ("s", step + 7, 2), ("s", 4 * step, 3), ("t", 0, 9)], "src string, first int, v int")
    places = [0, 4, 5, step, step + 6, step + 7, 3 * step, 4 * step - 1, 4 * step, 9 * step]
    chunks = spark.createDataFrame([("s", p) for p in places] + [("u", 3)], "src string, chunk int")
    got = {(r["src"], r["chunk"]): r["v"] for r in timeline.asof(chunks, entries, "src", "chunk", "first", "v").collect()}
    want = [None, None, 1, 1, 1, 2, 2, 2, 3, 3]
    assert got == {("s", p): w for p, w in zip(places, want, strict=True)} | {("u", 3): None}


def test_scalars(spark):
    one = spark.range(1)
    read = lambda c: one.select(c.alias("x")).first()["x"]
    assert read(scalars.fnv1a(F.lit("V_VP8"))) == 3404789108 and read(scalars.fnv1a(F.lit(""))) == 2166136261
    assert read(scalars.fourcc(F.lit("mp4a"))) == 0x6D703461
    assert read(scalars.read_le(F.lit(bytearray(b"\x01\x02\x03")), 0, 3)) == 0x030201
    assert read(scalars.rescaled_ns(F.lit(3), F.lit(1), F.lit(7))) == 428571429
    assert [read(scalars.text_admitted(F.lit(t))) for t in ("ok é", "a\nb", "x" * 128, None)] == [True, False, False, False]
    assert [read(scalars.rational_ok(F.lit(a), F.lit(b))) for a, b in ((30, 1), (1001, 1), (0, 1))] == [True, False, False]


def test_payloads_in_one_pass(spark):
    rows = [(k, bytearray(make([3, 0, 4, 5]))) for k, make in sorted(MAKERS.items())] + [("junk", bytearray(b"?")), ("none", None)]
    sources = spark.createDataFrame(rows, "source_id string, content binary")
    want = media.packet_payloads(media.indexed(sources), sources, 4)
    got = media.indexed_payloads(sources, 4)
    assert sorted(map(repr, got.where("status = 0").drop("status").collect())) == sorted(map(repr, want.collect()))
    assert {r.source_id for r in got.where("status <> 0").collect()} == {"junk", "none"} | {r.source_id for r in media.statuses(media.indexed(sources)).where("code <> 0").collect()}


def test_best_audio_and_further_decoders(spark):
    rows = [("a", 1, 2, False), ("a", 2, 1, False), ("a", 3, 1, True), ("b", 1, 1, False), ("b", 4, 1, False), ("c", 1, 2, True)]
    tracks = spark.createDataFrame(rows, "source_id string, track_id int, kind int, is_default boolean")
    assert {(r.source_id, r.track_id) for r in timeline.best_audio(tracks, "source_id", "track_id", "kind", "is_default").collect()} == {("a", 3), ("b", 1)}
    made = encode.adts([b"ab", b"c"])
    assert codecs.decode_source(made)[0] == -2
    codecs.DECODERS[media.S.ADTS] = lambda data, limits: (codecs.np.array([[len(data)]]), 8000)
    try:
        assert codecs.decode_source(made)[1].tolist() == [[len(made)]]
    finally:
        del codecs.DECODERS[media.S.ADTS]
