"""The box tree by expressions against the reader in Python, on whole, odd and broken files."""

import random
import struct

import pytest

from lodestream import status as S
from lodestream.sources import boxes, boxtree, encode, media

PARTS = [b"abc", b"de", b"f", b"ghij", b"klmno"]
TIMES = [10, 20, 30, 40, 50]


def two_tracks():
    """Tracks of different tables, deeper and unknown boxes, and a 64-bit size."""
    one = encode.mp4(PARTS, TIMES, shifts=[5, -5, 0, 0, 1], keys=[1, 4], per_chunk=2, wide=True)
    other = encode.mp4(PARTS[:3], TIMES[:3], handler=b"vide", codec=b"avc1", keys=[2])
    cut = lambda d: next(d[a:e] for k, a, e in boxes.boxes(d, 0, len(d)) if k == b"moov")
    second = bytearray(cut(other))
    at = second.index(b"tkhd") + 4 + 12
    second[at : at + 4] = struct.pack(">I", 7)
    moov = cut(one) + bytes(second) + encode.box(b"udta", encode.box(b"free", b"xx"))
    head = one[: one.index(b"moov") - 4]
    return head + encode.box(b"skip", b"") + struct.pack(">I4sQ", 1, b"moov", len(moov) + 16) + moov


def cases():
    whole = [encode.mp4(PARTS, TIMES, shifts=[5, -5, 0, 0, 1], keys=[1, 4], per_chunk=2, wide=True), encode.mp4(PARTS, TIMES, per_chunk=3), two_tracks(), encode.mp4(PARTS, [1, 0, 3, 4, 5]), encode.mp4(PARTS, TIMES, shifts=[-1, 0, 0, 0, 0])]
    whole += [encode.mp4([bytes(3)] * n, [2] * n, per_chunk=7) for n in (1, 255, 256, 257)]
    rng = random.Random(9)
    broken = []
    for base in whole[:3]:
        for _ in range(60):
            d = bytearray(base)
            for _ in range(rng.randint(1, 2)):
                d[rng.randrange(len(d))] = rng.choice([0, 1, 2, 255, rng.randrange(256)])
            broken.append(bytes(d))
        broken += [base[: rng.randrange(len(base))] for _ in range(15)]
    return [*whole, *broken, b"", None, b"junk of no kind", encode.wav(b"\0\0"), bytes(8)]


@pytest.mark.parametrize("limits", [S.LIMITS, S.Limits(packets=300, tracks=1)], ids=["default", "other"])
def test_equal_to_the_reader_in_python(spark, limits):
    data = cases()
    sources = spark.createDataFrame([(str(k), None if d is None else bytearray(d)) for k, d in enumerate(data)], "source_id string, content binary").repartition(4)
    found = boxtree.inspected(sources, limits=limits).persist()
    tracks, packets = {}, {}
    for r in boxtree.tracks(found).collect():
        tracks.setdefault(int(r.source_id), []).append((r.track_id, r.kind, r.codec_id, r.time_scale, int(r.duration_ticks), r.codec_name))
    rows = boxtree.packets(found, limits)
    for r in rows.orderBy("source_id", "seq").collect():
        packets.setdefault(int(r.source_id), []).append((r.byte_offset, r.byte_size, r.track_id, int(r.timestamp_ticks), r.duration_ticks, r.flags))
    codes = {int(r.source_id): r.code for r in boxtree.statuses(found, rows).collect()}
    inspected = {int(r.source_id): (r.status, r.container_id) for r in found.select("source_id", "status", "container_id").collect()}
    good = 0
    for k, d in enumerate(data):
        status, container, want = media.inspect(d or b"", limits=limits)
        if container not in (0, S.MP4):
            status, container, want = S.UNSUPPORTED, 0, []
        assert inspected[k] == (status, container), (k, inspected[k], status, container)
        assert tracks.get(k, []) == want, k
        code, at, _, wanted = media.index(d or b"", limits=limits)
        code = S.UNSUPPORTED if at not in (0, S.MP4) else code
        assert codes[k] == code and packets.get(k, []) == (wanted if code == 0 else []), k
        good += code == 0
    assert good > 20
    found.unpersist()


def test_files_made_by_expressions(spark):
    rows = [(k, [k + j + 1 for j in range(k)], [3 + j for j in range(k)]) for k in range(1, 12)]
    df = spark.createDataFrame(rows, "source_id int, sizes array<bigint>, deltas array<bigint>")
    made = boxtree.mp4_files(df, "source_id", "sizes", "deltas", 2, 2)
    for r in made.collect():
        _, sizes, deltas = rows[int(r.source_id) - 1]
        want = encode.mp4([bytes(n) for n in sizes], deltas, keys=list(range(1, len(sizes) + 1, 2)), per_chunk=2)
        assert media.index(bytes(r.content)) == media.index(want)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, [3, 4], [5, 6])], "source_id int, sizes array<bigint>, deltas array<bigint>")
    made = boxtree.mp4_files(df, "source_id", "sizes", "deltas", 2, 2)
    plan = boxtree.packets(boxtree.inspected(made))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
