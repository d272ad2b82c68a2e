"""Checksums merged from any cut, chains ranked by doubling, and long streams indexed by many tasks, against the serial readers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream import status as S
from lodestream.functions import checksums as C
from lodestream.operators import chains
from lodestream.sources import bits, encode, longstreams, streams


def serial(kind, data):
    r = kind.start
    for b in data:
        for k in range(7, -1, -1):
            top = (r >> (kind.bits - 1) & 1) ^ (b >> k & 1)
            r = (r << 1 & kind.mask) ^ (kind.polynomial if top else 0)
    return r


def test_crc_equals_the_serial_one_for_every_cut():
    rng = random.Random(1)
    for kind in (C.OGG, C.FLAC16, C.FLAC8, C.Kind(16, 0x1021, 0xFFFF), C.Kind(32, 0x04C11DB7, 0xFFFFFFFF)):
        for n in (0, 1, 2, 63, 64, 65, 300, 1025):
            data = rng.randbytes(n)
            assert kind.of(data) == serial(kind, data)
        for cut in range(0, 1026, 37):
            a, b = data[:cut], data[cut:]
            assert kind.times(kind.plain(a), kind.ahead(len(b))) ^ kind.plain(b) == kind.plain(data)
    data = rng.randbytes(5000)
    assert C.OGG.of(data) == bits.crc32_ogg(data[:22] + b"\0\0\0\0" + data[26:]) or C.OGG.of(data[:22] + b"\0\0\0\0" + data[26:]) == bits.crc32_ogg(data)


def test_one_span_over_many_tasks(spark):
    rng = random.Random(2)
    spans = {k: rng.randbytes(n) for k, n in enumerate((100_000, 1, 5_000))}
    rows = []
    for k, data in spans.items():
        at = 0
        while at < len(data):
            n = rng.randrange(1, 3000)
            rows.append((k, at, bytearray(data[at : at + n])))
            at += n
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "span int, at bigint, body binary").repartition(8)
    for kind in (C.OGG, C.Kind(16, 0x1021, 0xFFFF)):
        got = {r.span: (r.n_bytes, r.crc) for r in C.checksums(df, kind, ["span"], "at", "body").collect()}
        assert got == {k: (len(d), serial(kind, d)) for k, d in spans.items()}
    holed = C.checksums(df.where("not (span = 0 and at = 0)"), C.OGG, ["span"], "at", "body")
    assert {r.span: r.crc is None for r in holed.collect()} == {0: True, 1: False, 2: False}


def test_ranked_chains(spark):
    rng = random.Random(3)
    rows, want = [], []
    for s, n in (("a", 1), ("b", 37), ("c", 200)):
        at, rank = 0, 0
        want.append((s, 0, 0))
        for _ in range(n):
            to, many = at + rng.randrange(1, 50), rng.randrange(1, 9)
            rows.append((s, at, to, many))
            at, rank = to, rank + many
            want.append((s, at, rank))
        rows += [(s, k * 7 + 100_000, k * 7 + 100_007, 1) for k in range(30)]  # not reached
    got = chains.ranked(spark.createDataFrame(rows, "s string, a bigint, b bigint, n bigint"), "s", "a", "b", "n")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    (tmp_path / "adts").mkdir()
    (tmp_path / "ogg").mkdir()
    false = b"\xff\xf1\x50\x80\x40\x1f\xfc\xff\xf1\x4c\x80\x01\x3f\xfc"  # looks like headers
    frames = [rng.randbytes(rng.randrange(0, 900)) + (false if rng.random() < 0.2 else b"") for _ in range(3000)]
    long = encode.adts(frames)
    header = streams.adts_frames(long)[1500][0]
    adts = {"long": long, "short": encode.adts([b"x", b""]), "cut": long[:-1], "broken": long[:header] + b"\0" * 9 + long[header + 9 :], "none": b"", "junk": b"nothing here"}
    pages = [(b"\0" + rng.randbytes(rng.randrange(1, 3000)) + b"OggS\0", k) for k in range(1, 600)]
    ogg = encode.ogg_vorbis(pages)
    wrong = bytearray(ogg)
    wrong[len(ogg) // 2] ^= 1
    oggs = {"long": ogg, "wrong": bytes(wrong), "cut": ogg[:-3], "adts": long[:1000]}
    for kind, files in (("adts", adts), ("ogg", oggs)):
        for n, d in files.items():
            (tmp_path / kind / f"{n}.bin").write_bytes(d)
    return tmp_path, adts, oggs


@pytest.mark.parametrize("piece", [4096, 100_000, longstreams.PIECE])
def test_adts_streams_of_thousands_of_frames(spark, folder, piece):
    at, adts, _ = folder
    found, codes = longstreams.adts_index(spark, str(at / "adts"), piece)
    name = F.regexp_extract("source_id", "([a-z]+)[.]bin$", 1).alias("name")
    got = {}
    for r in found.select(name, "seq", "byte_offset", "byte_size", "timestamp_ticks", "duration_ticks").orderBy("name", "seq").collect():
        got.setdefault(r.name, []).append(tuple(r)[1:])
    want = {}
    for n, d in adts.items():
        try:
            want[n] = [(k, p[0], p[1], p[3], p[4]) for k, p in enumerate(streams.adts_packets(d, S.Limits(frames=10**6)))]
        except bits.Bad:
            continue
    assert set(want) == {"long", "short"} and len(want["long"]) == 3000 and got == want
    assert {r["name"]: r.code for r in codes.select(name, "code").collect()} == {n: S.OK if n in want else S.UNSUPPORTED for n in adts}
    if piece == 4096:
        most = longstreams.links(longstreams.pieces(spark, str(at / "adts" / "long.bin"), longstreams.ADTS, piece), longstreams.ADTS, piece).agg(F.max("n")).first()[0]
        assert most < 3000 / 20  # no task walked the whole stream
    _, few = longstreams.adts_index(spark, str(at / "adts"), piece, most=100)
    assert few.where("code = 0").count() == 1


@pytest.mark.parametrize("piece", [70_000, longstreams.PIECE])
def test_ogg_pages(spark, folder, piece):
    at, _, oggs = folder
    found, codes = longstreams.ogg_page_index(spark, str(at / "ogg"), piece)
    want = streams.ogg_pages(oggs["long"], S.Limits(pages=10**6))
    got = found.orderBy("seq").collect()
    assert [(r.granule, r.serial, r.sequence, r.page_flags, r.byte_offset + r.byte_size) for r in got] == [(p.granule, p.serial, p.sequence, p.flags, p.end) for p in want]
    assert {r.source_id.rsplit("/", 1)[1]: r.code for r in codes.collect()} == {f"{n}.bin": S.OK if n == "long" else S.UNSUPPORTED for n in oggs}
