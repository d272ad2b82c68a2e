"""Matroska and WebM as relations against the serial reader, on whole, odd and broken sources."""

import random

import pytest

from lodestream import status as S
from lodestream.sources import boxtree, elements, encode, media


def cases():
    simple = lambda body, at=0, **k: encode.element(0xA3, encode.block(body, at, **k))
    group = lambda body, *more: encode.element(0xA0, encode.element(0xA1, encode.block(body, 3, 0)) + b"".join(more))
    lace = encode.xiph_lace([b"ab", bytes(300), b"c"])
    whole = [
        encode.mkv([(0, [simple(b"abc"), simple(b"de", 5, flags=0)]), (1000, [group(b"f", encode.uint(0x9B, 40)), group(b"g", encode.uint(0xFB, 1))])]),
        encode.mkv([(7, [simple(lace, 0, flags=0x82), simple(b"z", 9)])], "matroska", scale=1000),
        encode.mkv([(k, [simple(bytes(k + 1))]) for k in range(5)], codec=b"V_MPEG4/ISO/AVC\0\0"),
        encode.mkv([(0, [simple(b"a", track=2)])]), encode.mkv([(0, [simple(b"a", -5)])]), encode.mkv([]), encode.mkv([(0, [simple(b"a")])], "other"), encode.mkv([(3, [simple(b"a")] * 256)]), encode.mkv([(3, [simple(b"a")] * 257)]),
        encode.mkv([(0, [simple(b"a"), encode.uint(0xE7, 4)])]), encode.mkv([(0, [group(b"f", encode.uint(0x9B, 40), encode.uint(0x9B, 41))])], codec=b"x" * 40),
    ]
    rng = random.Random(13)
    broken = []
    for base in whole[:3]:
        for _ in range(90):
            d = bytearray(base)
            for _ in range(rng.randint(1, 2)):
                d[rng.randrange(len(d))] = rng.choice([0, 1, 2, 0x80, 0x81, 255, rng.randrange(256)])
            broken.append(bytes(d))
        broken += [base[: rng.randrange(len(base))] for _ in range(8)]
    return [*whole, *broken, b"", None, b"\x1aE\xdf\xa3", encode.wav(b"\0\0")]


@pytest.mark.parametrize("limits", [S.LIMITS, S.Limits(packets=300)], ids=["default", "other"])
def test_equal_to_the_serial_reader(spark, limits):
    data = cases()
    sources = spark.createDataFrame([(str(k), None if d is None else bytearray(d)) for k, d in enumerate(data)], "source_id string, content binary").repartition(4)
    rows = elements.walked(sources).persist()
    found = elements.inspected(rows, limits).persist()
    tracks, packets = {}, {}
    for r in elements.tracks(found).collect():
        tracks.setdefault(int(r.source_id), []).append((r.track_id, r.kind, r.codec_id, r.time_scale, int(r.duration_ticks), r.codec_name))
    shown = elements.packets(rows, found, limits)
    for r in shown.orderBy("source_id", "seq").collect():
        packets.setdefault(int(r.source_id), []).append((r.byte_offset, r.byte_size, r.track_id, int(r.timestamp_ticks), r.duration_ticks, r.flags))
    codes = {int(r.source_id): r.code for r in boxtree.statuses(found, shown).collect()}
    good = 0
    for k, d in enumerate(data):
        kinds = (0, S.WEBM, S.MATROSKA)
        own = media.inspect(d or b"", limits=limits)
        assert tracks.get(k, []) == (own[2] if own[0] == 0 and own[1] in kinds else []), k
        status, container, _, want = media.index(d or b"", limits=limits)
        if container not in kinds:
            status, want = S.UNSUPPORTED, []
        assert (codes[k], packets.get(k, [])) == (status, want if status == 0 else []), (k, d)
        good += status == 0
    assert good > 40
    rows.unpersist()
    found.unpersist()
