"""FLAC as relations against the serial reader and decoder, on whole, odd and broken sources."""

import random

import pytest

from lodestream import status as S
from lodestream.functions import codecs
from lodestream.sources import encode, flacframes, media


def cases():
    rng = random.Random(14)
    stereo = [[rng.randrange(-30000, 30000) for _ in range(2)] for _ in range(300)]
    whole = [encode.flac(stereo, block=64), encode.flac([[5]] * 10, block=2), encode.flac([[-7]] * 100, constant=True, block=40), encode.flac([[1]] * 512, block=2), encode.flac([[1]] * 514, block=2)]
    broken = []
    for base in whole[:3]:
        for _ in range(40):
            d = bytearray(base)
            d[rng.randrange(len(d))] = rng.choice([0, 1, 255, rng.randrange(256)])
            broken.append(bytes(d))
        broken += [base[: rng.randrange(1, len(base))] for _ in range(6)]
    # frames left out, doubled, in another order
    first = encode.flac([[k] for k in range(8)], block=2)
    ends = [p[0] for p in media.index(first)[3]] + [len(first)]
    cut = lambda *order: first[: ends[0]] + b"".join(first[ends[k] : ends[k + 1]] for k in order)
    broken += [cut(0, 1, 3), cut(0, 1, 1, 2), cut(1, 0, 2, 3), cut(0, 1, 2), cut()]
    return [*whole, *broken, b"", None, b"fLaC", encode.wav(b"\0\0")]


@pytest.mark.parametrize("limits", [S.LIMITS, S.Limits(packets=300)], ids=["default", "other"])
def test_equal_to_the_serial_reader(spark, limits):
    data = cases()
    sources = spark.createDataFrame([(str(k), None if d is None else bytearray(d)) for k, d in enumerate(data)], "source_id string, content binary").repartition(4)
    frames = flacframes.walked(sources).persist()
    found = flacframes.checked(frames, limits).persist()
    tracks = {int(r.source_id): (r.track_id, r.kind, r.codec_id, r.time_scale, int(r.duration_ticks), r.codec_name) for r in flacframes.tracks(frames).collect()}
    packets, values = {}, {}
    for r in flacframes.packets(found).orderBy("source_id", "seq").collect():
        packets.setdefault(int(r.source_id), []).append((r.byte_offset, r.byte_size, r.track_id, int(r.timestamp_ticks), r.duration_ticks, r.flags))
    for r in flacframes.samples(found).orderBy("source_id", "frame", "channel").collect():
        values.setdefault(int(r.source_id), []).append(r.value)
    codes = {int(r.source_id): (r.code, r.n_packets) for r in flacframes.statuses(found).collect()}
    good = 0
    for k, d in enumerate(data):
        own = media.inspect(d or b"")
        assert tracks.get(k) == (own[2][0] if own[0] == 0 and own[1] == S.FLAC else None), k
        status, container, _, want = media.index(d or b"", limits=limits)
        if container not in (0, S.FLAC):
            status, want = S.UNSUPPORTED, []
        assert (codes[k], packets.get(k, [])) == ((status, len(want) if status == 0 else 0), want if status == 0 else []), k
        code, samples, _ = codecs.decode_source(d or b"", limits=limits) if container == S.FLAC else (-2, None, 0)
        assert values.get(k) == (samples.ravel().tolist() if code == 0 else None), k
        good += status == 0
    assert good > 4
    frames.unpersist()
    found.unpersist()
