"""WAV by expressions against the reader in Python, on whole, odd and broken files."""

import random
import struct

import pytest

from lodestream import status as S
from lodestream.sources import encode, media, riff, wavtree


def cases():
    ext = lambda tag, valid=16, tail=riff._GUID_TAIL: struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 16000, 2, 16, 22, valid, 0) + struct.pack("<H", tag) + tail
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    form = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body
    ima = struct.pack("<HHIIHH", 0x11, 1, 8000, 4055, 36, 4) + b"\2\0\x41\0"
    whole = [encode.wav(bytes(20)), encode.wav(bytes(24), 3, 2, 8000, 32), encode.wav(bytes(9), 7, 1, 8000, 8), encode.wav(bytes(600)), form(chunk(b"LIST", b"odd") + chunk(b"fmt ", ext(1)) + chunk(b"data", bytes(8)) + b"tail"), form(chunk(b"fmt ", ima) + chunk(b"data", bytes(72)))]
    whole += [form(chunk(b"fmt ", ext(1, 17)) + chunk(b"data", bytes(8))), form(chunk(b"fmt ", ext(1, 16, bytes(14))) + chunk(b"data", bytes(8))), form(chunk(b"data", bytes(8))), form(b""), b"RIFF\0\0\0\0WAVE", encode.wav(b""), encode.wav(bytes(8)) + b"more"]
    rng = random.Random(7)
    broken = []
    for base in whole[:6]:
        for _ in range(50):
            d = bytearray(base)
            for _ in range(rng.randint(1, 2)):
                d[rng.randrange(min(len(d), 80))] = rng.choice([0, 1, 2, 4, 16, 255, rng.randrange(256)])
            broken.append(bytes(d))
        broken += [base[: rng.randrange(len(base))] for _ in range(8)]
    return [*whole, *broken, b"", None, b"RIFF", b"\x1aE\xdf\xa3"]


@pytest.mark.parametrize(("frames", "limits"), [(1, S.LIMITS), (4, S.Limits(packets=60))], ids=["single", "grouped"])
def test_equal_to_the_reader_in_python(spark, frames, limits):
    data = cases()
    sources = spark.createDataFrame([(str(k), None if d is None else bytearray(d)) for k, d in enumerate(data)], "source_id string, content binary").repartition(4)
    found = wavtree.inspected(sources).persist()
    tracks = {int(r.source_id): tuple(r)[2:6] + (int(r.duration_ticks), r.codec_name) for r in wavtree.tracks(found).collect()}
    packets = {}
    for r in wavtree.packets(found, frames, limits).orderBy("source_id", "seq").collect():
        packets.setdefault(int(r.source_id), []).append((r.byte_offset, r.byte_size, r.track_id, int(r.timestamp_ticks), r.duration_ticks, r.flags))
    codes = {int(r.source_id): (r.code, r.n_packets) for r in wavtree.statuses(found, frames, limits).collect()}
    good = 0
    for k, d in enumerate(data):
        status, container, _, want = media.index(d or b"", frames_per_packet=frames, limits=limits)
        if container not in (0, S.WAV):
            status, want = S.UNSUPPORTED, []
        own = media.inspect(d or b"")
        assert tracks.get(k) == (own[2][0] if own[0] == 0 and own[1] == S.WAV else None), k
        assert codes[k] == (status, len(want) if status == 0 else 0) and packets.get(k, []) == (want if status == 0 else []), k
        good += status == 0
    assert good > 40
    plan = wavtree.packets(wavtree.inspected(sources))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found.unpersist()
