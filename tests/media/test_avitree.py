"""AVI by expressions against the reader in Python, on whole, odd and broken files."""

import random

from lodestream import status as S
from lodestream.sources import avitree, boxtree, encode, media, riff


def cases():
    frames = [(b"00dc", b"abc"), (b"01wb", bytes(20)), (b"00dc", b"defgh"), (b"01wb", bytes(7)), (b"00db", b"x")]
    whole = [encode.avi(frames, audio=True), encode.avi([(b"00dc", bytes(k + 1)) for k in range(9)]), encode.avi([(b"00db", bytes(24))], codec=b"DIB "), encode.avi([]), encode.avi([(b"00dc", b"")]), encode.avi([(b"03dc", b"a")]), encode.avi([(b"00wb", b"a")]), encode.avi([(b"xxdc", b"a")])]
    whole += [encode.avi([(b"00dc", b"a")] * n) for n in (256, 257)] + [encode.avi(frames, audio=True, codec=b"a\x01bc"), encode.avi([(b"00dc", b"ab"), (b"00pc", b"pal"), (b"00dc", b"c")])]
    # offsets that count from the file
    shifted = bytearray(encode.avi([(b"00dc", b"abcd")]))
    at = shifted.index(b"idx1") + 8
    movi = shifted.index(b"movi")
    shifted[at + 8 : at + 12] = (movi + 4).to_bytes(4, "little")
    whole.append(bytes(shifted))
    rng = random.Random(12)
    broken = []
    for base in whole[:3]:
        for _ in range(90):
            d = bytearray(base)
            for _ in range(rng.randint(1, 2)):
                d[rng.randrange(len(d))] = rng.choice([0, 1, 2, 4, 16, 255, rng.randrange(256)])
            broken.append(bytes(d))
        broken += [base[: rng.randrange(len(base))] for _ in range(8)]
    return [*whole, *broken, b"", None, b"RIFF", encode.wav(b"\0\0")]


def test_equal_to_the_reader_in_python(spark):
    data = cases()
    sources = spark.createDataFrame([(str(k), None if d is None else bytearray(d)) for k, d in enumerate(data)], "source_id string, content binary").repartition(4)
    found = avitree.inspected(sources).persist()
    tracks, packets = {}, {}
    for r in avitree.tracks(found).orderBy("track_id").collect():
        tracks.setdefault(int(r.source_id), []).append((r.track_id, r.kind, r.codec_id, r.time_scale, int(r.duration_ticks), r.codec_name))
    rows = avitree.packets(found)
    for r in rows.orderBy("source_id", "seq").collect():
        packets.setdefault(int(r.source_id), []).append((r.byte_offset, r.byte_size, r.track_id, int(r.timestamp_ticks), r.duration_ticks, r.flags))
    codes = {int(r.source_id): r.code for r in boxtree.statuses(found, rows).collect()}
    good = 0
    for k, d in enumerate(data):
        own = media.inspect(d or b"")
        assert tracks.get(k, []) == (own[2] if own[0] == 0 and own[1] == S.AVI else []), k
        status, container, _, want = media.index(d or b"")
        if container not in (0, S.AVI):
            status, want = S.UNSUPPORTED, []
        assert (codes[k], packets.get(k, [])) == (status, want if status == 0 else []), k
        good += status == 0
    assert good > 40
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found.unpersist()


def test_a_file_is_walked_once(monkeypatch):
    """Tracks and packets of an AVI file come from one walk of its chunks, and broken files stay broken when asked again."""
    calls, chunks = [], riff.chunks
    monkeypatch.setattr(riff, "chunks", lambda data, at, end: calls.append(at) or chunks(data, at, end))
    data = encode.avi([(b"00dc", b"walked once"), (b"01wb", b"ab"), (b"00dc", b"x")], audio=True)
    status, container, tracks, packets = media.index(data)
    assert (status, container, len(tracks), calls.count(12)) == (0, 4, 2, 1)
    assert [data[p[0] : p[0] + p[1]] for p in packets] == [b"walked once", b"ab", b"x"] and [p[3] for p in packets] == [0, 0, 1]
    assert [media.index(data[:-1])[0] for _ in range(2)] == [media.S.UNSUPPORTED] * 2
