"""Resampling, the pump and frame conversion, each against a version of its own."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream import status as S
from lodestream.operators import frames, resample
from lodestream.streaming import pump

# --- resampling ---


def weigh(u, rate, wanted):
    far = 16 * max(1, rate / wanted)
    if abs(u) >= far:
        return 0.0
    c = min(1, wanted / rate)
    s = 1.0 if u == 0 else math.sin(math.pi * c * u) / (math.pi * c * u)
    return c * s * (1 + math.cos(math.pi * u / far)) / 2


def plainly(x, rate, wanted):
    far = math.ceil(16 * max(1, rate / wanted))
    out, flush = [], []
    for j in range(-(-len(x) * wanted // rate)):
        t = j * rate / wanted
        near = range(math.floor(t) - far, math.floor(t) + far + 1)
        total = sum(weigh(t - i, rate, wanted) for i in near)
        out.append(max(-32768, min(32767, sum(weigh(t - i, rate, wanted) * (x[i] if 0 <= i < len(x) else 0) for i in near) / total)))
        flush.append(math.floor(t) + far >= len(x))
    return out, flush


def sample_rows(spark, sources):
    rows = [(s, k, c, int(v)) for s, channels in sources.items() for c, x in enumerate(channels) for k, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "source_id string, frame bigint, channel int, value int").repartition(5)


@pytest.mark.parametrize(("rate", "wanted"), [(8000, 11_025), (44_100, 16_000), (48_000, 48_000), (3, 2)])
def test_resampling_equals_the_plain_sum(spark, rate, wanted):
    rng = random.Random(2)
    sources = {"a": [[rng.randrange(-32768, 32768) for _ in range(400)] for _ in range(2)], "b": [[32767] * 5], "c": [[100]]}
    found = {}
    for span in (resample.SPAN, resample.delay(rate, wanted)):
        rows = resample.resampled(sample_rows(spark, sources), rate, wanted, span).orderBy("frame").collect()
        found[span] = sorted(tuple(r) for r in rows)
        for s, channels in sources.items():
            for c, x in enumerate(channels):
                mine = [r for r in rows if r.source_id == s and r.channel == c]
                want, flush = plainly(x, rate, wanted)
                assert [r.frame for r in mine] == list(range(len(want))) and [r.flush for r in mine] == flush
                assert all(abs(r.value - w) <= 0.5 + 1e-6 for r, w in zip(mine, want, strict=True))
    a, b = found.values()
    assert a == b


def test_a_tone_keeps_its_pitch_and_level(spark):
    rate, wanted, pitch = 8000, 11_025, 440
    x = [round(20_000 * math.sin(2 * math.pi * pitch * k / rate)) for k in range(4000)]
    rows = resample.resampled(sample_rows(spark, {"t": [x]}), rate, wanted, 512).where("frame between 200 and 5000").collect()
    assert max(abs(r.value - 20_000 * math.sin(2 * math.pi * pitch * r.frame / wanted)) for r in rows) < 30
    assert resample.resampled(sample_rows(spark, {"t": [x]}).limit(0), rate, wanted).count() == 0
    with pytest.raises(ValueError, match="span"):
        resample.resampled(sample_rows(spark, {"t": [x]}), rate, wanted, 4)


# --- pump ---

PACKETS = "source_id string, seq bigint, samples binary, time timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def packet_rows():
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 60), ("b", 7), ("c", 1), ("e", 3)):
        for k in range(n):
            rows.append((s, k, bytearray(rng.randbytes(4 * rng.choice([0, 1, 5, 64, 150]))), START + timedelta(milliseconds=len(rows))))
    return rows


def shown(rows):
    return sorted((r.source_id, r.frame_index, r.n_samples, None if r.samples is None else bytes(r.samples), r["last"], r.status) for r in rows)


@pytest.mark.parametrize("borders", [[], [1, 2, 3, 50, 51], [10, 30, 60]], ids=len)
def test_stream_of_packets_equals_batch_for_any_borders(spark, tmp_path, borders):
    rows = packet_rows()
    rows = [r for r in rows if not (r[0] == "e" and r[1] == 1)]  # a packet of e never comes
    mixed = rows[:]
    random.Random(4).shuffle(mixed)
    mixed += mixed[:3]  # again
    for k, (low, high) in enumerate(zip([0, *borders], [*borders, len(mixed)], strict=True)):
        spark.createDataFrame(mixed[low:high], PACKETS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    far = [("z", 0, bytearray(4), START + timedelta(hours=1))]
    spark.createDataFrame(far, PACKETS).coalesce(1).write.parquet(f"{tmp_path}/in/late")
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    # packets come in any order: the watermark waits for a minute
    found = pump.pump(stream, 64, 5_000, "1 minute")
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").where("source_id <> 'z'").collect()
    want = pump.pumped(spark.createDataFrame(mixed, PACKETS).repartition(4), 64).collect()
    assert shown(got) == shown(want)
    ends = {r.source_id: (r.frame_index, r.status) for r in want if r["last"]}
    total = {s: sum(len(r[2]) // 4 for r in rows if r[0] == s) for s in "abce"}
    assert ends == {s: (-(-n // 64), S.MALFORMED if s == "e" else S.OK) for s, n in total.items()}
    for s in "ab":
        assert b"".join(bytes(r.samples) for r in sorted((r for r in want if r.source_id == s and not r["last"]), key=lambda r: r.frame_index)) == b"".join(bytes(r[2]) for r in rows if r[0] == s)


# --- frames ---


def test_tiles_equal_the_whole_and_a_plain_version(spark):
    rng = random.Random(5)
    made = []
    for form in ("bgra", "i420", "nv12"):
        for k, (w, h) in enumerate(((37, 23), (64, 10), (1, 1))):
            made.append((form, k, w, h, bytearray(rng.randbytes(frames.expected_bytes(w, h, form)))))
    made += [("bgra", 8, 4, 4, bytearray(5)), ("bgra", 9, 0, 4, bytearray()), ("bgra", 10, 4, 4, None), ("bgra", 11, 5000, 1, bytearray(20_000))]
    df = spark.createDataFrame(made, "source_id string, frame_index bigint, width int, height int, pixels binary").repartition(3)
    for form in ("bgra", "i420", "nv12"):
        own = df.where(F.col("source_id") == form)
        for size in ((None, None), (20, 31), (100, 7)):
            whole, cut = (sorted(tuple(r) for r in frames.assembled(frames.tiles(own, *size, form=form, tile=t)).where("frame_status = 0").collect()) for t in (4096, 9))
            assert whole == cut and len(whole) == 3
            for _, k, _, w, h, pixels in whole:
                _, _, w0, h0, data = next(m for m in made if m[0] == form and m[1] == k)
                old = plain_bgra(bytes(data), w0, h0, form)
                assert (w, h) == (size[0] or w0, size[1] or h0)
                got = np.frombuffer(pixels, np.uint8).reshape(h, w, 4)
                for x, y in {(0, 0), (w - 1, h - 1), (w // 2, h // 3), (w // 3, h // 2)}:
                    assert np.abs(got[y, x] - plain_pixel(old, x, y, w, h)).max() <= 0.5 + 1e-9
    codes = {r.frame_index: r.frame_status for r in frames.assembled(frames.tiles(df.where("source_id = 'bgra'"))).collect()}
    assert codes == {0: 0, 1: 0, 2: 0, 8: S.INVALID, 9: S.INVALID, 10: S.INVALID, 11: S.INVALID}


def plain_bgra(data, w, h, form):
    out = np.zeros((h, w, 4))
    half = -(-w // 2)
    for y in range(h):
        for x in range(w):
            if form == "bgra":
                out[y, x] = list(data[4 * (y * w + x) : 4 * (y * w + x) + 4])
                continue
            at = y // 2 * half + x // 2
            base, planes = w * h, half * -(-h // 2)
            u, v = (data[base + at], data[base + planes + at]) if form == "i420" else (data[base + 2 * at], data[base + 2 * at + 1])
            c, d, e = data[y * w + x] - 16, u - 128, v - 128
            out[y, x] = [max(0, min(255, n >> 8)) for n in (298 * c + 516 * d + 128, 298 * c - 100 * d - 208 * e + 128, 298 * c + 409 * e + 128)] + [255]
    return out


def plain_pixel(old, x, y, w, h):
    def line(at, n, m):
        s = max(1.0, n / m)
        c = (at + 0.5) * n / m - 0.5
        found = {k: 1 - abs(k - c) / s for k in range(n) if abs(k - c) < s}
        return {k: v / sum(found.values()) for k, v in found.items()}

    across, down = line(x, old.shape[1], w), line(y, old.shape[0], h)
    return sum(a * b * old[j, i] for i, a in across.items() for j, b in down.items())
