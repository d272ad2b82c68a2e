"""The seek index against a plain search, over wide gaps, ties and odd requests."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from lodestream import status as S
from lodestream.operators import seeking

PACKETS = "src string, track int, n bigint, ts bigint, key boolean, at bigint"
REQUESTS = "id bigint, src string, track int, ms bigint, scale bigint"


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(3)
    rows = []
    for src, track, n, step in (("a", 1, 400, 40), ("a", 2, 50, 1_000_000_007), ("b", 1, 30, 2**57), ("c", 1, 3000, 1)):
        t = 0 if src != "b" else 2**61
        for k in range(n):
            rows.append((src, track, k, t, k % 13 == 5 or rng.random() < 0.05, 7 * k))
            t += rng.randrange(0, step) if src != "b" else 2**56
    rows += [("d", 1, 0, 5, True, 0), ("d", 1, 1, 5, True, 1), ("d", 1, 2, 5, False, 2), ("d", 1, 3, None, True, 3), ("e", 1, 0, 9, False, 0)]
    return rows


def plain(rows, src, track, t):
    mine = sorted((r[3], r[2]) for r in rows if r[:2] == (src, track) and r[3] is not None)
    keys = sorted((r[3], r[2], r[5]) for r in rows if r[:2] == (src, track) and r[3] is not None and r[4])
    k, m = (bisect_right([x[0] for x in found], t) for found in (keys, mine))
    return (keys[k - 1], mine[m - 1][1] - keys[k - 1][1], t - keys[k - 1][0]) if k else None


def test_seek(spark, packets):
    rng = random.Random(4)
    by = {}
    for r in packets:
        if r[3] is not None:
            by.setdefault(r[:2], []).append(r[3])
    asked = []
    for (src, track), times in by.items():
        picks = [*rng.sample(times, min(len(times), 25)), min(times), max(times), max(times) + 5000, 0, *(rng.randrange(0, max(times) + 1) for _ in range(25))]
        asked += [(src, track, t) for t in picks] + [(src, track, max(t - 1, 0)) for t in picks]
    requests = [(k, s, tr, t, 1000) for k, (s, tr, t) in enumerate(asked)]  # a scale of 1000: a tick is a millisecond
    odd = [(-1, "a", 1, -5, 1000), (-2, "a", 1, None, 1000), (-3, "a", 1, 2**62, 90_000), (-4, "a", 1, 5, 0), (-5, "zz", 1, 5, 1000), (-6, "a", None, 5, 1000)]
    df = spark.createDataFrame(packets, PACKETS).repartition(4)
    got = {r.id: r for r in seeking.seek(spark.createDataFrame(requests + odd, REQUESTS), df, "ms", "scale", ["id"], ["src", "track"], "ts", "n", F.col("key"), ["at"]).collect()}
    assert len(got) == len(requests) + len(odd)
    for k, s, tr, t, _ in requests:
        want, r = plain(packets, s, tr, t), got[k]
        assert r.ticks == t
        if want is None:
            assert r.seek_status == S.UNSUPPORTED and r.start is None and r.discard_packets is None
        else:
            assert (r.seek_status, (r.start.time, r.start.n, r.start.at), r.discard_packets, r.discard_ticks) == (S.OK, *want)
    assert {k: got[k].seek_status for k in range(-6, 0)} == {-1: -1, -2: -1, -3: -1, -4: -1, -5: -2, -6: -2}


def test_ticks(spark):
    cases = [(1, 90_000, 90), (1, 44_100, 44), (5, 100, 1), (4, 100, 0), (0, 1, 0), (2**62, 1000, 2**62)]
    df = spark.createDataFrame([c[:2] for c in cases], "a bigint, b bigint")
    assert [r[0] for r in df.select(seeking.ticks_at(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_lists_are_bounded_and_requests_meet_buckets(spark, packets):
    index = seeking.time_index(spark.createDataFrame(packets, PACKETS), ["src", "track"], "ts", ["n"])
    sizes = {r.level: r.most for r in index.groupBy("level").agg(F.max(F.size("entries")).alias("most")).collect()}
    assert set(sizes) == set(range(seeking.LEVELS)) and all(n <= 2**seeking.STEP for k, n in sizes.items() if k < seeking.LEVELS - 1)
    asked = spark.createDataFrame([(k, "c", 1, k, 1000) for k in range(500)], REQUESTS).withColumn("ticks", F.col("ms"))
    plan = seeking.look_back(asked, index, ["src", "track"], "ticks", ["id"], "start")._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # rows that meet: at most one a level and request
    assert asked.count() * seeking.LEVELS >= asked.select("id").join(index.where("src = 'c'"), F.lit(True)).select("id", "level", "bucket").groupBy("id", "level").count().count()
