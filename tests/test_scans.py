"""Scans against the machines replayed event by event, and a key that holds most rows, cut into pieces."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import machines, replay, scans, timeline

SCHEMA = "session bigint, seq bigint, kind string, generation bigint, state int, playback int, background int, output int, flags int, command int"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(8)
    rows = []
    for seq in range(6000):
        session = 7 if rng.random() < 0.9 else rng.choice([0, 1, 2, 3])
        kind = rng.choices(["bind", "clear", "surface", "playback", "other"], [3, 1, 6, 6, 1])[0]
        odd = rng.random() < 0.1
        rows.append((session, seq, kind, rng.choice([0, 1, 2, 3] if odd else [1, 2]), rng.choice([1, 2, 3, 3, 0 if odd else 3]), rng.choice([1, 2, 2, 2, 2]), rng.choice([0, 1, 1]), rng.choice([0, 1, 1, 1]), rng.choice([0, 3, 15, 15, 16 if odd else 15]), rng.choice([1, 1, 2, 5 if odd else 1])))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    got, want = (sorted(tuple(r) for r in d.select(sorted(a.columns)).collect()) for d in (a, b))
    assert got == want


PIECED = [{"large": None}, {"least": 100, "pieces": 40}]


@pytest.mark.parametrize("options", PIECED, ids=["whole", "pieces"])
def test_lifecycle(events, options):
    same(scans.lifecycle(events, "session", "seq", **options), replay.replay(events, machines.Lifecycle(), "session", ["seq"]))


@pytest.mark.parametrize("options", PIECED, ids=["whole", "pieces"])
@pytest.mark.parametrize("lock", [True, False])
def test_owner(events, options, lock):
    same(scans.owner(events, "session", "seq", lock, **options), replay.replay(events, machines.Owner(lock), "session", ["seq"]))


def test_one_owner_of_many_sessions(events):
    """Sessions take over from each other."""
    all_of_one = events.withColumn("device", F.lit(1).cast("bigint")).withColumn("session", F.when(F.col("seq") % 7 == 0, 3).otherwise(F.col("session")).cast("bigint"))
    want = replay.replay(all_of_one, machines.Owner(True), "device", ["seq"])
    same(scans.owner(all_of_one, "device", "seq", True, least=100, pieces=60), want)


@pytest.mark.parametrize("options", PIECED, ids=["whole", "pieces"])
def test_clock(events, options):
    e = events.select("session", "seq", F.element_at(F.array(*map(F.lit, ("position", "rate", "pause", "resume", "none"))), (F.col("seq") * 31 % 5 + 1).cast("int")).alias("kind"), (F.col("seq") * 17 % 6000 - 100).alias("value"))
    same(scans.clock(e, "session", "seq", **options), replay.replay(e, machines.Clock(), "session", ["seq"]))


def test_no_task_sees_much_of_a_hot_key(spark):
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).cast("bigint").alias("session"), F.col("id").alias("seq"))
    large = timeline.large_sources(rows, "session", 1000)
    cut = timeline.in_pieces(rows, large, "seq")
    assert cut.groupBy("session", "_piece").count().agg(F.max("count")).first()[0] <= n / 500
    plan = timeline.running(rows, "session", ["seq"], {"s": F.lit(1)}, least=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan


def test_running_maxima_over_pieces(spark):
    rng = random.Random(2)
    rows = [(s, k, rng.choice([None, rng.randrange(1000)])) for s in (1, 2) for k in range(700)]
    df = spark.createDataFrame(rows, "s int, k int, v int")
    for options in ({"large": None}, {"least": 50, "pieces": 13}):
        got = timeline.running(df, "s", ["k"], {"sum": F.col("v")}, latest={"now": F.col("v")}, earlier={"past": F.col("v")}, **options).collect()
        by = {(r.s, r.k): r for r in got}
        for s in (1, 2):
            top, total = None, 0
            for k in range(700):
                r = by[s, k]
                assert r.past == top and r["sum"] == total
                v = r.v
                top = v if top is None else top if v is None else max(top, v)
                total += v or 0
                assert r.now == top
