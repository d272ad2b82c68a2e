"""Policy and state machines: Spark expressions, batch replay, streams and plain Python agree."""

import itertools

import pytest

from lodestream.operators import machines, policy, replay
from lodestream.streaming import processors


def test_policy_over_all_inputs(spark):
    cases = list(itertools.product((0, 1, 2, 3, 4), (0, 1, 2, 3), (0, 1, 2), (0, 1, 2), (0, 1, 6, 15, 16), (0, 9)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "state int, playback int, background int, output int, flags int, generation int")
    got = policy.decision(*(F.col(k) for k in machines.POLICY))
    for r in df.select("*", *(c.alias(k) for k, c in got.items())).collect():
        assert tuple(r)[6:] == machines.decide(*tuple(r)[:6])


def event(**k):
    return {"session": 5, "generation": 2, "state": 3, "playback": 2, "background": 1, "output": 1, "flags": 15, "command": 1, "kind": "bind"} | k


def run(machine, events):
    state = dict(machine.START)
    return [machine.step(state, e) for e in events]


def test_owner_reconciles():
    calls = []
    lock = machines.Owner(True, lambda e: calls.append("show") or True, lambda e: calls.append("clear") or True)
    got = [r[0] for r in run(lock, [event(), event(), event(command=2), event(generation=1), event(generation=3), event(session=6), event(playback=1), event(command=9)])]
    assert got == [1, 1, 1, -1, 1, 1, 0, -1]
    assert calls == ["show", "show", "clear", "show", "clear", "show", "clear"]


def test_a_stale_denial_still_clears():
    got = run(machines.Owner(False), [event(generation=5), event(generation=1, playback=1)])
    assert [r[:2] for r in got] == [(1, 1), (0, 0)]


def test_failed_callbacks_stay_pending():
    fail = {"undo": True}
    owner = machines.Owner(True, undo=lambda e: not fail["undo"])
    state = dict(owner.START)
    assert owner.step(state, event())[:3] == (1, 1, 0)
    assert owner.step(state, event(playback=1))[:3] == (-1, 1, 1)
    assert owner.step(state, event(generation=4))[:3] == (-1, 1, 1)
    fail["undo"] = False
    assert owner.step(state, event(generation=4))[:5] == (1, 1, 0, 5, 4)
    failing = machines.Owner(True, act=lambda e: False)
    assert run(failing, [event()])[0][:3] == (-1, 0, 0)


def test_lifecycle():
    m = machines.Lifecycle()
    got = run(m, [event(kind="playback"), event(kind="bind"), event(kind="playback"), event(kind="surface", state=3), event(kind="surface", state=1, generation=1), event(kind="clear"), event(kind="bind", background=0), event(kind="surface", state=2), event(kind="bind", flags=16)])
    assert [r[0] for r in got] == [0, 1, 1, 1, 0, 1, 1, 0, 0]
    assert got[3][2:] == (1, 1, 1, 0) and got[1][5] == policy.R_PAUSED and got[5][1] == 0


def test_player_and_clock():
    p = machines.Player(10.0, 20)
    ev = lambda kind, value=0: {"kind": kind, "value": value}
    got = run(p, [ev("update", 500), ev("play"), ev("update", 500), ev("update", 5000), ev("loop", 1), ev("update", 100), ev("seek", 99), ev("stop")])
    assert [(r[0], r[1]) for r in got] == [(0, 0), (0, 0), (500, 5), (5500, 19), (5500, 0), (0, 0), (1900, 19), (0, 0)]
    c = run(machines.Clock(), [ev("position", 7), ev("rate", 4001), ev("rate", 4000), ev("resume"), ev("other")])
    assert [r[0] for r in c] == [1, 0, 1, 1, 0] and c[-1][1:] == (7, 4000, 0)


EVENTS = [(k % 3 + 1, k, ["bind", "playback", "surface", "playback", "clear"][k * 7 % 5], k % 2 + 1, k % 3 + 1, k % 2 + 1, int(k % 4 > 0), int(k % 5 > 0), k % 16, k % 4 + 1) for k in range(120)]
SCHEMA = "session bigint, seq bigint, kind string, generation int, state int, playback int, background int, output int, flags int, command int"


@pytest.mark.parametrize("machine", [machines.Lifecycle(), machines.Owner(True), machines.Owner(False)], ids=["lifecycle", "lock", "power"])
def test_batch_replay(spark, machine):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    got = {r["seq"]: tuple(r)[2:] for r in replay.replay(df, machine, "session", ["seq"]).collect()}
    states, names = {}, [f.split(" ")[0] for f in SCHEMA.split(", ")]
    for e in EVENTS:
        state = states.setdefault(e[0], dict(machine.START))
        assert got[e[1]] == machine.step(state, dict(zip(names, e, strict=True)))


def test_stream_agrees_with_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(EVENTS[40 * k : 40 * k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = processors.run_machine(stream, machines.Lifecycle())
    q = out.writeStream.format("memory").queryName("decisions").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.table("decisions").collect())
    want = sorted(tuple(r) for r in replay.replay(spark.createDataFrame(EVENTS, SCHEMA), machines.Lifecycle(), "session", ["seq"]).collect())
    assert got == want


def test_decisions_reach_a_sink(spark, tmp_path):
    spark.createDataFrame(EVENTS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    seen = {}
    q = processors.reconcile(processors.run_machine(stream, machines.Owner(False)), lambda batch, k: seen.setdefault(k, sorted(map(tuple, batch.collect()))), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sorted(tuple(r) for r in replay.replay(spark.createDataFrame(EVENTS, SCHEMA), machines.Owner(False), "session", ["seq"]).collect())
    assert sorted(r for k in seen.values() for r in k) == want


def test_resampling_over_spans(spark):
    from lodestream.functions import codecs

    rows = [("a", k, c, (k * 37 + c * 11) % 200 - 100) for k in range(50) for c in range(2)]
    df = spark.createDataFrame(rows, "source_id string, frame bigint, channel int, value int")
    for rate, wanted in ((8, 8), (8, 11), (11, 4), (1, 3)):
        want = []
        for c in range(2):
            v = [r[3] for r in rows if r[2] == c]
            for j in range(-(-50 * wanted // rate)):
                k, rest = divmod(j * rate, wanted)
                d = (v[min(k + 1, 49)] - v[k]) * rest
                want.append(("a", j, c, v[k] + (abs(d) // wanted) * (1 if d >= 0 else -1)))
        assert sorted(map(tuple, codecs.resampled(df, rate, wanted, span=8).collect())) == sorted(want)
