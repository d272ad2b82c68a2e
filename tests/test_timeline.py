"""Running sums, ranks and looks back over split sources against plain Python, whatever the pieces."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestream.operators import timeline


def packets(n):
    """A hot source with two thirds of the rows, small ones, and rows of no source; orders with ties, nulls and outliers."""
    r = random.Random(5)
    orders = [None, -(2**60), *(r.randrange(n) for _ in range(n - 3)), 2**60]
    return [(r.choice(["hot", "hot", "hot", "hot", "a", None]), o, k, r.randrange(50), r.choice([None, 1, 2, 3])) for k, o in enumerate(orders)]


@pytest.mark.parametrize(("least", "pieces"), ((1000, 7), (0, 1), (0, 2), (150, 7), (70, 7), (0, 1024)))
def test_running(spark, least, pieces):
    rows = packets(400)
    df = spark.createDataFrame(rows, "src string, at bigint, k int, size int, dur int")
    got = timeline.running(df, "src", ["at", "k"], {"n": F.lit(1), "due": F.col("dur")}, {"last": F.col("size") + F.col("dur")}, least, pieces)
    assert got.columns == [*df.columns, "n", "due", "last"]
    want = []
    for src in {r[0] for r in rows}:
        n, due, last = 0, 0, None
        for row in sorted((r for r in rows if r[0] == src), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            want.append((*row, n, due, last))
            n, due, last = n + 1, due + (row[4] or 0), None if row[4] is None else row[3] + row[4]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_odd_orders(spark):
    empty = spark.createDataFrame([], "src string, at bigint, dur bigint")
    assert timeline.timestamps(empty, "src", "at", "dur").count() == 0
    inf = float("inf")
    for kind, orders in (("double", [-inf, -1.5, 0.0, inf, float("nan")]), ("string", ["10", "9", "x"]), ("decimal(20,0)", [1, 2**63, 2**63 + 1]), ("bigint", [None, 4])):
        rows = [("s", Decimal(o) if "decimal" in kind else o, 10**k) for k, o in enumerate(orders)]
        df = spark.createDataFrame(rows, f"src string, at {kind}, dur bigint")
        got = timeline.running(df, "src", ["at"], {"due": F.col("dur")}, least=0).orderBy("dur").collect()
        assert [r["due"] for r in got] == [(10**k - 1) // 9 for k in range(len(orders))]


def test_no_task_sees_a_large_source(spark):
    df = spark.range(10_000).selectExpr("if(id % 10 < 7, 'hot', string(id)) src", "id * id at")
    large = timeline.large_sources(df, "src", 1000)
    assert {r["src"] for r in df.where(large).collect()} == {"hot"} and timeline.large_sources(df, "src", 7000) is None
    sizes = {r["_piece"]: r["count"] for r in timeline.in_pieces(df, large, "at", 16).groupBy("_piece").count().collect()}
    assert sizes.pop(0) == 3000 and len(sizes) == 16 and max(sizes.values()) < 1000


def test_orphans_are_counted_once_a_packet(spark):
    p = spark.createDataFrame([("a", 1)] * 3 + [("b", 1), ("b", 9), ("c", None)], "src string, track int")
    t = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1)], "src string, track int")
    assert {tuple(r) for r in timeline.reject_orphans(p, t, "src", "track").collect()} == {("a", 0, 3), ("b", -2, 0), ("c", -2, 0)}
