"""The prefix forest: recall against brute force, exact scores and ties, rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import prefixforest as pf

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, nearest=20, every=20):
    """By query row: the right list of (vec_id, score)."""
    out = []
    for k, (i, v) in enumerate(rows):
        if i % every == 0:
            others = [(j, float(np.dot(np.float64(v), np.float64(w)))) for n, (j, w) in enumerate(rows) if n != k and len(w) == len(v)]
            out.append((i, sorted(others, key=lambda x: (-x[1], x[0]))[:nearest]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def unit(seed, n, d):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("kind", ["random", "unequal norms", "clusters", "copies"])
def test_recall_and_scores(spark, kind):
    n, d = 6000, 32
    v = unit(1, n, d)
    if kind == "unequal norms":
        v *= np.random.default_rng(2).lognormal(0, 0.7, n).astype(np.float32)[:, None]
    elif kind == "clusters":
        v = (v[np.arange(n) % 40] + 0.2 * unit(3, n, d)).astype(np.float32)
    elif kind == "copies":
        v[::3] = v[0]
    rows = list(enumerate(v))
    got = found(pf.nearest_neighbours(frame(spark, rows).repartition(6), block=2500))
    hits = total = 0
    for q, want in brute(rows):
        have = got[q]
        assert [r for r, _, _ in have] == list(range(1, 21)) and q not in [i for _, i, _ in have]
        assert [(-s, i) for _, i, s in have] == sorted((-s, i) for _, i, s in have)
        for _, i, s in have:
            assert s == pytest.approx(float(np.dot(np.float64(v[q]), np.float64(v[i]))), rel=1e-12, abs=1e-15)
        if kind == "copies" and q % 3 == 0:
            assert [i for _, i, _ in have] == [i for i in range(0, 66, 3) if i != q][:20]  # the copies of smallest ids
        hits += len({i for _, i, _ in have} & {i for i, _ in want})
        total += len(want)
    assert hits / total >= 0.93


def test_few_rows_are_exact(spark):
    rows = [(k, [k % 7 - 3.5, k % 5 - 2.0, 1.0]) for k in range(30)]
    got = found(pf.nearest_neighbours(frame(spark, rows)))
    for q, want in brute([(i, np.float32(v)) for i, v in rows]):
        assert [(i, s) for _, i, s in got[q]] == [(i, pytest.approx(s)) for i, s in want]


def test_rows_that_take_no_part(spark):
    good = [(0, [1.0, 2.0]), (20, [-1.0, 0.5]), (40, [2.0, 2.0]), (3, [0.5, 0.5]), (60, [1.0, 0.0, 0.0]), (61, [0.0, 1.0, 1.0]), (-20, [3.0, 1.0])]
    bad = [(80, None), (100, [0.0, 0.0]), (120, [1.0, None]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (180, []), (None, [1.0, 1.0])]
    got = found(pf.nearest_neighbours(frame(spark, good + bad)))
    want = {q: w for q, w in brute([(i, np.float32(v)) for i, v in good])}
    assert set(got) == set(want) == {0, 20, 40, 60, -20}
    for q in want:
        assert [(i, s) for _, i, s in got[q]] == [(i, pytest.approx(s)) for i, s in want[q]]
    assert pf.nearest_neighbours(frame(spark, [])).count() == 0
    assert pf.nearest_neighbours(frame(spark, bad)).count() == 0


def test_repeated_rows_ties_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 1.0]), (0, [0.0, 1.0])]
    df = frame(spark, rows).withColumns({n: F.lit("x") for n in ("a", "b", "v", "block", "rank", "score", "ids", "query_id", "at")})
    got = pf.nearest_neighbours(df).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rank):
        lists.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(lists[0]) == sorted([(1, 0, 1.0), (2, 5, 1.0), (3, 0, 0.0), (4, 7, 0.0)] * 2 + [(1, 7, 1.0), (2, 0, 0.0), (3, 0, 0.0), (4, 5, 0.0)])


def test_ascent_ends_at_the_root(spark):
    forest = pf.Forest(unit(5, 200, 8).astype(float), [[k] for k in range(200)], 20)
    forest.enough = 10**9
    q = unit(6, 1, 8).astype(float)
    assert [i for _, i in next(forest.search(q))] == np.argsort(-(forest.v @ q[0]), kind="stable")[:21].tolist()
