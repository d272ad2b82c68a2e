"""Counts against a plain version; rules and trees on labels they can and cannot learn."""

import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import boosting, decision_list, docstats

from .conftest import prose, table_of


def plain_counts(text):
    if text is None:
        return 0, 0, 0, 0, 0
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    inside, seen = set(), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            inside |= {p + k for p in places for k in range(8)}
    lines = text.split("\n")
    again = sum(line in lines[:k] for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\t#| ", max_size=120))
def test_counts(text):
    assert docstats.counts(text.encode())[:5] == plain_counts(text)


def labelled(spark, docs):
    junk = [(1000 + k, " | ".join(prose(k, 40).split()), "en", "s", 1) for k in range(60)]
    more = docs.unionAll(spark.createDataFrame(junk, docs.schema))
    labels = [(k, 1) for k in range(60)] + [(1000 + k, 0) for k in range(60)] + [(3, None), (None, 0), (5, 7), (999_999, 0)]
    return more, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_rules(spark, docs, rows):
    more, labels = labelled(spark, docs)
    got = decision_list.quality_rules(more, labels)
    assert table_of(got.where("doc_id is null or doc_id < 1000"), "doc_id", *docstats.COUNTS[:5]) == sorted(((r[0], *plain_counts(r[1])) for r in rows), key=repr)
    for r in got.collect():
        base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == base and (not base or not r["kept"])
        if r["doc_id"] is not None and (r["doc_id"] < 60 or r["doc_id"] >= 1000):
            assert r["kept"] == (r["doc_id"] < 60)


def test_rule_list_is_ordered_and_pruned():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = decision_list.learn(x, bad, ["a", "b", "c"])
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= decision_list.covered(r, x, ["a", "b", "c"])
    assert (got == bad).mean() > 0.97 and 2 <= len(rules) <= 8
    assert decision_list.learn(x, np.zeros(len(x), bool), ["a", "b", "c"]) == []


def test_trees(spark, docs):
    more, labels = labelled(spark, docs)
    got = {r["doc_id"]: r for r in boosting.classify(more, labels).collect() if r["doc_id"] is not None}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    assert all(got[k]["predicted"] == 1 for k in range(60)) and all(got[1000 + k]["predicted"] == 0 for k in range(60))


def test_flattened_walk_equals_a_walk_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=400) < 0.05)).astype(float)
    m = boosting.fit(x, y)
    for row in x[:50]:
        total = m.start
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            at = 0
            for _ in range(boosting.DEPTH):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        assert abs(m.margin(row[None, :])[0] - total) < 1e-9
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_nothing_to_learn_from(spark, docs, nothing, clashing):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in boosting.classify(docs, none).collect()} == {0.5}
    assert decision_list.quality_rules(docs, none).where("rule is not null").count() == 0
    assert decision_list.quality_rules(nothing, none).count() == boosting.classify(nothing, none).count() == 0
    assert boosting.classify(clashing, none).count() == decision_list.quality_rules(clashing, none).count() == docs.count()
    random.seed(0)


def test_the_sample_has_as_many_rows_as_there_are(spark):
    """Far more labels than documents; ids labelled both ways, repeated labels and repeated documents."""
    stats = spark.range(3000).selectExpr("id * 100 doc_id", "cast(id as double) x").unionAll(spark.sql("select 500L, 5.0D"))
    labels = spark.range(300_000).selectExpr("id doc_id", "cast(id % 2 as int) quality").unionAll(spark.sql("select 700L, 1")).unionAll(spark.sql("select 500L, 0"))
    rows = [tuple(r) for r in docstats.labelled_sample(stats, labels, "quality", 2000, ["x"]).collect()]
    assert len(rows) == 2000 == docstats.labelled_sample(stats, labels, "quality", 2000, ["x"]).count()
    every = sorted(tuple(r) for r in docstats.labelled_sample(stats, labels, "quality", 20_000, ["x"]).collect())
    assert every == sorted([(float(k), 0) for k in range(3000)] + [(5.0, 0), (7.0, 1)])
    assert set(rows) <= set(every)


def plain_trees(x, y, trees):
    """Boosting node by node: the best of all (feature, edge) by the same gain, in plain loops; margins of the rows."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, boosting.BINS + 1)[1:-1])).tolist() for j in range(x.shape[1])]
    p = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), float(np.log(p / (1 - p))))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        step = np.zeros(len(y))

        def grow(rows, depth, g=g, h=h, step=step):
            if depth == boosting.DEPTH:
                step[rows] = -boosting.RATE * g[rows].sum() / (h[rows].sum() + boosting.SHRINK)
                return
            best, pick = 1e-6, None
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + boosting.SHRINK)
            for j, cuts in enumerate(edges):
                for c in cuts:
                    low, high = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if h[low].sum() >= boosting.LEAST and h[high].sum() >= boosting.LEAST:
                        gain = worth(low) + worth(high) - worth(rows)
                        if gain > best + 1e-9:
                            best, pick = gain, (low, high)
            for part in pick or (rows,):
                grow(part, depth + 1 if pick else boosting.DEPTH)

        grow(np.arange(len(y)), 0)
        margin = margin + step
    return margin


def test_fitted_trees_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(boosting, "TREES", 4)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] + x[:, 1] ** 2 > 0.5) ^ (rng.uniform(size=300) < 0.1)).astype(float)
    assert np.allclose(boosting.fit(x, y).margin(x), plain_trees(x, y, 4))


def plain_rules(x, bad, names):
    """Sequential covering with every threshold tried in loops (fewer distinct values than CUTS)."""
    rules = []
    while len(rules) < decision_list.MAX_RULES and bad.sum() >= 6 and (~bad).any():
        prune = np.arange(len(x)) % 3 == 2
        gx, gb = x[~prune], bad[~prune]
        rule, live = [], np.ones(len(gx), bool)
        while len(rule) < decision_list.MAX_CONDITIONS and (live & ~gb).any():
            p0, n0 = (live & gb).sum(), (live & ~gb).sum()
            best, pick = 1e-9, None
            for j, name in enumerate(names):
                values = sorted(set(gx[live, j].tolist()))
                for above in (False, True):
                    for a, b in zip(values, values[1:], strict=False):
                        c = decision_list.Condition(name, above, (a + b) / 2)
                        got = live & c.holds(gx, names)
                        p, n = (got & gb).sum(), (got & ~gb).sum()
                        if p:
                            gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                            if gain > best + 1e-12:
                                best, pick = gain, c
            if pick is None:
                break
            rule.append(pick)
            live &= pick.holds(gx, names)
        if not rule:
            break
        scored = []
        for k in range(len(rule), 0, -1):
            got = decision_list.covered(rule[:k], x[prune], names)
            p, n = (got & bad[prune]).sum(), (got & ~bad[prune]).sum()
            scored.append(((p - n) / (p + n) if p + n else -1.0, k))
        worth, k = max(scored, key=lambda s: (s[0], -s[1]))
        got = decision_list.covered(rule[:k], x, names)
        if (worth + 1) / 2 < decision_list.PRECISION or not (got & bad).any():
            break
        rules.append(rule[:k])
        x, bad = x[~got], bad[~got]
    return rules


def test_learned_rules_equal_a_plain_version():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    bad = ((x[:, 0] > 8) | ((x[:, 1] < 3) & (x[:, 2] > 6))) ^ (rng.uniform(size=400) < 0.02)
    rules = decision_list.learn(x, bad, ["a", "b", "c"])
    assert rules and rules == plain_rules(x, bad, ["a", "b", "c"])
