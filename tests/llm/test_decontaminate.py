"""The filter must report exactly the documents in which an unfiltered alignment finds a window."""

import random

import numpy as np

from lodestream.llm import decontaminate as d

from .conftest import prose


def least_distance(window, text):
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(window, 1):
        cur = [i]
        for j, t in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (p != t), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def changed(text, n, rng):
    x = list(text)
    for _ in range(n):
        p = rng.randrange(len(x))
        kind = rng.random()
        if kind < 0.33:
            x[p] = rng.choice("abcé")
        elif kind < 0.66:
            del x[p]
        else:
            x.insert(p, rng.choice("xyz"))
    return "".join(x)


def test_lossless_and_exact():
    rng, seen = random.Random(11), set()
    for k in range(60):
        item = prose(k, 40)[: rng.randint(30, 220)]
        text = prose(900 + k, 8) + " " + changed(item[: rng.randint(30, 160)], rng.randint(0, 14), rng) + " " + prose(700 + k, 6)
        index = d.Index([(1, item)])
        want = any(least_distance(w.tolist(), d.normal(text).tolist()) <= b for w, b in zip(index.text, index.budget, strict=True))
        assert bool(index.search(text)) == want
        seen.add(want)
    assert seen == {True, False}


def test_tables(spark, docs, clashing, nothing, rows):
    items = [(1, rows[4][1].replace("\n", "  ").upper()), (2, rows[4][1]), (3, prose(77_777, 40)), (4, None), (5, ""), (None, "x"), (6, "short")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(clashing.drop("ids"), bench).collect()}
    assert got == {(4, 1), (4, 2)}
    kept = d.drop_leaks(clashing, bench)
    assert kept.columns == clashing.columns
    assert kept.count() == docs.count() - 1 and kept.where("doc_id = 4").count() == 0
    assert d.leaks(nothing, bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def test_blocks_of_the_benchmark(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 100)
    bench = spark.createDataFrame([(k, rows[k][1]) for k in (3, 5, 9)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench).collect()} == {(3, 3), (5, 5), (9, 9)}
    kept = d.drop_leaks(docs, bench)
    assert kept.count() == docs.count() - 3 and kept.where("doc_id in (3, 5, 9)").count() == 0


def test_short_items_have_a_positive_bound():
    for n in range(1, 300):
        m = np.array([n])
        assert n < d.Q or n - d.Q + 1 - int(d.budget(m)[0]) * d.Q >= 1
        assert n < 25 or d.budget(m)[0] == int(d.ERROR * n)


def test_the_sieve_passes_whatever_any_block_finds():
    rng = random.Random(5)
    blocks = [d.Index([(k, prose(300 + k, 30))]) for k in range(4)]
    sieve = d.Sieve()
    for b in blocks:
        sieve.add(b)
    for k in range(40):
        text = prose(2000 + k, 20) + " " + changed(prose(300 + k % 6, 30)[: rng.randint(40, 200)], rng.randint(0, 12), rng)
        assert sieve.passes(text) or not any(b.search(text) for b in blocks)
    assert not sieve.passes(None) and not sieve.passes("") and not sieve.passes(prose(9000, 40, "de"))
