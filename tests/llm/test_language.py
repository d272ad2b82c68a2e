"""Language mixtures, and the hidden Markov model against enumeration and plain counts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from lodestream.llm import hmm, langmix

from .conftest import prose, table_of


def test_language(spark, docs, clashing, nothing, rows):
    got = {r["doc_id"]: r for r in langmix.identify(docs).collect()}
    for k in range(60):
        assert got[k]["lang_pred"] == ("en" if k % 3 else "de") and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert {got[k]["lang_pred"] for k in (72, 73, 74, 75)} == {"und"} and got[72]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert table_of(langmix.identify(clashing), "doc_id", "lang_pred") == table_of(langmix.identify(docs), "doc_id", "lang_pred")
    kept = langmix.keep_identified(clashing)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r[0] for r in rows if r[0] not in (72, 73, 74, 75)}
    assert langmix.identify(nothing).count() == langmix.keep_identified(nothing).count() == 0
    assert {r["lang_pred"] for r in langmix.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_mixture_finds_both_languages(spark, docs):
    model = langmix.learn(docs.select("lang", "text"))
    both, _ = model.infer(prose(901, 120) + " " + prose(902, 60, "de"))
    assert [k for k, _ in both] == ["en", "de"] and 0.5 < both[0][1] < 0.8
    one, _ = model.infer(prose(903, 200))
    assert one == [("en", 1.0)]
    # expectation-maximisation never lowers the likelihood
    p, n = np.array([[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]]), np.array([5.0, 1.0, 9.0])
    _, fit = model.shares(p, n)
    assert fit >= max(float(n @ np.log(p[k])) for k in range(2)) - 1e-9


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(5)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    s = hmm.STATES
    m = hmm.States(norm(rng.uniform(size=s)), norm(rng.uniform(size=(s, s))), norm(rng.uniform(size=(s, 5))))
    sequences = [np.array(x, np.int16) for x in ([0], [1, 4, 2], [3, 3, 3, 0], [2, 1])]
    want = []
    for x in sequences:
        total = 0.0
        for path in itertools.product(range(s), repeat=len(x)):
            p = m.start[path[0]] * m.emit[path[0], x[0]]
            for a, b, o in zip(path, path[1:], x[1:], strict=False):
                p *= m.step[a, b] * m.emit[b, o]
            total += p
        want.append(math.log10(total))
    assert np.allclose(hmm.likelihoods(m, sequences), want)
    start, step, emit, fit = hmm.expected(m, sequences)
    assert np.isclose(fit, sum(want)) and np.isclose(start.sum(), 4) and np.isclose(step.sum(), sum(len(x) - 1 for x in sequences)) and np.isclose(emit.sum(), sum(map(len, sequences)))
    flat = np.ones(5)
    after = hmm.maximised(start, step, emit, flat)
    assert hmm.expected(after, sequences)[3] > fit
    parts = [hmm.expected(m, sequences[:2]), hmm.expected(m, sequences[2:])]
    assert np.allclose(parts[0][2] + parts[1][2], emit)  # counts of partitions add up


def test_scores(spark, docs, clashing, nothing, rows, monkeypatch):
    monkeypatch.setattr(hmm, "LISTED", 20)  # so that most words take the way through the shuffle
    monkeypatch.setattr(hmm, "train", lambda coded, classes, fit=hmm.train: fit(coded, classes, passes=1))
    got = sorted(hmm.score(docs).collect(), key=repr)
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((r[0], held(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1]))) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"]) for r in got), key=repr) == want
    base = {r[0]: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r[1])) for r in rows if r[0] is not None}
    for r in got:
        assert r["train_tokens"] == n and r["score"] <= 0
        if r["doc_id"] is not None:
            assert math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9)
    long = [r for r in got if r["n_tokens"] > 50]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)
    assert table_of(hmm.score(clashing), "doc_id", "n_tokens", "n_known") == table_of(hmm.score(docs), "doc_id", "n_tokens", "n_known")
    assert hmm.score(nothing).count() == 0


def test_noise_foreign_and_mixed_texts_go(spark, rows):
    """Planted among clean rows: letter noise, a language nobody learned, an even mixture; short clean texts stay."""
    rng = random.Random(11)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60))
    foreign = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью " * 2
    mixed = "\n".join(prose(7100 + k, 30, lang) for k, lang in enumerate(["en", "de"] * 4))
    clean = [(200, "the"), (201, prose(7200, 3)), (202, prose(7201, 40)), (203, prose(7202, 40, "de")), (204, prose(7203, 90) + " " + prose(7204, 20, "de"))]
    planted = [(100, noise), (101, foreign), (102, mixed)]
    some = [r[:3] for r in rows if r[0] is not None and r[0] < 60] + [(k, t, None) for k, t in planted + clean]
    kept = langmix.keep_identified(spark.createDataFrame(some, "doc_id bigint, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(60)) | {k for k, _ in clean}
    assert all(1 / n < langmix.main_share(n) < 1 for n in range(2, 50)) and langmix.main_share(1) == 1


def test_nothing_learned_keeps_all_with_a_letter(spark, nothing):
    rows = [(k, prose(7300 + k, 12), None) for k in range(20)] + [(30, "123 !!", None), (31, None, None), (32, "", None)]
    kept = langmix.keep_identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(20))
    assert langmix.keep_identified(nothing).count() == 0


def test_scores_do_not_depend_on_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(hmm, "train", lambda coded, classes, fit=hmm.train: fit(coded, classes, passes=2))
    some = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] != 77], "doc_id bigint, text string")
    found = []
    for dealt in (some.coalesce(1), some.repartition(7), some.orderBy("text").repartition(50)):
        found.append(sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in hmm.score(dealt).collect())))
    for other in found[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in found[0]]
        assert np.allclose([x[3] for x in other], [x[3] for x in found[0]], rtol=0, atol=1e-6)


def plain_counts(m, x):
    """Posterior counts of one sequence by enumeration of all state paths."""
    s, total = hmm.STATES, 0.0
    start, step, emit = np.zeros(s), np.zeros((s, s)), np.zeros(m.emit.shape)
    for path in itertools.product(range(s), repeat=len(x)):
        p = m.start[path[0]] * m.emit[path[0], x[0]]
        for a, b, o in zip(path, path[1:], x[1:], strict=False):
            p *= m.step[a, b] * m.emit[b, o]
        total += p
        start[path[0]] += p
        for a, b in itertools.pairwise(path):
            step[a, b] += p
        for a, o in zip(path, x, strict=True):
            emit[a, o] += p
    return start / total, step / total, emit / total


def test_trained_states_equal_a_plain_version(spark, monkeypatch):
    """Every round of incremental Baum-Welch over two blocks, against enumeration; long texts by spans as well."""
    classes = np.ones(hmm.COMMON + hmm.RARE)
    monkeypatch.setattr(hmm, "STATES", 2)
    rng = np.random.default_rng(8)
    sequences = [rng.integers(0, 6, n).astype(np.int16) for n in (1, 4, 6, 3, 5, 2, 6)]
    rows = [(x.tobytes(), k % 2) for k, x in enumerate(sequences)]
    model, latest = hmm.initial(classes), [None, None]
    for _ in range(2):
        for block in range(2):
            each = [plain_counts(model, x) for x, (_, b) in zip(sequences, rows, strict=True) if b == block]
            latest[block] = [sum(c[k] for c in each) for k in range(3)]
            model = hmm.maximised(*(sum(c[k] for c in latest if c) for k in range(3)), classes)
    monkeypatch.setattr(hmm, "SPAN", 4)
    # tasks import the module afresh, so they get the two states by the closure's model only
    own = hmm.initial(classes)
    whole = hmm.expected(own, sequences)
    monkeypatch.setattr(hmm, "SPAN", 400)
    assert all(np.allclose(a, b) for a, b in zip(whole, hmm.expected(own, sequences), strict=True))

    sums, now = [None, None], hmm.initial(classes)
    for _ in range(2):
        for block in range(2):
            sums[block] = hmm.expected(now, [x for x, (_, b) in zip(sequences, rows, strict=True) if b == block])[:3]
            now = hmm.maximised(*(sum(c[k] for c in sums if c) for k in range(3)), classes)
    assert np.allclose(now.start, model.start) and np.allclose(now.step, model.step) and np.allclose(now.emit, model.emit)


def test_training_over_partitions(spark):
    """``train`` gives what its rounds give in one place, however rows are dealt, and each pass is likelier."""
    rng = np.random.default_rng(9)
    classes = np.ones(hmm.COMMON + hmm.RARE)
    sequences = [rng.integers(0, 9, rng.integers(1, 30)).astype(np.int16) for _ in range(40)]
    rows = [(x.tobytes(), k % 2) for k, x in enumerate(sequences)]
    model, fits = hmm.train(spark.createDataFrame(rows, "codes binary, block int").repartition(3), classes, blocks=2, passes=3)
    now, latest = hmm.initial(classes), [None, None]
    for _ in range(3):
        for block in range(2):
            latest[block] = hmm.expected(now, [x for x, (_, b) in zip(sequences, rows, strict=True) if b == block])[:3]
            now = hmm.maximised(*(sum(c[k] for c in latest if c) for k in range(3)), classes)
    assert np.allclose(model.emit, now.emit) and np.allclose(model.step, now.step)
    assert fits[0] < fits[1] <= fits[2]


def test_mixture_equals_a_plain_version(spark, docs, rows):
    """Trigram counts, expectation-maximisation and the penalised set, in plain Python loops."""
    model = langmix.learn(docs.select("lang", "text"))
    cell = lambda t: langmix.trigrams(t)[0].tolist()
    by = {}
    for r in rows:
        if r[1] and r[2]:
            padded = f" {''.join(c if c.isalpha() else ' ' for c in r[1].lower())} "
            for k in range(1, len(padded) - 1):
                if padded[k] != " ":
                    by.setdefault(r[2], Counter())[padded[k - 1 : k + 2]] += 1
    assert model.langs == sorted(by)
    for k, lang in enumerate(model.langs):
        n = sum(by[lang].values())
        tri, c = by[lang].most_common(1)[0]
        at = set(cell(tri.strip())) if tri.strip() == tri else None
        if at:
            assert max(model.probability[k, list(at)]) >= (c + langmix.SMOOTHING) / (n + langmix.SMOOTHING * langmix.BUCKETS) * 0.999

    def plain(p, n):
        share = [1 / len(p)] * len(p)
        for _ in range(langmix.ROUNDS):
            new = [0.0] * len(p)
            for c in range(len(n)):
                whole = sum(share[k] * p[k][c] for k in range(len(p)))
                for k in range(len(p)):
                    new[k] += n[c] * share[k] * p[k][c] / whole
            new = [x / sum(n) for x in new]
            moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
            if moved < langmix.SETTLED:
                break
        return share

    for text in (prose(31, 50), prose(32, 40) + " " + prose(33, 40, "de"), prose(34, 5, "de")):
        u, n = langmix.trigrams(text)
        p = model.probability[:, u]
        share = plain(p.tolist(), n.tolist())
        single = [sum(math.log(x) * c for x, c in zip(row, n.tolist(), strict=True)) for row in p.tolist()]
        both = sum(c * math.log(sum(s * x for s, x in zip(share, col, strict=True))) for c, col in zip(n.tolist(), p.T.tolist(), strict=True))
        cost = langmix.PENALTY * 0.5 * math.log(max(n.sum() / langmix.OVERLAP, 2))
        wide = (both - max(single)) / langmix.OVERLAP > cost and min(share) >= langmix.LEAST_SHARE
        found, _ = model.infer(text)
        assert len(found) == (2 if wide else 1)
        if wide:
            assert all(math.isclose(dict(found)[k], s, abs_tol=1e-6) for k, s in zip(model.langs, share, strict=True))


def test_long_texts_and_many_languages(spark, docs, monkeypatch):
    text = prose(41, 400)
    whole = langmix.trigrams(text)
    for chunk in (1, 7, len(text) - 1, len(text), len(text) + 1):
        monkeypatch.setattr(langmix, "CHUNK", chunk)
        u, n = langmix.trigrams(text)
        assert u.tolist() == whole[0].tolist() and n.tolist() == whole[1].tolist()
    monkeypatch.undo()
    monkeypatch.setattr(langmix, "LANGS", 2)
    rare = docs.selectExpr("doc_id", "text", "case when doc_id = 5 then 'zz' else lang end lang")
    assert langmix.learn(rare).langs == ["de", "en"]
    assert langmix.identify(rare).count() == docs.count()
