"""SimHash groups against brute force over all pairs, and what stays of each group."""

import random
from collections import defaultdict

import xxhash

from lodestream.llm import simhash

from .conftest import table_of


def plain_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(rows):
    prints = [(r[0], plain_print(r[1])) for r in rows]
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                group[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[root(i)].append(d)
    return sorted(((d, f"{f:016x}", min(low[root(i)], default=None)) for i, (d, f) in enumerate(prints)), key=repr)


def test_matches_all_pairs(spark, docs, clashing, rows):
    want = brute(rows)
    assert table_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert table_of(simhash.near_duplicates(clashing), "doc_id", "fingerprint", "component_id") == want


def test_links_and_chains(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):  # chains of neighbours
            prints.add(f - 2**64 if f >> 63 else f)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == want


def test_one_of_each_group_stays(spark, docs, rows):
    kept = [r[0] for r in simhash.drop_near_duplicates(docs).collect()]
    names = {c for _, _, c in brute(rows) if c is not None}
    assert sorted(k for k in kept if k is not None) == sorted(names)
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_near_copies_by_five_words_go(spark):
    """Texts of 0.8 and more in five-word shingles go although their fingerprints are over three bits apart; others stay."""
    rng = random.Random(4)
    cut = lambda t: {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
    alike = lambda a, b: len(cut(a) & cut(b)) / len(cut(a) | cut(b))
    texts, gone, far = [], set(), 0
    for k in range(40):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = list(a)
        for at in rng.sample(range(200), 2 if k % 2 else 9):
            b[at] = "x" + b[at]
        if alike(a, b) >= 0.8:
            gone.add(2 * k + 1)
            far += (plain_print(" ".join(a)) ^ plain_print(" ".join(b))).bit_count() > 3
        texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    assert 15 <= len(gone) <= 30 and far >= 5
    left = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert left == set(range(80)) - gone


def test_other_texts_under_an_id_stay(spark):
    rows = [(1, "one two three four five six"), (1, "an entirely different text of some words"), (1, "one two three four five six"), (2, "one two three four five six"), (2, "a third text that nobody else has")]
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, left)) == sorted({*rows[:2], rows[4]})


def test_a_large_group_around_one_text(spark):
    """Each of 150 texts is alike to one text only, not to each other: that one stays, and at most 5 % that share no entry with it."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(150):
        t = list(base)
        for at in rng.sample(range(300), 6):
            t[at] = rng.choice(words)
        rows.append((k + 1, " ".join(t)))
    left = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 0 in left and len(left) <= 1 + 150 // 20


def test_groups_are_those_of_all_pairs_that_meet(spark):
    """Texts that differ in five words each, few of them alike: groups as by all pairs of which one's ball holds a segment of the other."""
    from lodestream.llm import nearcopies

    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(250):
        t = list(base)
        for at in rng.sample(range(300), 5):
            t[at] = f"w{rng.randrange(5000)}"
        rows.append((k, " ".join(t)))
    sets = [set(nearcopies.shingles(t.encode()).tolist()) for _, t in rows]
    keys, balls = [], []
    for _, t in rows:
        segments, weak = nearcopies.wide_print(t.encode())
        keys.append(set(segments.tolist()))
        found = set()
        for s, w in zip(segments.tolist(), weak.reshape(-1, nearcopies.WEAK).tolist(), strict=True):
            own = [s]
            for b in w:
                own += [x ^ 1 << b for x in own]
            found.update(own)
        balls.append(found)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if (keys[i] & balls[j] or keys[j] & balls[i]) and shared >= nearcopies.ALIKE * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    left = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left == {root(i) for i in range(len(rows))} and 20 < len(left) < len(rows)


def test_texts_that_are_no_links_are_not_paired(spark, monkeypatch):
    """Of 400 unlike variants of one text few pairs become rows, and these hold all links between the groups; whatever the size of a block."""
    from lodestream.llm import nearcopies
    from lodestream.llm.common import Scratch

    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(400):
        t = list(base)
        for at in rng.sample(range(150), rng.choice([2, 5, 6, 8, 10])):
            t[at] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts, save = {}, Scratch.save

    def counted(self, df, name, by=None):
        got = save(self, df, name, by)
        if name in ("nodes", "rest"):
            counts[name] = got.count()
        return got

    monkeypatch.setattr(Scratch, "save", counted)
    left = [{r[0] for r in simhash.drop_near_duplicates(docs).collect()}]
    assert counts["nodes"] == 400 and counts["rest"] <= 400
    monkeypatch.setattr(nearcopies, "BLOCK", 16, raising=False)
    left.append({r[0] for r in simhash.drop_near_duplicates(docs).collect()})
    assert left[0] == left[1]


def test_folded_bits_never_rule_out_a_link():
    """The bits in which two sets differ are at most the members that one of them lacks."""
    from lodestream.llm import nearcopies

    rng = random.Random(12)
    for n in (0, 1, 5, 300, 5000):
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[n // 9 :] + [rng.getrandbits(64) for _ in range(n // 10)]
        x, y = (nearcopies.folded(nearcopies.np.array(sorted(s), nearcopies.np.uint64)) for s in (a, b))
        assert sum(int(k).bit_count() for k in (x ^ y).view(nearcopies.np.uint64)) <= len(set(a) ^ set(b))
