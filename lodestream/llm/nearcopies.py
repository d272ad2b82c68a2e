"""Near copies: texts with a similarity of 0.8 or more in five-word shingles, by wide SimHash fingerprints.

At that similarity a 64-bit fingerprint of five-word shingles differs in about ten bits, so one
short fingerprint needs a radius whose lookups grow with the square of the corpus.  The
fingerprints here have 512 bits, the majority bits of a text's distinct two-word shingles, in
SEGMENTS segments of 32 bits.  A bit that near copies differ in is nearly always one whose
majority is narrow, so the small Hamming ball around a segment is enumerated over its WEAK least
certain bits: 2**WEAK lookups a segment in the table of exact segments.  Candidates are verified
by the complete distance of the fingerprints, and then by the exact Jaccard similarity of the two
sets of five-word shingles; groups are connected components.

A table entry holds the first and the last of the texts with that segment, in the order of a hash,
so work grows with a group's size and not with its square: entries of one or two texts are complete, in larger ones every text still meets two.
Rounds follow in which the texts of an entry meet that one of them which has most links by then, if it is in another
group; they end when one finds no further link.  Last, all pairs that meet in an entry of more than two and are still in different
groups are compared, so the groups are those of all pairs that meet in any entry.  Each shingle of a text flips one of FOLDED bits; the
bits in which two texts differ are at most the shingles that one of them lacks, so this comparison inside the join leaves out
only pairs that cannot be alike, and pairs that are no links hardly ever become rows.

Defined results: a text of fewer than five (two) words is one shingle; texts without words (null
too) are equal.  Nodes are distinct texts by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Shingles that decide, and the similarity; shingles that fingerprints are made of.
WORDS, ALIKE = 5, 0.8
PAIR = 2
BITS, SEGMENTS, WEAK = 512, 16, 3
#: Differing bits beyond which a candidate is dropped before its shingles are compared.  Texts of similarity 0.8 share
#: at least 8/9 of their two-word shingles, so about 78 of 512 bits differ; this is six standard deviations more.
FAR = 128
#: Texts of an entry that are one block of ``mixed_pairs``.
BLOCK = 1024
#: Bits that the shingles of a text are folded into.
FOLDED = 1024
_MIX = np.arange(1, 2 * (BITS // 64), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles of a UTF-8 text."""
    words = text.lower().split()
    cuts = {b" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cuts), np.uint64, len(cuts)))


def margins(found: np.ndarray) -> np.ndarray:
    """For each of BITS bits, how many of the hashes set it less how many do not."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 4096):
        h = (found[at : at + 4096, None] ^ _MIX) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        sums += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * sums - len(found)


def wide_print(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The segments (numbered above their 32 bits), and the WEAK least certain bit places of each."""
    m = margins(shingles(text, PAIR))
    values = np.packbits(m > 0, bitorder="little").view("<u4").astype(np.int64)
    weak = np.argsort(np.abs(m).reshape(SEGMENTS, -1), axis=1, kind="stable")[:, :WEAK]
    return values | np.arange(SEGMENTS) << 32, weak.astype(np.int8).ravel()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [wide_print(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column("print"), b.column("id"), pa.array([s for s, _ in got], pa.list_(pa.int64())), pa.array([w for _, w in got], pa.list_(pa.int8()))], names=["print", "id", "segments", "weak"])


def folded(found: np.ndarray) -> np.ndarray:
    """FOLDED bits, each set if an odd number of the hashes fall on it."""
    return np.packbits(np.bincount((found % np.uint64(FOLDED)).astype(np.int64), minlength=FOLDED) & 1, bitorder="little").view("<i8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text").cast(pa.large_binary())]
        found = [shingles(t) for t in texts]
        columns = [pa.array(x, pa.list_(pa.int64())) for x in ([f.view(np.int64) for f in found], [wide_print(t)[0] for t in texts], [folded(f) for f in found])]
        yield pa.RecordBatch.from_arrays([b.column("print"), *columns], names=["print", "shingles", "segments", "folded"])


def ball(key: Column, weak: Column, segment: Column) -> Column:
    """All keys that differ from ``key`` in its segment's least certain bits only."""
    found = [key]
    for k in range(WEAK):
        flip = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.get(weak, segment * WEAK + k).cast("int"))
        found += [x.bitwiseXOR(flip) for x in found]
    return F.array(*found)


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b of the texts that meet in some segment; ``nodes``: print, segments, weak."""
    each = nodes.select("print", "weak", F.posexplode("segments").alias("segment", "key"))
    table = each.select("print", "key", F.xxhash64("print").alias("order")).groupBy("key").agg(F.min_by("print", "order").alias("low"), F.max_by("print", "order").alias("high"))
    probes = each.select("print", F.explode(ball(F.col("key"), F.col("weak"), F.col("segment"))).alias("key"))
    met = probes.join(table.hint("merge"), "key").select("print", F.explode(F.array("low", "high")).alias("other")).where("print <> other")
    return met.select(F.least("print", "other").alias("a"), F.greatest("print", "other").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """All texts of some pair, repeats included."""
    return pairs.select(F.col("a").alias("print")).union(pairs.select(F.col("b").alias("print")))


def hub_pairs(live: DataFrame) -> DataFrame:
    """(a, b) with a < b of texts and the most linked text of an entry of more than two, in another group.

    ``live``: print, segments, weak, root, links of the texts that met another.
    """
    each = live.select("print", "root", "links", F.posexplode("segments").alias("segment", "key"))
    most = F.max_by(F.struct(F.col("print").alias("hub"), F.col("root").alias("hub_root")), F.struct("links", F.xxhash64("print")))
    hubs = each.groupBy("key").agg(F.count("*").alias("n"), most.alias("most")).where("n > 2").select("key", "most.*")
    spread = live.select("print", "root", "weak", F.posexplode("segments").alias("segment", "own"))
    probes = spread.select("print", "root", F.explode(ball(F.col("own"), F.col("weak"), F.col("segment"))).alias("probe"))
    met = probes.join(hubs.hint("merge"), (F.col("probe") == F.col("key")) & (F.col("root") != F.col("hub_root")))
    return met.select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).distinct()


def mixed_pairs(scratch: Scratch, live: DataFrame) -> DataFrame:
    """The (a, b) with a < b of texts in different groups that meet in an entry of more than two, but for those whose folded bits
    rule a link out; ``live``: print, segments, weak, root, size, folded.

    Texts of an entry's largest group meet only its other texts, so those that one group already holds cost nothing.  Either kind
    is dealt in blocks.
    """
    own = F.col("root") == F.col("main")
    each = live.select("print", "root", F.explode("segments").alias("key"))
    groups = each.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
    first = F.ceil(F.col("most") / BLOCK)
    large = scratch.save(groups.where("n > 2").select("key", "main", first.alias("first"), (first + F.ceil((F.col("n") - F.col("most")) / BLOCK)).alias("blocks")), "large")
    spread = live.select("print", "root", "weak", F.posexplode("segments").alias("segment", "own"))
    balls = spread.select("print", "root", F.explode(ball(F.col("own"), F.col("weak"), F.col("segment"))).alias("key"))
    asked = balls.join(large.hint("merge"), "key").where(~own | (F.col("blocks") > F.col("first"))).select("key", "print", F.when(own, F.col("first")).otherwise(0).alias("low"), "blocks")
    dealt = F.pmod(F.xxhash64("print"), F.greatest(F.when(own, F.col("first")).otherwise(F.col("blocks") - F.col("first")), F.lit(1)))
    placed = each.join(large.hint("merge"), "key").select("key", "print", (dealt + F.when(own, 0).otherwise(F.col("first"))).alias("block"))
    sides = []
    for rows, names in ((asked, ("a", "x", "m", "p")), (placed, ("b", "y", "n", "q"))):
        named = live.select("print", *(F.col(c).alias(k) for c, k in zip(("print", "root", "size", "folded"), names, strict=True)))
        sides.append(scratch.save(rows.join(named.hint("merge"), "print").drop("print"), f"side-{names[0]}"))
    probes = sides[0].select("key", F.explode(F.sequence("low", F.col("blocks") - 1)).alias("block"), "a", "x", "m", "p")
    met = probes.join(sides[1].hint("merge"), ["key", "block"]).where((F.col("x") != F.col("y")) & _may_be_alike())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _may_be_alike() -> Column:
    """Whether sets of m and n shingles, folded into p and q, can have the similarity: the shingles that one of them lacks are few enough."""
    most = (F.col("m") + F.col("n")) * ((1 - ALIKE) / (1 + ALIKE)) + 1e-6
    differ = [F.bit_count(F.get("p", F.lit(k)).bitwiseXOR(F.get("q", F.lit(k)))) for k in range(FOLDED // 64)]
    return (F.abs(F.col("m") - F.col("n")) <= most) & (reduce(add, differ) <= most)


def _apart() -> Column:
    """Differing bits of the segments p and q."""
    return F.aggregate(F.zip_with("p", "q", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)


def sets_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """print, shingles, segments, folded of the texts of some pair; ``texts``: print, text."""
    one = texts.join(ends(pairs).distinct().hint("merge"), "print", "left_semi").groupBy("print").agg(F.first("text").alias("text"))
    return one.mapInArrow(_sets, "print bigint, shingles array<bigint>, segments array<bigint>, folded array<bigint>")


def alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose complete fingerprints differ in at most FAR bits, of a similarity of ALIKE or more; ``sets``: as of ``sets_of``."""
    left = sets.select(F.col("print").alias("a"), F.col("shingles").alias("x"), F.col("segments").alias("p"))
    right = sets.select(F.col("print").alias("b"), F.col("shingles").alias("y"), F.col("segments").alias("q"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where((_apart() <= FAR) & ((total == 0) | (shared >= ALIKE * (total - shared)))).select("a", "b")


def near_copies(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(low, print): smallest id and, under it, hash of the text that name each group; ids that are null do not count."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("print"), F.col(f"`{text_col}`").alias("text"))
    printed = texts.mapInArrow(_prints, "print bigint, id bigint, segments array<bigint>, weak array<tinyint>")
    nodes = scratch.save(printed.groupBy("print").agg(F.min("id").alias("low"), F.first("segments").alias("segments"), F.first("weak").alias("weak")), "nodes")
    pairs = scratch.save(candidates(nodes), "pairs")
    sets = scratch.save(sets_of(texts.select("print", "text"), pairs), "sets")
    found = edges = scratch.save(alike(sets, pairs), "edges")
    live = scratch.save(nodes.drop("low").join(sets.select("print", F.size("shingles").cast("bigint").alias("size"), "folded").hint("merge"), "print"), "live")
    roots, k = scratch.save(components(scratch, edges), "roots-0"), 0
    placed = lambda: live.join(roots.hint("merge"), F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print")).drop("node")
    mixed = True
    while mixed and not found.isEmpty():
        k += 1
        links = ends(edges).groupBy("print").agg(F.count("*").alias("links"))
        linked = placed().join(links.hint("merge"), "print", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        pairs = scratch.save(hub_pairs(linked), f"pairs-{k}")
        if mixed := not pairs.isEmpty():
            found = scratch.save(alike(sets, pairs), f"edges-{k}")
        if mixed and not found.isEmpty():
            edges = scratch.save(edges.union(found).distinct(), f"all-{k}")
            roots = scratch.save(components(scratch, edges), f"roots-{k}")
    if mixed:
        rest = scratch.save(mixed_pairs(scratch, placed()), "rest")
        found = scratch.save(alike(sets, rest), "edges-rest")
        if not found.isEmpty():
            edges = scratch.save(edges.union(found).distinct(), "all-rest")
            roots = scratch.save(components(scratch, edges), "roots-rest")
    named = nodes.select("print", "low").join(roots, F.col("print") == F.col("node"), "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    best = named.where("low is not null").groupBy("root").agg(F.min(F.struct("low", "print")).alias("best"))
    return best.select("best.low", "best.print")
