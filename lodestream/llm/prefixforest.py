"""Approximate nearest neighbours by inner product with forests of hash prefixes.

Equal vectors are one class.  Classes are dealt into blocks of about BLOCK by a hash of the vector,
and a task builds a block's forest: TREES trees, each a sorted array of long hash strings.  A
character of a string is the axis that a vector points to most after a random projection, with its sign, so
near vectors share characters.  A query descends each tree to the prefix it shares with most characters
(binary searches in the sorted array) and then ascends in all trees at once, a character at a time,
until the ranges under its prefixes hold enough entries.  At the root a range is the whole block, so
the ascent ends at an exact search at worst.  Candidates are scored in double precision on the original vectors.

How many entries are enough is fitted within each block: for SAMPLE of its vectors the true
neighbours in the block are found by a full scan, and the least number at which the ascent finds RECALL of them is taken.
Neighbours in the whole table are nearer than those in a block, so recall against the table is not lower; nothing depends on the size of the table.

Inner products of vectors of unequal norms are searched as angles: an index vector gets one more component
that brings all norms of the block to the largest, a query a zero.

Queries meet every block: each class of queries is one row a block, a block's rows and then its queries stream through
one task, and a query's result in a block is one row.  A task holds one block and one batch of queries.

Defined results: rows with a null id take no part, nor do vectors that are null, empty, zero or hold null or
non-finite components, or of which inner products overflow; vectors meet only those of equal length; repeated rows are rows
of their own, and a query leaves out one row of its own id and vector; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, plain, table

NEAREST = 20
#: Rows whose id is divisible by this are the queries.
EVERY = 20
#: Classes a block; trees a forest; characters a string, and the bits of one.
BLOCK, TREES, LENGTH, BITS = 16_384, 64, 4, 7
#: Vectors of a block on which the ascent is fitted, and the share of their neighbours that it must find.
SAMPLE, RECALL = 128, 0.96
SEED = 13

ITEM = "block int, kind int, a bigint, b bigint, v array<double>, ids array<bigint>"
HITS = "a bigint, b bigint, near array<struct<score: double, vec_id: bigint>>"


class Hashes:
    """The projections of all trees for vectors of one length, one more component included."""

    def __init__(self, width: int):
        rng = np.random.default_rng([SEED, width])
        axes = min(width + 1, 2 ** (BITS - 1))
        self.planes = rng.standard_normal((TREES * LENGTH, width + 1, axes))
        for p in self.planes:  # orthonormal axes
            p[:] = np.linalg.qr(p)[0]
        self.planes = self.planes.astype(np.float32)

    def strings(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """(trees, vectors): each string as an integer, its first character in the highest bits."""
        out = np.zeros((TREES, len(v)), np.int64)
        scale = np.abs(v).max(axis=1, initial=1e-300)
        whole = np.hstack([v / scale[:, None], (extra / scale)[:, None]]).astype(np.float32)
        for at in range(0, len(v), 4096):
            rows = whole[at : at + 4096]
            for k, plane in enumerate(self.planes):
                turned = rows @ plane
                axis = np.abs(turned).argmax(axis=1)
                letter = 2 * axis + (turned[np.arange(len(rows)), axis] > 0)
                out[k // LENGTH, at : at + 4096] |= letter << (BITS * (LENGTH - 1 - k % LENGTH))
        return out


class Forest:
    """Sorted arrays of hash strings over the vectors of one block and length."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], nearest: int):
        self.v, self.ids, self.nearest = vectors, ids, nearest
        self.first = np.array([i[0] for i in ids])
        self.hashes = Hashes(vectors.shape[1])
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.own = self.hashes.strings(vectors, np.sqrt(np.maximum(norms.max() ** 2 - norms**2, 0)))
        self.order = np.argsort(self.own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.own, self.order, axis=1)
        self.enough = self.fitted()

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share the first x characters begin and end: two arrays (length + 1, trees, queries)."""
        low, high = (np.zeros((LENGTH + 1, *strings.shape), np.int64) for _ in range(2))
        for x in range(LENGTH + 1):
            shift = BITS * (LENGTH - x)
            for t in range(TREES):
                at = strings[t] >> shift
                low[x, t] = np.searchsorted(self.sorted[t], at << shift, "left")
                high[x, t] = np.searchsorted(self.sorted[t], (at + 1) << shift, "left")
        return low, high

    def fitted(self) -> int:
        """The number of entries at which the ascent of the sampled vectors has found enough of their neighbours."""
        n, k = len(self.v), self.nearest
        if n <= 2 * k:
            return n * TREES
        picked = np.linspace(0, n - 1, min(SAMPLE, n)).astype(int)
        strings = self.hashes.strings(self.v[picked], np.zeros(len(picked)))
        low, high = self.ranges(strings)
        entries = (high - low).sum(axis=1)
        true = np.argpartition(-(self.v[picked] @ self.v.T), k, axis=1)[:, : k + 1]
        shared = np.zeros(true.shape, int)
        for x in range(1, LENGTH + 1):
            shift = BITS * (LENGTH - x)
            shared[((self.own[:, true] >> shift) == (strings[:, :, None] >> shift)).any(axis=0)] = x
        most = n * TREES
        for enough in 2 ** np.arange(5, int(np.log2(most)) + 1):
            level = self.levels(entries, enough)
            if (shared >= level[:, None]).mean() >= RECALL:
                return int(enough)
        return most

    @staticmethod
    def levels(entries: np.ndarray, enough: int) -> np.ndarray:
        """The longest prefix at which the ascent of each query has ``enough`` entries; 0, the root, has all there are."""
        return np.maximum(LENGTH - (entries[::-1] >= enough).argmax(axis=0), 0) * (entries >= enough).any(axis=0)

    def search(self, queries: np.ndarray) -> Iterator[list[tuple[float, int]]]:
        """The rows nearest to each query, one more than asked for (its own may be among them)."""
        low, high = self.ranges(self.hashes.strings(queries, np.zeros(len(queries))))
        levels = self.levels((high - low).sum(axis=1), self.enough)
        seen = np.zeros(len(self.v), bool)
        most = self.nearest + 1
        for j, q in enumerate(queries):
            x = levels[j]
            while True:
                seen[:] = x == 0
                for t in range(TREES if x else 0):
                    seen[self.order[t, low[x, t, j] : high[x, t, j]]] = True
                found = np.flatnonzero(seen)
                if not x or len(found) >= most:
                    break
                x -= 1
            score = self.v[found] @ q
            if len(found) > 4 * most:
                cut = np.partition(score, len(score) - most)[len(score) - most]
                margin = 1e-9 * max(abs(cut), 1e-300)
                found = found[score >= cut - margin]
            exact = np.einsum("ij,j->i", self.v[found], q)
            best = found[np.lexsort((self.first[found], -exact))[: 2 * most]]
            rows = sorted(((-float(s), i) for s, c in zip(np.einsum("ij,j->i", self.v[best], q), best, strict=True) for i in self.ids[c]))[:most]
            yield [(-s, i) for s, i in rows]


def _searched(nearest: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forests = None, [], None
        kind_of = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

        def build() -> dict[int, Forest]:
            by: dict[int, list[tuple]] = {}
            for v, ids in held:
                by.setdefault(len(v), []).append((v, ids))
            return {w: Forest(np.array([v for v, _ in rows]), [i for _, i in rows], nearest) for w, rows in by.items()}

        for b in batches:
            a, bb, near = [], [], []
            block, kind, ids = (b.column(k).to_pylist() for k in ("block", "kind", "ids"))
            vectors, names = b.column("v"), list(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
            asked: dict[int, list[int]] = {}

            def answer() -> None:
                for width, at in asked.items():  # noqa: B023
                    if width in forests:  # noqa: B023
                        for i, got in zip(at, forests[width].search(np.array([vectors[i].values.to_numpy() for i in at])), strict=True):  # noqa: B023
                            a.append(names[i][0])  # noqa: B023
                            bb.append(names[i][1])  # noqa: B023
                            near.append(got)  # noqa: B023
                asked.clear()  # noqa: B023

            for i in range(b.num_rows):
                if block[i] != now:
                    answer()
                    now, held, forests = block[i], [], None
                if kind[i] == 0:
                    held.append((vectors[i].values.to_numpy(), ids[i]))
                else:
                    if forests is None:
                        forests, held = build(), []
                    asked.setdefault(len(vectors[i].values), []).append(i)
            answer()
            rows = [[{"score": s, "vec_id": i} for s, i in r] for r in near]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(bb, pa.int64()), pa.array(rows, kind_of)], names=["a", "b", "near"])

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, a, b, v) of the rows that take part; a and b are two hashes that name the vector."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    own = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    good = own.withColumn("norm", norm).where("norm > 0 and norm < double('infinity')")  # null or NaN components make it null or NaN
    return good.select("vec_id", F.xxhash64(F.lit(1), "v").alias("a"), F.xxhash64(F.lit(2), "v").alias("b"), "v")


def nearest_neighbours(rows: DataFrame, nearest: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the queries: rows whose id is divisible by ``every``."""
    scratch = Scratch(rows.sparkSession, "forest")
    try:
        known = usable(rows, id_col, vector_col)
        # of equal vectors no more rows than a result has can be in one; ranks are cut before the exchange as well
        first = known.withColumn("at", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("at") <= nearest + 1)
        classes = scratch.save(first.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
        queries = scratch.save(known.where(F.col("vec_id") % every == 0).select("vec_id", "a", "b"), "queries")
        blocks = max(1, -(-classes.count() // block))
        of = lambda: F.pmod("a", F.lit(blocks)).cast("int")
        asked = queries.select("a", "b").distinct().join(classes.select("a", "b", "v").hint("merge"), ["a", "b"])
        items = classes.select(of().alias("block"), F.lit(0).alias("kind"), "a", "b", "v", "ids")
        probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "a", "b", "v", F.lit(None).cast("array<bigint>").alias("ids"))
        dealt = items.unionByName(probes).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "a", "b")
        hits = scratch.save(dealt.mapInArrow(_searched(nearest), HITS), "hits")
        flat = hits.select("a", "b", F.inline("near"))
        best = flat.withColumn("at", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= nearest + 1)
        lists = scratch.save(best.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near")), "lists")
        own = F.array_position(F.transform("near", lambda x: x["vec_id"]), F.col("query_id"))
        others = F.filter("near", lambda x: ((own == 0) & (x["at"] <= nearest)) | ((own > 0) & (x["at"] != own)))
        found = queries.withColumnRenamed("vec_id", "query_id").join(lists.hint("merge"), ["a", "b"]).select("query_id", F.posexplode(others).alias("k", "x"))
        return scratch.keep(found.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"))
    finally:
        scratch.close()


def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(plain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


#: An approximate search has no SQL: it is tested by its recall against brute force.
