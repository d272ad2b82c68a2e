"""Merkle manifest of a dataset, with a proof for each row.

A row is a leaf of the tree of its partition value (its language); the roots of these trees are the
leaves of one more tree, in the order of their values.  Every ARITY consecutive nodes of a level, or
what is left of it, become one node, until one remains.

Parents are combined by key from events.  An event is a node with its place, the size of its level and its digest.
The combiner of a parent (``combined``) accumulates the digests of its children by place; the size of the level says how many
there are; the event that completes them emits the parent, which is an event itself, and so on up.
Leaves are numbered in a range order of narrow rows, so a partition completes nearly all parents that
lie in it, and only the frontiers, the children of parents that reach over a border of partitions
(at most ARITY - 1 a level, tree and border), are shuffled by an ancestor and combined again, four levels a round.

Completed parents are links from a parent to the digests of its children.  Followed in reverse, from the root
down and HEIGHT levels a round, they give each block of ARITY ** HEIGHT leaves the path above it, and in the
last round each leaf its proof.  A round streams through partitions sorted by block; a task holds the
links of one block (under 600) at a time.

Defined results: leaves are in the order of (id, digest), null ids first; a null partition value is a tree of its own, before the others;
repeated rows are leaves of their own, side by side; an empty table has no root and an empty result; fields other than those
named take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, plain, table

ARITY = 8
#: Levels between the blocks of two rounds of proofs, and levels that a round of combining completes.
HEIGHT, STRIDE = 3, 4
#: Rows of borders (one a tree and partition of the order) up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: Rows that are equal in all of the order are dealt to so many ranges.
SALTS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

EVENT = "tree string, level int, idx bigint, size bigint, digest binary"
FOUND = f"kind int, {EVENT}, run binary"
LINK, FRONTIER, ROOT = range(3)
#: The one tree over the roots of the others.
TOP = "top"


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 of some fields, each with its length in bytes, so that no two rows read alike."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (c.cast("string") for c in fields)]
    return F.unhex(F.sha2(F.concat(*said), 256))


def node(run: bytes) -> bytes:
    """The digest of a parent: of the hex digests of its children, one after the other."""
    return hashlib.sha256(run.hex().encode()).digest()


def numbered(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (tree, ...) with idx, the place in the tree by ``order``, and size, the rows of the tree.

    A range exchange and a sort give the places within partitions; the first places of each tree
    come from one row a tree and partition.
    """
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    ordered = salted.repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order).drop("salt")
    placed = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    placed = placed.withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at")
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    whole = Window.partitionBy("tree")
    first = F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("low")
    borders = scratch.save(runs.select("tree", "part", first.alias("first"), F.sum("n").over(whole).alias("size")), f"{name}-borders")
    small = borders.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(borders) if small else borders.hint("merge"), ["tree", "part"])
    return joined.withColumn("idx", F.col("first") + F.col("row")).drop("first", "part", "row")


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events to links, roots, and in the end the children of parents that are not complete here."""
    partial: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 7
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "tree", "level", "idx", "size", "digest", "run"])

    for b in batches:
        found = []
        for tree, level, idx, size, digest in zip(*(b.column(k).to_pylist() for k in ("tree", "level", "idx", "size", "digest")), strict=True):
            while size > 1:
                key = tree, level, idx // ARITY
                arity = min(ARITY, size - ARITY * key[2])
                children = partial.setdefault(key, (size, {}))[1]
                children[idx % ARITY] = digest
                if len(children) < arity:
                    break
                del partial[key]
                run = b"".join(children[k] for k in range(arity))
                digest = node(run)
                found.append((LINK, tree, level, key[2], size, digest, run))
                level, idx, size = level + 1, key[2], -(-size // ARITY)
            else:
                found.append((ROOT, tree, level, idx, size, digest, None))
        yield rows(found)
    left = [(FRONTIER, tree, level, ARITY * parent + k, size, digest, None) for (tree, level, parent), (size, children) in partial.items() for k, digest in children.items()]
    for k in range(0, len(left), 10_000):
        yield rows(left[k : k + 10_000])


def climbed(scratch: Scratch, leaves: DataFrame, name: str) -> DataFrame:
    """All links and roots (FOUND) above numbered leaves (tree, idx, size, digest)."""
    found = scratch.save(leaves.select("tree", F.lit(0).alias("level"), "idx", "size", "digest").mapInArrow(combined, FOUND), f"{name}-0")
    tables, level = [found], 0
    while not (frontier := tables[-1].where(F.col("kind") == FRONTIER)).isEmpty():
        level += STRIDE
        up = F.greatest(F.lit(level) - F.col("level"), F.lit(0))
        ancestor = F.call_function("shiftright", F.col("idx"), up * 3)  # ARITY is 2 ** 3
        events = frontier.withColumn("above", ancestor).repartition("tree", "above").select("tree", "level", "idx", "size", "digest")
        tables.append(scratch.save(events.mapInArrow(combined, FOUND), f"{name}-{level}"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.where(F.col("kind") != FRONTIER)


#: A path is a byte string: for each level from below, the place in its run, the length of the run, and the run itself.
def steps(path: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(path):
        n = 32 * path[at + 1]
        out.append((path[at], path[at + 2 : at + 2 + n]))
        at += 2 + n
    return out


def step(place: int, run: bytes) -> bytes:
    return bytes((place, len(run) // 32)) + run


def siblings(path: bytes) -> str:
    """The hex digests of a proof: at every level those of the run but for the path's own."""
    return "".join((run[: 32 * place] + run[32 * place + 32 :]).hex() for place, run in steps(path))


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a digest gives with a path's siblings."""
    for place, run in steps(path):
        digest = node(run[: 32 * place] + digest + run[32 * place + 32 :])
    return digest


HEADER, RUN, LEAF = range(3)
STREAM = "tree string, block bigint, kind int, level int, idx bigint, data binary"


class Block:
    """The links within one block and the path above it."""

    def __init__(self, low: int):
        self.low, self.key, self.head, self.runs = low, None, b"", {}

    def take(self, key: tuple, kind: int, level: int, idx: int, data: bytes) -> None:
        if key != self.key:
            self.key, self.head, self.runs = key, b"", {}
        if kind == HEADER:
            self.head = data
        else:
            self.runs[level, idx] = data

    def path(self, idx: int) -> bytes:
        """From node ``idx`` of the lowest level up to the block's own node; shorter if the tree ends before."""
        out = b""
        for level in range(self.low, self.low + HEIGHT):
            run = self.runs.get((level, idx // ARITY))
            if run is None:
                break
            out += step(idx % ARITY, run)
            idx //= ARITY
        return out


def streamed(heads: DataFrame, links: DataFrame, low: int) -> DataFrame:
    """Headers (tree, idx, data) of the blocks above level ``low``, and the links in them."""
    inner = links.where(F.col("level").between(low, low + HEIGHT - 1))
    block = F.call_function("shiftright", F.col("idx"), (F.lit(low + HEIGHT - 1) - F.col("level")) * 3)
    runs = inner.select("tree", block.alias("block"), F.lit(RUN).alias("kind"), "level", "idx", F.col("run").alias("data"))
    return heads.select("tree", F.col("idx").alias("block"), F.lit(HEADER).alias("kind"), F.lit(0).alias("level"), "idx", "data").unionByName(runs)


def paths(scratch: Scratch, links: DataFrame, heads: DataFrame, until: int, name: str) -> DataFrame:
    """(tree, idx, data) for the nodes of level ``until``, data: 32 bytes of the tree's root, and the path of the node.

    ``heads`` (tree, data) has the root and the path above it.
    """
    top = links.agg(F.max("level")).first()[0]
    level = -(-((top if top is not None else -1) + 1) // HEIGHT) * HEIGHT
    now = heads.select("tree", F.lit(0).cast("bigint").alias("idx"), "data")
    while level > until:
        level -= HEIGHT
        low = level

        def down(batches: Iterator[pa.RecordBatch], low: int = low) -> Iterator[pa.RecordBatch]:
            def rows(b: Block) -> list[tuple]:
                if b.key is None:
                    return []
                nodes = [ARITY * p + k for (at, p), run in sorted(b.runs.items()) if at == low for k in range(len(run) // 32)] or [0]
                return [(b.key[0], i, b.head[:32] + b.path(i) + b.head[32:]) for i in nodes]

            def batch(found: list[tuple]) -> pa.RecordBatch:
                columns = list(zip(*found, strict=True)) or [()] * 3
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["tree", "idx", "data"])

            now = Block(low)
            for b in batches:
                found: list[tuple] = []
                for tree, block, kind, at, idx, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    if (tree, block) != now.key:
                        found += rows(now)
                    now.take((tree, block), kind, at, idx, data)
                    if len(found) >= 4096:
                        yield batch(found)
                        found = []
                yield batch(found)
            yield batch(rows(now))

        dealt = streamed(now, links, low).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "level", "idx")
        now = scratch.save(dealt.mapInArrow(down, "tree string, idx bigint, data binary"), f"{name}-{low}")
    return now


PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proved(leaves: DataFrame, links: DataFrame, heads: DataFrame, root: bytes, with_proofs: bool) -> DataFrame:
    """PROVED for numbered leaves (tree, idx, doc_id, digest, altered), from the paths ``heads`` above their blocks."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Block(0)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.binary()] * with_proofs]
        for b in batches:
            out: list[tuple] = []
            for tree, block, kind, at, idx, data, doc, altered in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if kind != LEAF:
                    now.take((tree, block), kind, at, idx, data)
                    continue
                path = now.path(idx) + now.head[32:]
                found = folded(altered or data, path)
                proof = hashlib.sha256(siblings(path).encode()).hexdigest()
                out.append((doc, data.hex(), now.head[:32].hex(), root.hex(), proof, found.hex(), found == root, *[path] * with_proofs))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*(p.split(" ")[0] for p in PROVED.split(", ")), *["proof"] * with_proofs])

    none = {"doc_id": F.lit(None).cast("bigint"), "altered": F.lit(None).cast("binary")}
    rows = leaves.select("tree", F.call_function("div", F.col("idx"), F.lit(ARITY**HEIGHT)).alias("block"), F.lit(LEAF).alias("kind"), F.lit(0).alias("level"), "idx", F.col("digest").alias("data"), "doc_id", "altered")
    dealt = streamed(heads, links, 0).withColumns(none).unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "level", "idx")
    return dealt.mapInArrow(prove, PROVED + ", proof binary" * with_proofs)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", altered: dict[str, Column] | None = None, only: Column | None = None, with_proofs: bool = False) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (hex digests).

    ``altered`` has other values of fields, for rows where ``only`` holds; their folded_root comes
    from the leaf of these values and the siblings of the table as it is.  ``with_proofs`` adds the
    path itself (see ``steps``); ``folded`` and ``siblings`` read it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    try:
        now = [F.col(f"`{c}`") for c in fields]
        other = [(altered or {}).get(c, F.col(f"`{c}`")) for c in fields]
        tree = F.when(F.col(f"`{tree_col}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")))
        second = F.when(only, digest_of(other)) if altered and only is not None else F.lit(None).cast("binary")
        leaves = numbered(scratch, docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), digest_of(now).alias("digest"), second.alias("altered")), ["doc_id", "digest"], "leaves")
        found = climbed(scratch, leaves, "trees")
        roots = found.where(F.col("kind") == ROOT).select(F.col("tree").alias("name"), "digest")
        tops = scratch.save(numbered(scratch, roots.withColumn("tree", F.lit(TOP)), ["name"], "roots"), "roots")
        above = climbed(scratch, tops, "top")
        last = above.where(F.col("kind") == ROOT).select("digest").first()
        root = bytes(last[0]) if last else b""
        links, over = (f.where(F.col("kind") == LINK).select("tree", "level", "idx", "run") for f in (found, above))
        start = spark.createDataFrame([(TOP, bytearray(32))], "tree string, data binary")
        ends = paths(scratch, over, start, 0, "top-paths")
        # the first 32 bytes are the tree's own root from here on
        heads = tops.select("name", "digest", "idx").join(ends.select("idx", "data"), "idx").select(F.col("name").alias("tree"), F.concat("digest", F.expr("substring(data, 33)")).alias("data"))
        blocks = paths(scratch, links, scratch.save(heads, "heads"), HEIGHT, "paths")
        return scratch.keep(proved(leaves, links, blocks, root, with_proofs))
    finally:
        scratch.close()


def op12_event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), *FIELDS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    only = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(docs, altered={"text": lowered}, only=only)


def _crc_table() -> list[int]:
    """The table of CRC-32, from the checksums of single bytes."""
    return [zlib.crc32(bytes([k ^ 0xFF])) ^ 0xFF000000 for k in range(256)]


def _oracle(levels: int = 7) -> str:
    """The same by windows and lists, level after level (up to ARITY ** levels leaves a tree and trees)."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    table_ = "[" + ", ".join(f"{x}::BIGINT" for x in _crc_table()) + "]"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"crc AS (SELECT {table_} AS t)",
        f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS altered FROM documents, crc)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size FROM leaves)",
        "a0 AS (SELECT lang, i, leaf AS h, size FROM placed)",
    ]
    climb = lambda p, by, k: [
        f"{p}run{k} AS (SELECT {by}, i // 8 AS i, list(h ORDER BY i) AS run FROM {p}{k} WHERE size > 1 GROUP BY {by}, i // 8)",
        f"{p}{k + 1} AS (SELECT {by}, i // 8 AS i, CASE WHEN any_value(size) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(size) + 7) // 8 AS size FROM {p}{k} GROUP BY {by}, i // 8)",
    ]
    for k in range(levels):
        out += climb("a", "lang", k)
    out.append(f"b0 AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS size FROM a{levels})")
    for k in range(levels):
        out += climb("b", "one", k)
    out.append("p0 AS (SELECT p.doc_id, p.lang, p.leaf, p.i, b.i AS top, b.h AS subroot, '' AS proof, p.altered AS f FROM placed p JOIN b0 b ON p.lang IS NOT DISTINCT FROM b.lang)")
    for k in range(2 * levels):
        run, place, on = (f"arun{k}", "p.i", "p.lang IS NOT DISTINCT FROM r.lang AND ") if k < levels else (f"brun{k - levels}", "p.top", "")
        at = f"({place} // {8 ** (k % levels)})"
        here = f"({at} % 8)"
        out.append(
            f"p{k + 1} AS (SELECT p.* REPLACE (CASE WHEN r.run IS NULL THEN p.proof ELSE p.proof || coalesce(array_to_string(r.run[1:{here}], ''), '') || coalesce(array_to_string(r.run[{here} + 2:], ''), '') END AS proof, "
            f"CASE WHEN r.run IS NULL THEN p.f ELSE sha256(coalesce(array_to_string(r.run[1:{here}], ''), '') || p.f || coalesce(array_to_string(r.run[{here} + 2:], ''), '')) END AS f) FROM p{k} p LEFT JOIN {run} r ON {on}{at} // 8 = r.i)"
        )
    root = f"(SELECT h FROM b{levels})"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = {root} AS verified FROM p{2 * levels}"


ORACLE_SQL = _oracle()
