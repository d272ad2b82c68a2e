"""SimHash near-duplicate detection with multi-index hashing.

A fingerprint has 64 bits.  It is cut into two 32-bit segments; two fingerprints within three
bits agree up to one bit in at least one segment.  So each distinct fingerprint looks up the 33
keys of the radius-1 Hamming ball around each of its segments in the table of exact segments,
and the full distance is checked inside the join.

Defined results: null and word-less texts have fingerprint zero and link like any other; equal
fingerprints are one node; a null doc_id takes part but is never a component's name while another
is there (a component of null ids only has a null name).  Repeated rows stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, plain, table
from .components import components
from .nearcopies import near_copies

SEED = 42
SHINGLE = 3
RADIUS = 3


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of a UTF-8 text's word shingles (repeats count)."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n < size:
        cuts = [line]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        cuts = [line[a:b] for a, b in zip((ends - lengths)[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, len(cuts), 65536):
        h = np.array([digest(c, seed) for c in cuts[at : at + 65536]], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(cuts), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = pa.array((fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in b.column("text").cast(pa.large_binary())), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), got], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) for every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints of ``nodes`` (fp) within RADIUS bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.array(F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")), F.struct(F.lit(1).alias("part"), low.alias("value")))
    parts = nodes.select("fp", F.inline(segments))
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << k).cast("bigint") for k in range(32)))
    probes = parts.select(F.col("fp").alias("a"), "part", "value", F.explode(flips).alias("flip")).select("a", "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    # the planner does not see that a generator multiplies rows and might broadcast either side
    found = probes.join(parts.withColumnRenamed("fp", "b").hint("merge"), ["part", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id, n_links.

    Only distinct fingerprints are linked, so groups of copies of any size cost one node.
    n_links counts the other distinct fingerprints within RADIUS bits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    try:
        prints = scratch.save(fingerprints(docs, id_col, text_col), "prints")
        nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
        edges = scratch.save(links(nodes.select("fp")), "edges")
        degree = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
        roots = components(scratch, edges)
        named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        names = named.groupBy("root").agg(F.min("low").alias("component_id"))
        labels = scratch.save(named.join(names, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "labels")
        shown = prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
        return scratch.keep(shown)
    finally:
        scratch.close()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies (see ``nearcopies``), the one of the smallest id, then hash of the text.

    The fingerprints are wider than ``near_duplicates`` takes, over two-word shingles, and looked up by the same
    multi-index hashing.  Repeated rows of an id and text stay once; a different text under the same id is a row of its own.  Rows with a
    null id have no name to be kept under; they stay.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies")
    doc, print_, low, root = (fresh(docs, k) for k in ("_doc", "_print", "_low", "_root"))
    try:
        names = scratch.save(near_copies(scratch, docs, id_col, text_col).select(F.col("low").alias(doc), F.col("print").alias(print_)), "names")
        keyed = docs.where(F.col(f"`{id_col}`").isNotNull()).withColumns({low: F.col(f"`{id_col}`").cast("bigint"), root: F.xxhash64(F.col(f"`{text_col}`"))})
        kept = keyed.join(names.hint("merge"), (F.col(low) == F.col(doc)) & (F.col(root) == F.col(print_)), "left_semi").dropDuplicates([low, root])
        return scratch.keep(kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(F.col(f"`{id_col}`").isNull())))
    finally:
        scratch.close()


def op1_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))


#: DuckDB has no XXH64, so the query is tested against a brute-force version instead.
