"""Sharding along a Hilbert curve (DataFrame functions only).

Four metadata dimensions (language, source, length of the text, document id) are quantised to
eight bits each by their approximate quantiles, so that outliers and the width of a range do not
matter, Skilling's transform turns the cell into its index on the curve, documents are
sorted by it, and the sequence is cut into runs.  Neighbours on the curve share values in
several dimensions, so the minima and maxima of a shard prune in each of them.

The law is ``rows``: shard = rank * shards div rows, so counts are at most one apart.

Defined results: ids may be any of the 64-bit range; a null text counts as empty; a null dimension
is the lowest cell; equal keys by checksum and size, and rows equal in all of these share their places in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, plain, table

SHARDS = 40
BITS = 8
OVERHEAD = 16
#: Leading bytes of a string that order it.
HEAD = 6


def head(c: Column) -> Column:
    """The first HEAD bytes of a string as an integer; keeps the byte order of strings."""
    return F.conv(F.hex(F.rpad(F.substring(F.encode(c, "utf-8"), 1, HEAD), HEAD, F.lit(b"\0"))), 16, 10).cast("bigint")


def magnitude(c: Column) -> Column:
    """A count on a logarithmic scale with eight steps an octave, in integers (0 for 0)."""
    e = F.length(F.bin(c)) - 1
    return F.when(c <= 0, F.lit(0)).otherwise(e * 8 + F.call_function("shiftright", c * 8, e) - 8).cast("bigint")


def spread(c: Column, cuts: list[int]) -> Column:
    """The number of cuts (ascending, below 2**BITS of them) up to the value, by halving steps; null is cell 0."""
    if not cuts:
        return F.lit(0).cast("bigint")
    ladder = F.array(*(F.lit(str(k)).cast("bigint") for k in cuts))
    steps = F.array(*(F.lit(1 << b) for b in range(BITS - 1, -1, -1)))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ladder, at + step - 1) <= c, at + step).otherwise(at))
    return F.when(c.isNull(), F.lit(0)).otherwise(found).cast("bigint")


def curve(axes: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of a cell by Skilling's transform, as folds over arrays."""
    n = len(axes)
    x = F.array(*(a.cast("bigint") for a in axes))

    def undo(x: Column, k: Column) -> Column:
        i = (k % n).cast("int")
        q = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(bits - 1) - F.floor(k / n)).cast("int"))
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        flip = F.when(own.bitwiseAND(q) != 0, q - 1).otherwise(F.lit(None))
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        return F.transform(x, lambda v, j: F.when(flip.isNotNull(), F.when(j == 0, v.bitwiseXOR(flip)).otherwise(v)).otherwise(F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    x = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), x, undo)
    # Gray code: each axis takes the exclusive or of those before it
    grown = F.aggregate(x, F.array().cast("array<bigint>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")).bitwiseXOR(v))))

    def index(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        qs = F.array(*(F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)))
        t = F.aggregate(qs, F.lit(0).cast("bigint"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        order = F.sequence(F.lit(0), F.lit(bits * n - 1))
        bit = lambda k: F.call_function("shiftright", F.get(g, (k % n).cast("int")).bitwiseXOR(t), (F.lit(bits - 1) - F.floor(k / n)).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
        return F.aggregate(order, F.lit(0).cast("bigint"), lambda h, k: h * 2 + bit(k))

    return F.get(F.transform(F.array(grown), index), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), curve_index.

    Ranks come from a range exchange by (curve index, document id), a sort within each range and
    the counts of the ranges; no task sees more than its range, and text stays out of the exchange.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hilbert")
    try:
        size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + OVERHEAD
        crc = F.coalesce(F.crc32(F.encode(F.col(text_col), "utf-8")), F.lit(0)).cast("bigint")
        axes = {"d0": head(F.col(lang_col)), "d1": head(F.col(source_col)), "d2": magnitude(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")), "d3": F.col(id_col).cast("bigint")}
        narrow = scratch.save(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *(c.alias(k) for k, c in axes.items())), "narrow")
        shares = [k / 2**BITS for k in range(1, 2**BITS)]
        bounds = narrow.agg(F.count("*").alias("n"), *(F.percentile_approx(k, shares, 10_000).alias(k) for k in axes)).first()
        cells = [spread(F.col(k), bounds[k] or []) for k in axes]
        placed = narrow.select("doc_id", "size", "text_crc32", curve(cells).alias("curve_index"))
        ordered = placed.repartitionByRange("curve_index", "doc_id", "text_crc32").sortWithinPartitions("curve_index", "doc_id", "text_crc32", "size")
        runs = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "runs").withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
        # as many rows as the exchange has partitions
        before = runs.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        n, total = F.lit(shards).cast("bigint"), F.lit(max(bounds["n"], 1)).cast("bigint")
        ranked = runs.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("row"))
        shard = F.call_function("div", F.col("rank") * n, total)
        first = F.call_function("div", F.col("shard") * total + n - 1, n)
        out = ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")
        return scratch.keep(out)
    finally:
        scratch.close()


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Write whole documents (ids unique) into folders shard=k, in curve order; returns shard bounds for pruning."""
    key = fresh(docs, "_id")
    plan = hilbert_shards(docs, shards, id_col, **columns).select(F.col("doc_id").alias(key), "shard", "slot")
    placed = docs.join(plan, F.col(f"`{id_col}`").eqNullSafe(F.col(key))).drop(key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    kinds = {c: t for c, t in back.dtypes if t in ("string", "bigint", "int", "double", "timestamp") and c not in ("shard", "text")}
    return back.groupBy("shard").agg(F.count("*").alias("n_rows"), *(f(c).alias(f"{k}_{c}") for c in kinds for k, f in (("min", F.min), ("max", F.max))))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(plain(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"))
