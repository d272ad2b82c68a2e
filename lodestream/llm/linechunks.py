"""Line deduplication by chunks of lines that start at every line.

A chunk is a line with words and the next one, with the blank lines between them, or a single
line of at least LINE_WORDS words.  Both borders of a chunk depend on its own lines only, and
chunks overlap, so a repeated passage of two such lines or more is covered from its first to its
last line whatever stands around it.  Chunks that occur more than once in the whole table are
removed after their first occurrence (smallest document id, then position), once their bytes
have been compared with those of the first occurrence.

Defined results: a null text has no lines and stays null; the first occurrence of a line always
stays, as no chunk that holds it is a repeat; chunks of one short line are never removed;
rows that repeat both id and text count as one document, so none of them loses what another
keeps; other rows under a repeated or null id are documents of their own, ordered by a hash of
their text; a null id comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, plain, table

#: Words that a line needs to be a chunk of its own.
LINE_WORDS = 50
#: Bytes of chunks gathered before they are handed on.
FLUSH = 4 << 20
_LAST = 2**63 - 1


def chunks(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """(start, end) line numbers of the chunks that can be removed; neither ever falls."""
    last = None
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        if last is not None:
            yield last, k + 1
        if len(line.split(None, LINE_WORDS - 1)) == LINE_WORDS:
            yield k, k + 1
        last = k


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, prints, starts, ends, hashes = [], [], [], [], []
        for doc, print_, text in zip(b.column("doc").to_pylist(), b.column("print").to_pylist(), b.column("text"), strict=True):
            if text.is_valid:
                lines = text.as_buffer().to_pybytes().split(b"\n")
                for i, j in chunks(lines):
                    ids.append(doc)
                    prints.append(print_)
                    starts.append(i)
                    ends.append(j)
                    hashes.append(xxhash.xxh64_intdigest(b"\n".join(lines[i:j])) - 2**63)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.int64())], names=["doc", "print", "i", "j", "h"])


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc", "print", "i", "j", "h", "first", "body"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    rows, size = [], 0
    for b in batches:
        for doc, print_, text, found in zip(b.column("doc").to_pylist(), b.column("print").to_pylist(), b.column("text"), b.column("found"), strict=True):
            if not text.is_valid:
                continue
            lines = text.as_buffer().to_pybytes().split(b"\n")
            for f in found.as_py():
                body = b"\n".join(lines[f["i"] : f["j"]])
                rows.append((doc, print_, f["i"], f["j"], f["h"], f["first"], body))
                size += len(body)
            if size > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells documents apart: the id (null as the largest bigint), and a hash of the text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)), F.xxhash64(F.col(f"`{text_col}`"))


def repeated_chunks(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, print, gone array<struct<i, j>>): line ranges to remove from each document; doc and print as in ``_keys``."""
    doc, print_ = _keys(id_col, text_col)
    narrow = docs.select(doc.alias("doc"), print_.alias("print"), F.col(f"`{text_col}`").alias("text"))
    every = scratch.save(narrow.mapInArrow(_find, "doc bigint, print bigint, i int, j int, h bigint"), "chunks")
    firsts = scratch.save(every.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc", "print", "i")).alias("at")).where("n > 1").select("h", F.col("at.doc").alias("first_doc"), F.col("at.print").alias("first_print"), F.col("at.i").alias("first_i")), "firsts")
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("print") == F.col("first_print")) & (F.col("i") == F.col("first_i"))
    again = every.join(firsts, "h").select("doc", "print", F.struct("i", "j", "h", is_first.alias("first")).alias("c"))
    by_doc = scratch.save(again.groupBy("doc", "print").agg(F.collect_set("c").alias("found")), "by_doc")
    bodies = scratch.save(narrow.join(by_doc.hint("merge"), ["doc", "print"]).mapInArrow(_take, "doc bigint, print bigint, i int, j int, h bigint, first boolean, body binary"), "bodies")
    kept = scratch.save(bodies.where("first").groupBy("h").agg(F.min("body").alias("kept")), "kept")
    same = bodies.where("not first").join(kept, "h").where("body = kept").select("doc", "print", F.struct("i", "j").alias("c"))
    return same.groupBy("doc", "print").agg(F.array_sort(F.collect_set("c")).alias("gone"))


def _cut(text: bytes, gone: list[dict]) -> tuple[bytes, int]:
    """The text without the lines of ``gone`` (ordered, may overlap), and how many went."""
    lines = text.split(b"\n")
    kept, at = [], 0
    for g in gone:
        kept += lines[at : g["i"]]
        at = max(at, g["j"])
    kept += lines[at:]
    return b"\n".join(kept), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with repeated chunks of lines cut out of the text.

    ``mark`` names two further columns: the lines a text had, and how many were removed.
    """
    key, hashed, doc, print_, ranges = (fresh(docs, k) for k in ("_key", "_hashed", "_doc", "_print", "_ranges"))
    scratch = Scratch(docs.sparkSession, "linechunks")
    try:
        gone = scratch.keep(repeated_chunks(scratch, docs, id_col, text_col).withColumnsRenamed({"doc": doc, "print": print_, "gone": ranges}))
    finally:
        scratch.close()
    names = docs.columns
    at, marks = names.index(text_col), list(mark or ())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in b.column(at)]
            gone = b.column(len(names)).to_pylist()
            done = [_cut(t, g) if t is not None and g else (t, 0) for t, g in zip(texts, gone, strict=True)]
            new = pa.array([t for t, _ in done], pa.binary()).cast(b.schema.field(at).type)
            columns = [*b.columns[:at], new, *b.columns[at + 1 : len(names)]]
            if marks:
                columns.append(pa.array([t.count(b"\n") + 1 if t is not None else 0 for t in texts], pa.int64()))
                columns.append(pa.array([n for _, n in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *marks])

    keyed = docs.withColumns(dict(zip((key, hashed), _keys(id_col, text_col), strict=True)))
    joined = keyed.join(gone.hint("merge"), (F.col(key) == F.col(doc)) & (F.col(hashed) == F.col(print_)), "left").select(*(F.col(f"`{c}`") for c in names), ranges)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{k}` bigint" for k in marks)])
    return joined.mapInArrow(cut, schema)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_lines`` without the documents of which no word is left though they had some."""
    had, lost = fresh(docs, "_had"), fresh(docs, "_lost")
    done = dedup_lines(docs, id_col, text_col, mark=(had, lost))
    words = F.length(F.regexp_replace(F.col(f"`{text_col}`"), "[\\x20\\x09-\\x0D]+", "")) > 0
    return done.where((F.col(lost) == 0) | words).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    done = dedup_lines(docs, mark=("n_lines", "n_removed"))
    crc = F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("bigint")
    return done.select("doc_id", "n_lines", "n_removed", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("kept_bytes"), crc.alias("kept_crc32"))
