"""Statistics of whole texts, counted in one pass; shared by the quality rules and the classifier.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  A null text has no words, lines or
characters: all its counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_bangs", "n_punct", "n_high", "n_bytes"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Leading bits of a hash by which labelled rows are counted.
SLOT_BITS = 14

_SPACE, _TAIL, _UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _PUNCT, _HIGH, _OTHER = range(10)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _PUNCT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = _UPPER, _LOWER, _DIGIT
_KIND[list(SYMBOLS)], _KIND[0x21] = _SYMBOL, _BANG
_KIND[0x80:0xC0], _KIND[0xC0:] = _TAIL, _HIGH
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur at two or more places of the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _FACTORS[k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[tuple, int] = {}  # exact: equal hashes are compared word by word
    starts = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(maybe).tolist():
        key = tuple(words[i : i + WINDOW])
        if key in seen:
            for j in (i, seen[key]):
                starts[j] = 1
        else:
            seen[key] = i
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one UTF-8 text."""
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=10)
    words = text.split()
    lines = text.split(b"\n")
    seen, again = set(), 0
    for line in lines:
        if line in seen:
            again += bool(line.strip())
        else:
            seen.add(line)
    n = len(text)
    return (
        len(words), n - int(kinds[_SPACE]) - int(kinds[_TAIL]), int(kinds[_SYMBOL]), again, repeated_words(words), len(lines), len(set(words)),
        *(int(kinds[k]) for k in (_UPPER, _LOWER, _DIGIT, _BANG, _PUNCT, _HIGH)), n,
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = (0,) * len(COUNTS)
    for b in batches:
        rows = np.array([counts(t.as_buffer().to_pybytes()) if t.is_valid else none for t in b.column("text")], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def doc_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) for every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_count, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _per(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


#: Statistics learned from: ratios of the counts, as Spark expressions.
RATIOS: dict[str, Column] = {}


def ratios() -> dict[str, Column]:
    """Name to expression of each statistic."""
    if not RATIOS:
        RATIOS.update(
            words=F.col("n_words").cast("double"),
            word_length=_per("word_chars", "n_words"),
            symbol_share=_per("n_symbols", "word_chars"),
            dup_line_share=_per("n_dup_lines", "n_lines"),
            repeat_share=_per("n_repeat_words", "n_words"),
            distinct_share=_per("n_distinct", "n_words"),
            upper_share=_per("n_upper", "word_chars"),
            lower_share=_per("n_lower", "word_chars"),
            digit_share=_per("n_digits", "word_chars"),
            bang_share=_per("n_bangs", "word_chars"),
            punct_share=_per("n_punct", "word_chars"),
            high_share=_per("n_high", "word_chars"),
            words_per_line=_per("n_words", "n_lines"),
            bytes_per_word=_per("n_bytes", "n_words"),
        )
    return RATIOS


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, most: int, columns: list[str]) -> DataFrame:
    """The labelled rows, at most ``most``, those of lowest hash of the id: (columns..., label).

    ``most`` bounds what reaches the driver, whatever the tables hold.  Counts of labelled rows by the
    leading bits of the hash tell up to where the rows asked for reach, so partitions do not each hand on
    ``most`` rows.  Repeated labels count once; an id labelled both ways has a row of either kind; a
    repeated document has one for each of its rows.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where("_label in (0, 1) and _id is not null").distinct()
    slot = F.shiftright(F.xxhash64("_id"), 64 - SLOT_BITS)
    last, seen = -1 << (SLOT_BITS - 1), 0
    for r in stats.select("doc_id").join(known, F.col("doc_id") == F.col("_id")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).orderBy("slot").collect():  # 2 ** SLOT_BITS rows at most
        last, seen = r["slot"], seen + r["n"]
        if seen >= most:
            break
    joined = stats.join(known.where(slot <= last).withColumn("_at", F.xxhash64("_id")), F.col("doc_id") == F.col("_id"))
    return joined.orderBy("_at", "doc_id", "_label", *columns).limit(most).select(*columns, F.col("_label").alias("label"))
