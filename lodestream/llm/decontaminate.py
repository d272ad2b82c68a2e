"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased and their white space reduced to single spaces.  A benchmark item is cut
into windows of WINDOW characters (one each STRIDE, and one at its end; a shorter item is one
window); a window of m characters may differ by k = floor(ERROR * m) edits.  By the q-gram lemma
a text region within k edits shares at least m - q + 1 - k * q of the window's q-grams, and they
lie within k + 1 neighbouring diagonals.  Shared q-grams are counted in overlapping bands of
diagonals; bands that reach the bound are verified by an alignment confined to the band.  The
filter loses nothing: a document is reported exactly if some region of it aligns with a window
within k edits (k is lowered to (m - q) div q where that is less, so the bound is never below one).

Blocks of the benchmark have an index each.  With more than one, a sieve of fixed size over the
q-grams of all windows first takes out, in one pass, the few documents in which some region has
enough of them; only these are searched, block by block.

Defined results: null texts and texts or items of fewer than Q characters match nothing; items
repeated in the benchmark are reported each by its id; repeated rows of documents are judged and
reported each; of an empty table, or by an empty benchmark, nothing is found and nothing dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, plain, table

Q = 8
WINDOW, STRIDE = 100, 50
ERROR = 0.08
#: Diagonals from one band to the next; a band is wider by the edit budget.
STEP = 16
#: Characters of the benchmark searched for in one pass over the documents.
BLOCK_CHARS = 1_000_000
#: Candidates aligned at once, and bits of the table that q-grams are first looked up in.
AT_ONCE, TABLE_BITS = 2048, 22
#: Bits of the sieve over all blocks (16 MiB, whatever the benchmark's size).
SIEVE_BITS = 27
_M = 0x9E3779B97F4A7C15


def normal(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams (Q = 8, by doubling)."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h = c.astype(np.uint64)
    for k in (1, 2, 4):
        h = h[:-k] + h[k:] * np.uint64(pow(_M, k, 2**64))
    return (h ^ (h >> np.uint64(32))) * np.uint64(_M)


def windows(c: np.ndarray) -> list[np.ndarray]:
    if len(c) <= WINDOW:
        return [c] if len(c) >= Q else []
    starts = sorted({*range(0, len(c) - WINDOW + 1, STRIDE), len(c) - WINDOW})
    return [c[s : s + WINDOW] for s in starts]


def budget(size: np.ndarray) -> np.ndarray:
    """Edits that windows of so many characters may differ by."""
    return np.minimum(np.floor(ERROR * size).astype(np.int64), np.maximum(size - Q, 0) // Q)


def dense(hit: np.ndarray, least: int, reach: int) -> np.ndarray:
    """The places at which ``reach`` places with at least ``least`` hits begin."""
    sums = np.concatenate([[0], np.cumsum(hit)])
    span = min(reach, len(hit))
    return np.flatnonzero(sums[span:] - sums[:-span] >= least) if sums[-1] >= least else np.zeros(0, np.int64)


class Sieve:
    """Whether a text may hold a window of any block: a table of all q-grams, and the least bound."""

    def __init__(self) -> None:
        self.bits, self.least, self.reach = np.zeros(1 << (SIEVE_BITS - 3), np.uint8), 2**31, 0

    def add(self, index: Index) -> None:
        at = index.key >> np.uint64(64 - SIEVE_BITS)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if len(index.key):
            self.least, self.reach = min(self.least, index.least), max(self.reach, index.reach)

    def passes(self, text: str | None) -> bool:
        h = grams(normal(text or "")) >> np.uint64(64 - SIEVE_BITS)
        if not len(h) or not self.reach:
            return False
        hit = self.bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1
        return bool(len(dense(hit.astype(np.int64), self.least, self.reach)))


class Index:
    """Windows of a block of benchmark items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        found = [(item, w) for item, text in items for w in windows(normal(text))]
        self.item = np.array([i for i, _ in found], np.int64)
        self.text = [w for _, w in found]
        self.size = np.array([len(w) for w in self.text], np.int64)
        self.budget = budget(self.size)
        self.bound = np.maximum(self.size - Q + 1 - self.budget * Q, 1)
        hashes = [grams(w) for w in self.text]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.key, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.window = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.zeros(0, np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.widest = int(self.budget.max(initial=0))
        self.reach = int((self.size + self.budget).max(initial=0))
        self.least = int(self.bound.min()) if len(self.bound) else 1

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, windows found, least distance, place of that in the normalised text) of each item found."""
        c = normal(text)
        h = grams(c)
        if not len(h) or not len(self.key):
            return []
        hit = self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        # a region within the budget has at least ``least`` known q-grams within ``reach`` characters
        at = dense(hit, self.least, self.reach)
        if not len(at):
            return []
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + min(self.reach, len(h)), -1)
        places = np.flatnonzero(hit & (np.cumsum(edge)[:-1] > 0))
        k = np.searchsorted(self.key, h[places])
        k[k == len(self.key)] = 0
        real = self.key[k] == h[places]
        places, k = places[real], k[real]
        if not len(places):
            return []
        n = self.count[k]
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window, diagonal = self.window[entry], np.repeat(places, n) - self.place[entry] + WINDOW  # never negative
        band, into = np.divmod(diagonal, STEP)
        # bands overlap by the edit budget: a diagonal near a band's start also counts in those before it
        more = [(window, band)]
        for back in range(1, self.widest // STEP + 2):
            near = into + (back - 1) * STEP < self.budget[window]
            more.append((window[near], band[near] - back))
        pair = np.concatenate([w for w, _ in more]) * (1 << 40) + np.concatenate([b for _, b in more]) + 4
        pair, counts = np.unique(pair, return_counts=True)
        window, band = pair >> 40, (pair & ((1 << 40) - 1)) - 4
        keep = counts >= self.bound[window]
        window, band = window[keep], band[keep]
        best: dict[int, list[int]] = {}
        for s in range(0, len(window), AT_ONCE):
            for w, d, place in self.align(c, window[s : s + AT_ONCE], band[s : s + AT_ONCE] * STEP - WINDOW):
                old = best.setdefault(int(self.item[w]), [set(), d, place])
                old[0].add(w)
                if (d, place) < (old[1], old[2]):
                    old[1:] = d, place
        return [(item, len(ws), d, place) for item, (ws, d, place) in sorted(best.items())]

    def align(self, c: np.ndarray, window: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, distance, end in the text) of the candidates within their budget.

        low: the first diagonal of each band.  Start and end in the text are free; cells outside
        the band, widened by the budget on either side, are not reached.
        """
        if not len(window):
            return
        k = self.widest
        wide, most = STEP + 3 * k + 1, int(self.size[window].max())
        start = low - k
        at = start[:, None] + np.arange(wide + most)[None, :]
        text = np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)].astype(np.int64), -1)
        pattern = np.full((len(window), most), -2, np.int64)
        for r, w in enumerate(window.tolist()):
            pattern[r, : self.size[w]] = self.text[w]
        slope = np.arange(wide)
        dist = np.zeros((len(window), wide), np.int64)
        final = np.zeros_like(dist)
        for i in range(1, most + 1):
            step = dist + (text[:, i - 1 : i - 1 + wide] != pattern[:, i - 1 : i])
            step[:, :-1] = np.minimum(step[:, :-1], dist[:, 1:] + 1)
            dist = np.minimum.accumulate(step - slope, axis=1) + slope
            ended = self.size[window] == i
            final[ended] = dist[ended]
        j = final.argmin(axis=1)
        d = final[np.arange(len(window)), j]
        for r in np.flatnonzero(d <= self.budget[window]).tolist():
            yield int(window[r]), int(d[r]), int(start[r] + j[r] + self.size[window[r]])


_INDEX: dict[int, Index] = {}


def _index(key: int, items: list[tuple[int, str]]) -> Index:
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(items)
    return _INDEX[key]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_CHARS characters; only one block at a time is held."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null")
    for r in rows.orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sieved(docs: DataFrame, benchmark: DataFrame) -> Broadcast | None:
    """The sieve over all blocks, or None if there are fewer than two."""
    sieve, n = Sieve(), 0
    for n, block in enumerate(blocks(benchmark), 1):
        sieve.add(Index(block))
    return docs.sparkSession.sparkContext.broadcast(sieve) if n > 1 else None


def _rows(docs: DataFrame, text_col: str, wanted: Callable[[str | None], bool]) -> DataFrame:
    """The rows whose text ``wanted`` holds for, judged in place."""
    at = docs.columns.index(text_col)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([wanted(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(some, docs.schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, distance, at) for every document row and item found in it."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id bigint, item_id bigint, n_windows bigint, distance bigint, at bigint"
    sieve, scratch, found = _sieved(docs, benchmark), Scratch(docs.sparkSession, "leaks"), None
    try:
        if sieve:
            narrow = scratch.save(_rows(narrow, "text", lambda t: sieve.value.passes(t)), "maybe")
        for n, block in enumerate(blocks(benchmark)):

            def search(batches: Iterator[pa.RecordBatch], block: list = block, key: int = hash((n, tuple(block)))) -> Iterator[pa.RecordBatch]:
                index = _index(key, block)
                for b in batches:
                    rows = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t is not None for f in index.search(t)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["doc_id", "item_id", "n_windows", "distance", "at"])

            part = narrow.mapInArrow(search, schema)
            part = scratch.save(part, f"found{n}") if sieve else part
            found = part if found is None else found.unionAll(part)
        if found is None:
            found = docs.sparkSession.createDataFrame([], schema)
        return scratch.keep(found) if sieve else found
    finally:
        scratch.close()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; judged in place, without a join."""

    def clean(rows: DataFrame, n: int, block: list) -> DataFrame:
        key = hash((n, tuple(block)))
        return _rows(rows, text_col, lambda t: t is None or not _index(key, block).search(t))

    sieve = _sieved(docs, benchmark)
    if not sieve:
        for n, block in enumerate(blocks(benchmark)):
            docs = clean(docs, n, block)
        return docs
    scratch = Scratch(docs.sparkSession, "leaks")
    try:
        maybe = scratch.save(_rows(docs, text_col, lambda t: sieve.value.passes(t)), "maybe")
        for n, block in enumerate(blocks(benchmark)):
            maybe = scratch.save(clean(maybe, n, block), f"left{n}")
        return _rows(docs, text_col, lambda t: not sieve.value.passes(t)).unionByName(scratch.keep(maybe))
    finally:
        scratch.close()


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(plain(table(spark, sf_dir, "documents"), "doc_id", "text"), plain(table(spark, sf_dir, "benchmark"), "item_id", "text"))
