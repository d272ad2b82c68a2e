"""Language identification by inference of a mixture of languages.

Character trigrams of letters (hashed to BUCKETS cells) are counted for each language over all
rows to learn from.  For a document, expectation-maximisation estimates the proportions of the
languages that its trigrams come from; the set of languages is then grown in the order of those
proportions while the likelihood gained exceeds a penalty.

Defined results: the LANGS languages of most rows are learned (ties: the first in code point
order); rows tagged otherwise teach nothing and are predicted like any other.  Null texts and texts
without a letter are ``und`` with score 0, as is everything when nothing could be learned.  Long texts
are counted by CHUNK characters, so only their code points are held.  score is the share of the predicted language among the chosen
set; ties go to the first language in code point order.  One row out per row in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table

BUCKETS = 1 << 16
#: Languages learned at most (what a task and the driver hold grows with them), and characters counted together.
LANGS, CHUNK = 128, 1 << 20
SMOOTHING = 0.05
ROUNDS = 25
SETTLED = 1e-4
#: Trigrams overlap, so about one in so many is independent evidence.
OVERLAP = 3
#: A further language must gain so many times half the log of the evidence, and hold this share.
PENALTY, LEAST_SHARE = 2.0, 0.03
HELD_OUT, HELD_REMAINDER = 4, 2
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams with a letter in the middle and their numbers; other characters count as one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, gap = [], np.zeros(1, np.uint64)
    for at in range(0, len(codes), CHUNK):
        c = codes[max(at - 1, 0) : at + CHUNK + 1]
        c = np.where(_letters()[c], c, 0).astype(np.uint64)
        c = np.concatenate([gap[: int(at == 0)], c, gap[: int(at + CHUNK >= len(codes))]])
        mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((mixed >> np.uint64(48)).astype(np.uint16)[c[1:-1] > 0])
    if len(parts) < 2:
        return np.unique(parts[0] if parts else np.zeros(0, np.uint16), return_counts=True)
    total = sum(np.bincount(p, minlength=BUCKETS) for p in parts)
    return np.flatnonzero(total).astype(np.uint16), total[total > 0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            u, n = trigrams(text)
            total[lang][u] += n
    for lang, n in total.items():
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], names=["lang", "cell", "n"])


@dataclass(frozen=True)
class Mixture:
    langs: list[str]
    probability: np.ndarray  # (languages, BUCKETS)
    own: np.ndarray  # mean log-likelihood of a trigram of the rows that each language was learned from

    def shares(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log-likelihood."""
        total = n.sum()
        share = np.full(len(p), 1 / len(p))
        for _ in range(ROUNDS if len(p) > 1 else 0):
            new = share * (p @ (n / (share @ p))) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < SETTLED:
                break
        return share, float(n @ np.log(share @ p))

    def infer(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The chosen languages with their shares, largest first, and the log-likelihood."""
        return self.infer_cells(*trigrams(text)) if text is not None else ([], 0.0)

    def infer_cells(self, u: np.ndarray, n: np.ndarray) -> tuple[list[tuple[str, float]], float]:
        if not len(u) or not self.langs:
            return [], 0.0
        p, n = self.probability[:, u], n.astype(np.float64)
        single = np.log(p) @ n
        every, _ = self.shares(p, n)
        first = int(np.argmax(single))
        chosen, share, fit = [first], np.ones(1), float(single[first])
        cost = PENALTY * 0.5 * np.log(max(n.sum() / OVERLAP, 2.0))
        for k in np.argsort(-every, kind="stable").tolist():
            if k in chosen:
                continue
            if every[k] < LEAST_SHARE:
                break
            wider, better = self.shares(p[[*chosen, k]], n)
            if (better - fit) / OVERLAP <= cost or wider.min() < LEAST_SHARE:
                break
            chosen, share, fit = [*chosen, k], wider, better
        found = sorted(zip((self.langs[k] for k in chosen), share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return found, fit

    def identified(self, text: str | None) -> bool:
        """Whether one learned language holds the text: it is likely enough in absolute terms, and not evenly mixed.

        Where no language was learned there is nothing to hold a text against, and all that have a letter stay.
        """
        u, n = trigrams(text or "")
        if not self.langs:
            return len(u) > 0
        found, fit = self.infer_cells(u, n)
        if not found or len(u) < FEW:
            return bool(found)
        each, blind = fit / float(n.sum()), -float(np.log(BUCKETS))
        if len(u) < ENOUGH:
            return each > blind
        known = sum(share * float(self.own[self.langs.index(k)]) for k, share in found)
        return each > (known + blind) / 2 and found[0][1] >= main_share(len(self.langs))


def learn(docs: DataFrame) -> Mixture:
    """Counts over all rows of (lang, text) with both; only sums by language and cell of LANGS languages reach the driver."""
    tagged = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    rows = docs.where(F.col("lang").isin([r["lang"] for r in tagged]) & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    n = np.zeros((len(langs), BUCKETS))
    n[[langs.index(x) for x in counts["lang"]], counts["cell"].to_numpy(np.int64)] = counts["n"].to_numpy()
    p = (n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return Mixture(langs, p, (n * np.log(p)).sum(axis=1) / np.maximum(n.sum(axis=1), 1))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, languages (chosen set with shares)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == HELD_REMAINDER, F.lit(False))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(learn(narrow.where(~held)))  # languages x BUCKETS numbers

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.infer(t)[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("held_out"),
                    pa.array([x[0][0] if x else UNKNOWN for x in found], pa.string()), pa.array([min(x[0][1], 1.0) if x else 0.0 for x in found], pa.float64()),
                    pa.array([",".join(f"{k}:{v:.3f}" for k, v in x) for x in found], pa.string()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return narrow.select("doc_id", held.alias("held_out"), "text").mapInArrow(infer, "doc_id bigint, held_out boolean, lang_pred string, score double, languages string")


#: Distinct trigrams below which a text with letters always stays, and from which all of the verdict holds.  Between
#: the two a text only has to be likelier than cells drawn blindly; short clean texts may look mixed or rare.
FEW, ENOUGH = 20, 60
#: How far the main language's share must be above an even mixture, of the way to the whole text.
ABOVE_EVEN = 0.2


def main_share(langs: int) -> float:
    """The share that the main language must hold: 0.4 with four languages, 0.6 with two."""
    return (1 + ABOVE_EVEN * (langs - 1)) / langs


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``Mixture.identified`` takes for one of the learned languages.

    Texts of ENOUGH distinct trigrams go when a trigram is less likely than halfway between what the training rows have and
    cells drawn blindly (noise, languages not learned), or when no language holds ``main_share``.  The verdict is computed beside the row itself, so nothing is joined or shuffled.
    """
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % HELD_OUT == HELD_REMAINDER, F.lit(False))
    narrow = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), held.alias("held"))
    model = docs.sparkSession.sparkContext.broadcast(learn(narrow.where(~F.col("held"))))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.value.identified(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(plain(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))
