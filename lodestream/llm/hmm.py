"""Language-model scores from a hidden Markov model over word classes.

Every word has a class that its letters and the list of the COMMON most frequent training tokens
decide: a common token is a class of its own, any other word falls into one of RARE classes by
its ending and length.  Latent states emit classes; a class emits its words by smoothed counts,
P(word | class) = (c + 0.1) / (C + 0.1 * (V + 1)) with C and V the tokens and distinct words of
the class and one share for unseen words.  Baum-Welch trains the states on all training documents:
these are dealt into BLOCKS blocks by a hash of their ids and classes, so the model does not depend on how the table is partitioned; a round sums the expected counts of one block, computed within
partitions by scaled forward-backward recursions, and the next model is made from the latest sums
of all blocks (incremental expectation-maximisation).  PASSES rounds cover each block.  The score
of a text is the exact log10 likelihood of its tokens and one end token: the scaled forward
recursion over its classes plus the word terms.

Word counts are distributed: tokens outside the LISTED most frequent ones are joined and summed
by shuffles keyed by the word, and are never collected or broadcast.  Listed tokens, which would
be the hot keys, never enter these joins.

Defined results: a null text has no words, so one token (the end); repeated rows are scored each;
with nothing to learn from, the base score is that of an empty vocabulary and the model is uniform.
Recursions over a text of more than SPAN tokens keep the state of every SPAN-th token and go back
span by span, so their memory does not grow with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, plain, table
from .hilbert import magnitude

#: Tokens with a class of their own, classes of the other words, latent states.
COMMON, RARE, STATES = 4096, 512, 8
#: Blocks that all training documents are dealt into, and passes over all blocks.
BLOCKS, PASSES = 8, 3
#: Most frequent tokens whose counts every task holds; the others are joined by the word.
LISTED = 65_536
#: Words, of those no document has counted yet, that a task's table holds before it is handed on.
HELD_WORDS = 400_000
#: Tokens of the documents whose recursions run together, and of one document between two kept states.
BATCH_TOKENS, SPAN = 400_000, 400_000
#: Documents whose tokens a task holds at once when it looks them up.
LOOKED = 512
HELD_OUT = 10
#: Stands for the end of a text; no word contains a space.
END = " "
SMOOTH = 0.1
_FLOOR = 1e-3


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def rare_class(word: bytes) -> int:
    """Class of a word outside the common list: by its last two bytes and its length."""
    return ((word[-1] * 31 + (word[-2] if len(word) > 1 else 7)) * 13 + min(len(word), 12)) % RARE


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) sums of runs of documents; a run ends when its table is full."""

    def out(table: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(table.keys(), pa.binary()), pa.array(table.values(), pa.int64())], names=["word", "n"])

    table: Counter = Counter()
    ends = 0
    for b in batches:
        for t in b.column("text"):
            ends += 1
            if t.is_valid:
                table.update(words(t.as_buffer().to_pybytes()))
                if len(table) > HELD_WORDS:
                    yield out(table)
                    table = Counter()
    if ends:
        table[END.encode()] += ends
    if table:
        yield out(table)


class Vocabulary:
    """The listed tokens, most frequent first, and the totals of all training tokens (bounded by LISTED)."""

    def __init__(self, listed: list[tuple[bytes, int]], tokens: int, distinct: int):
        self.at = {w: k for k, (w, _) in enumerate(listed)}
        self.tokens, self.distinct = tokens, distinct
        self.counts = np.array([c for _, c in listed], np.float64)
        self.classes = np.array([k if k < COMMON else COMMON + rare_class(w) for k, (w, _) in enumerate(listed)], np.int16)
        self.base = np.log10((self.counts + SMOOTH) / self.whole)
        #: the word's term within its class; a common token is its class
        self.inside = np.where(np.arange(len(listed)) < COMMON, 0.0, np.log10(self.counts + SMOOTH))

    @property
    def whole(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)

    def sequence(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Classes of a text's tokens with the end, places of the listed ones, and the other words."""
        tokens = [*words(text), END.encode()]
        at = np.fromiter((self.at.get(w, -1) for w in tokens), np.int64, len(tokens))
        codes = np.empty(len(tokens), np.int16)
        known = at >= 0
        codes[known] = self.classes[at[known]]
        other = np.flatnonzero(~known).tolist()
        rest = [tokens[k] for k in other]
        if rest:
            codes[other] = [COMMON + rare_class(w) for w in rest]
        return codes, at[known], rest


def most_frequent(counted: DataFrame, n: int) -> DataFrame:
    """The n words of largest count, ties by the word.

    A histogram of magnitudes (eight an octave) tells from which count on there are n words;
    only those are sorted, so partitions do not each hand on n rows.
    """
    sizes = counted.groupBy(magnitude(F.col("c")).alias("m")).agg(F.min("c").alias("low"), F.count("*").alias("n")).orderBy(F.desc("m")).collect()
    seen, low = 0, 0
    for r in sizes:
        seen, low = seen + r["n"], r["low"]
        if seen >= n:
            break
    return counted.where(F.col("c") >= low).orderBy(F.desc("c"), "word").limit(n)


@dataclass(frozen=True)
class States:
    start: np.ndarray  # (STATES,)
    step: np.ndarray  # (STATES, STATES)
    emit: np.ndarray  # (STATES, classes)


def initial(classes: np.ndarray) -> States:
    """A first model from the class totals, with fixed perturbations that set the states apart."""
    rng = np.random.default_rng(42)
    emit = (classes / classes.sum())[None, :] * (rng.exponential(1.0, (STATES, len(classes))) + 0.05)
    step = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(step, 0.9)
    return States(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=1, keepdims=True))


def _ragged(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of sequences, longest first: (their numbers, lengths, tokens step by step, offsets of the steps).

    Step t holds the t-th tokens of the sequences longer than t, which are the first ones of the run.
    """
    order = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i))
    at = 0
    while at < len(order):
        run, size = [], 0
        while at < len(order) and (not run or size + len(sequences[order[at]]) <= BATCH_TOKENS):
            run.append(order[at])
            size += len(sequences[order[at]])
            at += 1
        lengths = np.array([len(sequences[i]) for i in run])
        flat = np.concatenate([sequences[i] for i in run]).astype(np.int64)
        step = np.concatenate([np.arange(n) for n in lengths])
        by_step = np.argsort(step, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=int(lengths[0])))])
        yield run, lengths, flat[by_step], offsets


def likelihoods(m: States, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each class sequence by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    emit = np.ascontiguousarray(m.emit.T)
    for run, _, tokens, offsets in _ragged(sequences):
        total = np.zeros(len(run))
        alpha = None
        for t in range(len(offsets) - 1):
            e = emit[tokens[offsets[t] : offsets[t + 1]]]
            alpha = m.start * e if alpha is None else (alpha[: len(e)] @ m.step) * e
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[: len(e)] += np.log10(scale)
        out[run] = total
    return out


def _forward(m: States, e: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward states of one sequence's span and their scales; ``before``: the state ahead of it."""
    alpha, scale = np.empty_like(e), np.empty(len(e))
    for t in range(len(e)):
        before = (m.start if before is None else before @ m.step) * e[t]
        scale[t] = before.sum()
        before = alpha[t] = before / scale[t]
    return alpha, scale


def _expected_long(m: States, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``expected`` of one long sequence: only the states at the spans' borders are kept on the way forward."""
    emit = np.ascontiguousarray(m.emit.T)
    spans = [codes[k : k + SPAN].astype(np.int64) for k in range(0, len(codes), SPAN)]
    heads, last, fit = [], None, 0.0
    for x in spans:
        heads.append(last)
        alpha, scale = _forward(m, emit[x], last)
        last, fit = alpha[-1], fit + float(np.log10(scale).sum())
    step, seen = np.zeros((STATES, STATES)), np.zeros((m.emit.shape[1], STATES))
    beta, ahead = np.ones(STATES), None
    for x, head in zip(reversed(spans), reversed(heads), strict=True):
        e = emit[x]
        alpha, scale = _forward(m, e, head)
        gamma = np.empty_like(e)
        for t in range(len(x) - 1, -1, -1):
            if ahead is not None:
                step += np.outer(alpha[t], ahead) * m.step
                beta = m.step @ ahead
            gamma[t] = alpha[t] * beta
            ahead = e[t] * beta / scale[t]
        for k in range(STATES):
            seen[:, k] += np.bincount(x, gamma[:, k], len(seen))
    return gamma[0].copy(), step, seen.T, fit


def expected(m: States, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, step, emit) summed over sequences, and their log10 likelihood."""
    emit = np.ascontiguousarray(m.emit.T)
    start, step, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((m.emit.shape[1], STATES))
    fit = 0.0
    for x in sequences:
        if len(x) > SPAN:
            s, t, e, f = _expected_long(m, x)
            start, step, seen, fit = start + s, step + t, seen + e.T, fit + f
    for run, _, tokens, offsets in _ragged([x for x in sequences if len(x) <= SPAN]):
        steps = len(offsets) - 1
        e_all = emit[tokens]
        alpha, scale = np.empty_like(e_all), np.empty(len(tokens))
        for t in range(steps):
            now = slice(offsets[t], offsets[t + 1])
            e = e_all[now]
            a = m.start * e if t == 0 else (alpha[offsets[t - 1] : offsets[t - 1] + len(e)] @ m.step) * e
            c = a.sum(axis=1)
            scale[now] = c
            alpha[now] = a / c[:, None]
        fit += float(np.log10(scale).sum())
        gamma = np.empty_like(alpha)
        beta = np.ones((0, STATES))
        for t in range(steps - 1, -1, -1):
            n = int(offsets[t + 1] - offsets[t])
            ahead = np.ones((n, STATES))  # sequences that end here start from ones
            if len(beta):
                following = slice(offsets[t + 1], offsets[t + 1] + len(beta))
                weighted = e_all[following] * beta / scale[following][:, None]
                step += alpha[offsets[t] : offsets[t] + len(beta)].T @ weighted * m.step
                ahead[: len(beta)] = weighted @ m.step.T
            beta = ahead
            gamma[offsets[t] : offsets[t + 1]] = alpha[offsets[t] : offsets[t + 1]] * beta
        start += gamma[: len(run)].sum(axis=0)
        for k in range(STATES):
            seen[:, k] += np.bincount(tokens, gamma[:, k], len(seen))
    return start, step, seen.T, fit


def maximised(start: np.ndarray, step: np.ndarray, emit: np.ndarray, classes: np.ndarray) -> States:
    """The next model from summed counts; every class keeps a little of its overall share in each state."""
    share = classes / classes.sum()
    emit = emit + _FLOOR * emit.sum(axis=1, keepdims=True) * share + 1e-12
    start, step = start + 1e-6, step + 1e-6
    return States(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def train(coded: DataFrame, classes: np.ndarray, blocks: int = BLOCKS, passes: int = PASSES) -> tuple[States, list[float]]:
    """Baum-Welch over all rows of ``coded`` (codes binary: int16 classes; block int below ``blocks``).

    A partition hands on one row of counts for each position, STATES * (1 + STATES + classes) numbers;
    these are summed by position in a shuffle, so the driver gets the size of one model, and keeps that of
    ``blocks``.  The list has each pass's log10 likelihood, every block by the model that its round began with.
    """
    n = len(classes)
    model, fits, latest = initial(classes), [], np.zeros((blocks, STATES * (1 + STATES + n) + 1))
    for _ in range(passes):
        for block in range(blocks):

            def sums(batches: Iterator[pa.RecordBatch], m: States = model) -> Iterator[pa.RecordBatch]:
                total = np.zeros(STATES * (1 + STATES + n) + 1)
                for b in batches:
                    codes = [np.frombuffer(c.as_buffer(), np.int16) for c in b.column("codes")]
                    if codes:
                        s, t, e, fit = expected(m, codes)
                        total += np.concatenate([s, t.ravel(), e.ravel(), [fit]])
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["at", "value"])

            own = coded.where(F.col("block") == block).select("codes")
            got = own.mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
            latest[block] = 0
            latest[block, got["at"].to_numpy(np.int64)] = got["value"].to_numpy()
            total = latest.sum(axis=0)
            if total[:-1].any():
                s, t, e = total[:STATES], total[STATES : STATES * (1 + STATES)].reshape(STATES, STATES), total[STATES * (1 + STATES) : -1].reshape(STATES, n)
                model = maximised(s, t, e, classes)
        fits.append(float(latest[:, -1].sum()))
    return model, fits


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id leaves remainder 0 by HELD_OUT are held out of all counts.
    """
    scratch = Scratch(docs.sparkSession, "hmm")
    try:
        held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))
        narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
        counted = scratch.save(narrow.where(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c")), "counts")
        top = most_frequent(counted, LISTED).collect()  # a list of fixed size
        sums = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        vocabulary = Vocabulary([(bytes(r["word"]), r["c"]) for r in top], sums["n"] or 0, sums["v"])
        shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

        # tokens and distinct words of each rare class: everything but the common tokens
        def rare_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((RARE, 2), np.int64)
            for b in batches:
                for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True):
                    if shared.value.at.get(w, COMMON) >= COMMON:
                        total[rare_class(w)] += (c, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE, dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["class", "tokens", "kinds"])

        rare = np.zeros((RARE, 2))
        for r in counted.mapInArrow(rare_sums, "class int, tokens bigint, kinds bigint").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect():
            rare[r["class"]] = r["tokens"], r["kinds"]
        common = vocabulary.counts[:COMMON]
        classes = np.concatenate([common, np.zeros(COMMON - len(common)), rare[:, 0]]) + SMOOTH
        #: log10 of what the class's smoothed words are divided by
        divisor = np.log10(rare[:, 0] + SMOOTH * (rare[:, 1] + 1))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Per document its classes, the word terms known here, and its other words with their numbers of occurrence."""
            v = shared.value
            for b in (whole.slice(k, LOOKED) for whole in batches for k in range(0, whole.num_rows, LOOKED)):
                got = [v.sequence(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text")]
                base = [float(v.base[k].sum()) for _, k, _ in got]
                inside = [float(v.inside[k].sum() - divisor[s[s >= COMMON] - COMMON].sum()) for s, k, _ in got]
                rest = [Counter(r) for _, _, r in got]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
                ws = pa.ListArray.from_arrays(pa.array(offsets), pa.array([w for r in rest for w in r], pa.binary()))
                ns = pa.ListArray.from_arrays(pa.array(offsets), pa.array([n for r in rest for n in r.values()], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("held_out"), pa.array([s.tobytes() for s, _, _ in got], pa.binary()), pa.array([len(s) for s, _, _ in got], pa.int64()),
                        pa.array([len(k) for _, k, _ in got], pa.int64()), pa.array(base, pa.float64()), pa.array(inside, pa.float64()), ws, ns,
                    ],
                    names=["doc_id", "held_out", "codes", "n_tokens", "known", "base", "inside", "ws", "ns"],
                )

        looked = narrow.mapInArrow(look, "doc_id bigint, held_out boolean, codes binary, n_tokens bigint, known bigint, base double, inside double, ws array<binary>, ns array<int>")
        looked = looked.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("doc_id", "codes"), F.lit(BLOCKS)).cast("int"))
        looked = scratch.save(looked, "looked", by=["block"])
        model, _ = train(looked.where("not held_out").select("codes", "block"), classes)
        trained = docs.sparkSession.sparkContext.broadcast(model)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = likelihoods(trained.value, [np.frombuffer(c.as_buffer(), np.int16) for c in b.column("codes")])
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.float64())], names=[*b.schema.names[1:], "fit"])

        fitted = looked.select("codes", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "row")
        fitted = fitted.mapInArrow(fit, "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, inside double, row bigint, fit double")
        each = looked.select("row", F.inline(F.arrays_zip("ws", "ns"))).withColumnsRenamed({"ws": "word", "ns": "n"})
        met = each.join(counted.hint("merge"), "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
        per = F.log10((F.col("c") + F.lit(SMOOTH)) / F.lit(vocabulary.whole))
        inside = F.log10(F.col("c") + F.lit(SMOOTH))
        more = met.groupBy("row").agg(F.sum(F.col("n") * per).alias("b"), F.sum(F.col("n") * inside).alias("w"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
        joined = fitted.join(more.hint("merge"), "row", "left")
        none = F.lit(0.0)
        out = joined.select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("b", none)).alias("base_score"), (F.col("fit") + F.col("inside") + F.coalesce("w", none)).alias("score"),
        )
        return scratch.keep(out)
    finally:
        scratch.close()


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))
