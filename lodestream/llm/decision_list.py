"""Quality rules as a learned decision list.

Sequential covering grows one conjunction of thresholds at a time on two thirds of the remaining
labelled rows (FOIL gain), prunes its last conditions on the other third, keeps it while it is
precise there, and takes away what it covers.  The list is emitted as one ordered Spark
conditional expression: the first rule that holds rejects the document; none: it is kept.

Defined results: null and empty texts have zero counts and fail the base rules; without labelled
rows of both kinds the list is empty and only the base rules reject.  One row out per row in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, plain, table
from .docstats import COUNTS, doc_counts, labelled_sample, ratios

#: Bound on the labelled rows that rules are learned from.
MAX_LABELLED = 20_000
MAX_RULES = 24
MAX_CONDITIONS = 4
#: Thresholds tried for each statistic.
CUTS = 48
#: A rule is kept if so many of the pruning rows it covers are of the rejected kind.
PRECISION = 0.9


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        c = x[:, names.index(self.name)]
        return c > self.value if self.above else c <= self.value

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)


def covered(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    got = np.ones(len(x), bool)
    for c in rule:
        got &= c.holds(x, names)
    return got


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (live & ~bad).any():
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        base, best, pick = np.log2(p0 / (p0 + n0)), 1e-9, None
        for j, name in enumerate(names):
            values = x[live, j]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[live][order]
            low = np.unique(v)
            if len(low) < 2:
                continue
            cuts = np.unique(np.concatenate([low[np.unique(np.linspace(0, len(low) - 2, CUTS).astype(int))], np.quantile(v, np.linspace(0.01, 0.99, CUTS), method="lower")]))
            cuts = cuts[cuts < low[-1]]
            mid = (cuts + low[np.searchsorted(low, cuts, side="right")]) / 2
            k = np.searchsorted(v, mid, side="right")
            p_low = np.concatenate([[0], np.cumsum(b)])[k]
            n_low = k - p_low
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, pick = gain[i], Condition(name, above, float(mid[i]))
        if pick is None:
            break
        rule.append(pick)
        live &= pick.holds(x, names)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[list[Condition], float]:
    best, kept = -2.0, rule
    for k in range(len(rule), 0, -1):
        got = covered(rule[:k], x, names)
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best:
            best, kept = worth, rule[:k]
    return kept, (best + 1) / 2


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """The ordered rules that reject; rows are dealt to growing and pruning by their position."""
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and bad.sum() >= 6 and (~bad).any():
        prune = np.arange(len(x)) % 3 == 2
        if not (bad & ~prune).any():
            break
        rule = _grow(x[~prune], bad[~prune], names)
        if not rule:
            break
        rule, precision = _prune(rule, x[prune], bad[prune], names)
        got = covered(rule, x, names)
        if precision < PRECISION or not (got & bad).any():
            break
        rules.append(rule)
        x, bad = x[~got], bad[~got]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: number of the first rule that holds, else null."""
    found = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        every = F.lit(True)
        for c in rules[k]:
            every = every & c.column()
        found = F.when(every, F.lit(k)).otherwise(found)
    return found


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, rule (number of the rule that rejects, or null), kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    try:
        stats = scratch.save(doc_counts(docs, id_col, text_col), "counts")
        names = list(ratios())
        full = stats.select("*", *(c.alias(k) for k, c in ratios().items()))
        sample = labelled_sample(full, labels, label, MAX_LABELLED, names).toPandas()
        rules = learn(sample[names].to_numpy(np.float64), (sample["label"] == 0).to_numpy(), names)
        failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
        judged = full.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
        return scratch.keep(judged.select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept")))
    finally:
        scratch.close()


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    got = quality_rules(docs, plain(table(spark, sf_dir, "labels"), "doc_id", "quality"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
