"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics of each text are DataFrame expressions. From labelled statistics the learner grows one
conjunction of thresholds at a time for the bad class (by information gain on two thirds of the
rows), prunes it on the rest, removes what it covers, and stops when a rule is no longer precise.
The list is emitted as ordered CASE conditions.

Only DataFrame functions run on the data; the learner sees numbers of at most MAX_LABELLED rows,
those with the smallest hashes of the id. Nulls: a null text has no words and fails the base rules; a null doc_id
matches no label; null labels are ignored; of several labels of a document the lowest holds.
Repeated rows are each judged; the learner takes one of them, that with the least statistics. Ties of gain go to
the first statistic and the lowest threshold. Without labels the list is empty and base rules decide alone. Empty
table: no rows. Extra columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled rows that the learner sees.
MAX_LABELLED = 20_000
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
REPEAT_WINDOW = 8
#: The learner: candidate thresholds of a statistic, conditions of a rule, rules, least precision on the pruning rows.
CUTS, MAX_CONDITIONS, MAX_RULES, LEAST_PRECISION, LEAST_ROWS = 40, 4, 12, 0.9, 8


def _pairs(a: Column, n: Column, width: int) -> Column:
    """Hashes of windows of 2 * width words from hashes of windows of width words; n is the number of words."""
    size = F.greatest(n - 2 * width + 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), size), F.slice(a, F.lit(width + 1), size), lambda x, y: F.xxhash64(x, y))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column, width: int) -> Column:
    """Number of words in windows that occur twice or more: windows are sorted by hash, equal neighbours kept, and their places merged."""

    def again(tagged):
        last = F.size(tagged)
        same = F.filter(tagged, lambda x, k: ((k > 0) & (F.get(tagged, k - 1)["h"] == x["h"])) | ((k < last - 1) & (F.get(tagged, k + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def merged(places):
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(tagged, again), merged)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text, counts as long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = rows.withColumn("solid", F.regexp_replace("text", SPACE, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"n": F.size("words"), "lines": lines})
    rows = rows.withColumn("h8", F.transform("words", lambda w: F.xxhash64(w)))
    for width in (1, 2, 4):
        rows = rows.withColumn("h8", _pairs(F.col("h8"), F.col("n"), width))
    repeated = F.when(F.size(F.array_distinct("h8")) == F.size("h8"), F.lit(0)).otherwise(_covered(F.col("h8"), REPEAT_WINDOW))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        (F.length("solid") - F.length(F.translate("solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.regexp_count("solid", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("solid", r"[\p{L}]", "")).cast("long").alias("n_other"),
    )


def ratios() -> dict[str, Column]:
    """What rules test: numbers that don't depend on a text's length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "other_share": F.col("n_other") / chars,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.name) > self.value if self.above else F.col(self.name) <= self.value

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.value if self.above else v <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:g}"


def _grow(x, bad, names, weight_floor=1e-9):
    """Add the condition of most information gain until only bad rows are covered."""
    rule, rows = [], np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = bad[rows].sum(), rows.sum()
        if p0 == n0 or p0 == 0:
            break
        base, best = np.log2(p0 / n0), (weight_floor, None)
        for j, name in enumerate(names):
            v = x[rows, j]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf"))
            order = np.argsort(v, kind="stable")
            hits = np.concatenate([[0], np.cumsum(bad[rows][order])])
            below = np.searchsorted(v[order], cuts, "right")
            for above, n, p in ((False, below, hits[below]), (True, n0 - below, p0 - hits[below])):
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - base)
                gain[(p == 0) | (n == n0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        rows &= best[1].holds(x, names)
    return rule


def _covers(rule, x, names) -> np.ndarray:
    rows = np.ones(len(x), bool)
    for c in rule:
        rows &= c.holds(x, names)
    return rows


def _prune(rule, x, bad, names):
    """Drop last conditions while (bad - good) / covered doesn't fall on rows kept aside."""

    def worth(r):
        rows = _covers(r, x, names)
        return (2 * bad[rows].sum() - rows.sum()) / rows.sum() if rows.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """The decision list: each rule is a conjunction whose rows are bad."""
    rng = np.random.default_rng(3)
    left, rules = np.ones(len(bad), bool), []
    aside = np.zeros(len(bad), bool)
    aside[rng.permutation(len(bad))[: len(bad) // 3]] = True
    while len(rules) < MAX_RULES and bad[left & ~aside].any():
        grow, test = left & ~aside, left & aside
        rule = _grow(x[grow], bad[grow], names)
        if not rule:
            break
        rule = _prune(rule, x[test], bad[test], names)
        rows = left & _covers(rule, x, names)
        on_test = rows & aside
        checked = on_test if on_test.sum() >= LEAST_ROWS else rows
        if rows.sum() < LEAST_ROWS or bad[checked].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~rows
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as ordered conditions: the first rule that holds rejects, what none covers is kept."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Learn from statistics of labelled documents that pass the base rules."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    # The smallest hashes, exact at any number of labels.
    known = known.orderBy(F.xxhash64("label_id", F.lit(5)), "label_id").limit(MAX_LABELLED)
    tests = ratios()
    rows = stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("label_id")).select("label_id", "quality", F.struct(*[c.alias(k) for k, c in tests.items()]).alias("tests"))
    # Of rows with one id the least statistics count, so that reruns learn from the same rows.
    rows = rows.groupBy("label_id", "quality").agg(F.min("tests").alias("tests"))
    found = sorted((r.label_id, r.quality, *r.tests) for r in rows.collect())
    if not found:
        return []
    table = np.array([r[2:] for r in found], float)
    return learn(table, np.array([r[1] == 0 for r in found]), list(tests))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept for every document."""
    stats = common.materialize(spark, statistics(docs), "quality-statistics")
    rules = fit(spark, stats, labels)
    rows = stats.withColumns({"base_failed": base_failed()})
    names = [c for c in rows.columns if c not in ratios()] + ["n_words"]
    tested = rows.select(*[F.col(c) for c in names if c != "n_words"], F.col("n_words").alias("whole_words"), *[c.alias(k) for k, c in ratios().items()])
    kept = ~F.col("base_failed") & verdict(rules)
    return tested.select("doc_id", F.col("whole_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
