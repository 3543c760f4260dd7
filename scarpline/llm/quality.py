"""Quality rules: a decision list learned from labelled statistics by sequential covering.

``statistics`` adds a text's counts. ``learn`` covers the rejected rows of a labelled sample: each rule is a conjunction
of thresholds, grown on two thirds of the rows by information gain, then pruned on the last third by its end conditions;
covered rows go, and the next rule is learned from the rest until none is precise enough. ``DecisionList.verdict`` is the
list as one ordered Spark conditional expression: the first rule that holds rejects, no rule keeps.

Null and empty texts have no words and zeros everywhere. Rows whose label is null are not learned from; without labelled
rows of both kinds the list is empty and keeps all. Labels of one document that contradict each other each count. The
sample that reaches the driver has at most ``sample_rows`` rows of numbers, taken by a hash of the id; all else covers
all rows. Repeated rows get equal results; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import release_memory, saved

#: What is counted in a text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MARKS = re.compile(r"[^\w\s#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")


def _counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    n = len(words)
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True) if n > 200_000 else (None, ids[:-1] * k + ids[1:])
        # Pairs are renumbered for long texts, so that pair and word fit 64 bits together.
        _, first, count = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        starts = count[first] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= starts
        repeated = int(covered.sum())
    lines = text.split("\n")
    seen: set[str] = set()
    doubles = filled = 0
    for line in lines:
        if line.encode("utf-8", "surrogatepass").split():
            filled += 1
            doubles += line in seen
            seen.add(line)
    word_chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    found = (len(p.findall(text)) for p in (_SYMBOLS, _UPPER, _MARKS, _DIGIT))
    symbols, upper, marks, digits = found
    return n, word_chars, symbols, doubles, repeated, filled, upper, marks, digits


@F.pandas_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def _count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    try:
        for batch in texts:
            yield pd.DataFrame([_counts(t or "") for t in batch], columns=COUNTS, dtype="int64")
    finally:
        release_memory()


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with the counts of its text; input columns of the same names are replaced."""
    rows = df.drop(*(c for c in COUNTS if c != text)).withColumn("_counts", _count(F.col(text)))
    return rows.select("*", *(F.col(f"_counts.{c}") for c in COUNTS)).drop("_counts")


def features() -> dict[str, Column]:
    """What rules may test: shares that don't depend on a text's length, and a few counts."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_share": F.col("n_upper") / chars,
        "marks_per_word": F.col("n_marks") / n,
        "digit_share": F.col("n_digits") / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, by_name: dict[str, Column]) -> Column:
        return by_name[self.feature] > self.threshold if self.above else by_name[self.feature] <= self.threshold

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction; the first that holds rejects."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self, by_name: dict[str, Column]) -> Column:
        """True for rows to keep."""
        found = F.lit(True)
        for rule in reversed(self.rules):
            both = rule[0].column(by_name)
            for c in rule[1:]:
                both = both & c.column(by_name)
            found = F.when(both, F.lit(False)).otherwise(found)
        return found

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["keep"])


def _matches(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for c in rule:
        held &= c.holds(x[:, names.index(c.feature)])
    return held


def _best(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[float, Condition]]:
    """For each feature and direction the threshold of most information gain over the rows that a rule covers so far, best first."""
    all_bad, n = bad.sum(), len(bad)
    found: list[tuple[float, Condition]] = []
    before = np.log2(all_bad / n)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, p = x[order, j], np.cumsum(bad[order])
        ends = np.flatnonzero(v[1:] > v[:-1])  # thresholds stand between different values
        if not len(ends):
            continue
        for above in (False, True):
            hit = all_bad - p[ends] if above else p[ends]
            size = n - 1 - ends if above else ends + 1
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1) / size) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                found.append((float(gain[k]), Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))))
    return sorted(found, key=lambda f: -f[0])


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], first: Condition, most: int) -> list[Condition]:
    rule = [first]
    held = first.holds(x[:, names.index(first.feature)])
    while len(rule) < most and 0 < bad[held].sum() < held.sum():
        more = _best(x[held], bad[held], names)
        if not more:
            break
        rule.append(more[0][1])
        held &= more[0][1].holds(x[:, names.index(more[0][1].feature)])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], *, precision: float = 0.95, support: int = 8, max_rules: int = 20, max_conditions: int = 4) -> DecisionList:
    """Rules for the rows marked bad.

    precision: share of bad rows that a rule must reach, both on the rows that it was pruned on and on all that are left;
    support: bad rows that it must cover at least. Rules are grown from the best condition on each feature; of those that
    are precise enough, each pruned to the shortest such rule, the one that covers most bad rows is taken.
    """
    rules: list[tuple[Condition, ...]] = []
    left = np.arange(len(x))
    while len(rules) < max_rules and support <= bad[left].sum() < len(left):
        grow, prune = left[np.arange(len(left)) % 3 != 0], left[np.arange(len(left)) % 3 == 0]
        if not bad[grow].any():
            break
        chosen: tuple[int, list[Condition]] | None = None
        for _, first in _best(x[grow], bad[grow], names):
            rule = _grow(x[grow], bad[grow], names, first, max_conditions)
            for k in range(1, len(rule) + 1):
                hit, tried = bad[left][_matches(x[left], names, rule[:k])], bad[prune][_matches(x[prune], names, rule[:k])]
                if hit.sum() >= support and hit.mean() >= precision and len(tried) and tried.mean() >= precision:
                    if chosen is None or hit.sum() > chosen[0]:
                        chosen = int(hit.sum()), rule[:k]
                    break
        if chosen is None:
            break
        rules.append(tuple(chosen[1]))
        left = left[~_matches(x[left], names, chosen[1])]
    return DecisionList(tuple(rules))


def _first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of the smallest hash of the key. Rows far above are left out first, so that no more than some above ``most`` meet."""
    hashed, total = F.xxhash64(key), rows.count()
    if total > most:
        share = (most + 6 * most**0.5 + 100) / total  # of equally spread hashes, this share holds ``most`` but for one case in 10^9
        few = rows.where(hashed <= int(-(1 << 63) + min(share, 1.0) * ((1 << 64) - 1)))
        rows = few if few.limit(most).count() == most else rows  # repeated keys can be spread unevenly
    return rows.orderBy(hashed, *rows.columns).limit(most)


def fit(counted: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", sample_rows: int = 50_000, **options) -> DecisionList:
    """Learn from the counted rows that have labels (quality 0 rejects, 1 keeps) and pass the base rules, ``sample_rows`` of them at most."""
    by_name = features()
    labelled = labels.where(F.col(quality).isNotNull()).select(F.col(doc_id).alias("_id"), (F.col(quality) == 0).alias("bad"))
    rows = counted.where(~base_failed()).join(labelled, F.col(doc_id) == F.col("_id")).select("_id", *(c.alias(n) for n, c in by_name.items()), "bad")
    sample = _first_by_hash(rows, "_id", sample_rows).toPandas()
    return learn(sample[list(by_name)].to_numpy(float), sample["bad"].to_numpy(bool), list(by_name), **options)


def fit_texts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = 50_000, **options) -> DecisionList:
    """As ``fit``, from texts that are not counted yet: only those of a sample of the labels are counted."""
    some = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, quality)
    some = _first_by_hash(some, doc_id, sample_rows)
    ids = F.broadcast(some.select(doc_id).distinct())  # sample_rows ids at most
    counted = saved(statistics(docs.join(ids, doc_id, "left_semi").select(doc_id, text), text).drop(text), "sample")
    return fit(counted, some, doc_id=doc_id, quality=quality, sample_rows=sample_rows, **options)


def base_failed() -> Column:
    """Too short, or more than half of the words in 3-word windows that recur."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(counted: DataFrame, rules: DecisionList) -> DataFrame:
    """Counted rows with base_failed and kept."""
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict(features()))
