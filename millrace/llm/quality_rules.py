"""Quality rules: a decision list learned from labels, applied as one Spark conditional expression.

text_statistics counts in each whole text what the rules speak about. learn_rules takes statistics of labelled documents and
covers the rejected ones rule by rule: a rule grows by the threshold with the best information gain until it covers no kept
document of the growing part, is pruned to what holds on the other part, and is taken while it is precise there; then what it
covers is taken away. rule_column turns the list into when(...).when(...).otherwise(0): the number of the first rule that
holds. No rule holds for documents that none describes: what the labels don't speak against is kept.

Null texts count as texts without words. Rows that repeat are returned as often as they come, a null id as it is. Other columns
are not read. Without labels, or without rejected ones among them, the list is empty and only the base rule decides.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, slices, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_adjacent")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))

#: What the rules may compare: names and Spark expressions of the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "adjacent_share": "n_adjacent / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float


Rule = tuple[Condition, ...]


def repeat_words(words: list, width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(windows) == len(set(windows)):
        return 0
    first: dict = {}
    covered = bytearray(len(words))
    ones = b"\x01" * width
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            covered[at : at + width] = ones
            covered[before : before + width] = ones
    return sum(covered)


def count_text(text: bytes) -> tuple[int, ...]:
    """The counts of COUNTS."""
    words = text.split()
    word_bytes = sum(map(len, words))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup_lines = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words), len(text.decode("utf-8", "replace")) - (len(text) - word_bytes), len(text) - len(text.translate(None, SYMBOLS)), dup_lines,
        repeat_words(words), len(lines), len(text) - len(text.translate(None, UPPER)), text.count(b"!"), sum(map(operator.eq, words, words[1:])),
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [count_text(text) for text in texts_of(batch)]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COUNTS])


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, *COUNTS) of every row of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_counts, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        held &= x[c.feature] >= c.threshold if c.at_least else x[c.feature] <= c.threshold
    return held


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, inside: np.ndarray) -> Condition | None:
    p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
    if not p0 or not n0:
        return None
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for name, column in x.items():
        values, labels = column[inside], y[inside]
        order = np.argsort(values, kind="stable")
        values, labels = values[order], labels[order]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        below, below_n = np.cumsum(labels)[cuts], np.cumsum(~labels)[cuts]
        middle = (values[cuts] + values[cuts + 1]) / 2
        for at_least, p, n in ((False, below, below_n), (True, p0 - below, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            k = int(np.argmax(gains))
            if gains[k] > gain:
                best, gain = Condition(name, at_least, float(middle[k])), gains[k]
    return best


def learn_rules(x: dict[str, np.ndarray], rejected: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, support: int = 5, seed: int = 7) -> list[Rule]:
    """Sequential covering of the rejected documents. x: a value of each feature for each document."""
    grow = np.random.default_rng(seed).random(len(rejected)) < 2 / 3
    left, rules = np.ones(len(rejected), bool), []
    while len(rules) < most_rules and (left & rejected & grow).sum() >= support:
        part = left & grow
        conditions: list[Condition] = []
        inside = part.copy()
        while len(conditions) < most_conditions and (found := _best_condition(x, rejected, inside)):
            conditions.append(found)
            inside = part & _covers(tuple(conditions), x)
        if not conditions:
            break
        held = left & ~grow

        def worth(rule: Rule) -> tuple[float, int]:
            on = held & _covers(rule, x)  # noqa: B023
            p, n = int((on & rejected).sum()), int((on & ~rejected).sum())
            return (p - n) / max(p + n, 1), p

        rule = max((tuple(conditions[:k]) for k in range(len(conditions), 0, -1)), key=worth)
        on = held & _covers(rule, x)
        p, n = int((on & rejected).sum()), int((on & ~rejected).sum())
        if p == 0 or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does. Reads the counts of COUNTS."""
    number = None
    for k, rule in enumerate(rules, 1):
        held = F.lit(True)
        for c in rule:
            value = F.expr(FEATURES[c.feature])
            held = held & (value >= c.threshold if c.at_least else value <= c.threshold)
        number = F.when(held, F.lit(k)) if number is None else number.when(held, F.lit(k))
    return F.lit(0) if number is None else number.otherwise(F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, held_out: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, quality) of at most `rows` labelled documents, chosen by a hash of the id among those whose bucket of
    `held_out` is not 0. A document labelled several times counts with its lowest label."""
    chosen = labels.where("doc_id is not null and quality is not null").where(bucket_of(F.col("doc_id"), held_out) != 0)
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = chosen.count()
    if labelled > rows:  # a share of the hashes first, so that what tasks send to be put in order stays near `rows` in all
        order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        chosen = chosen.where(order < int((1 << 30) * min(1, 1.2 * rows / labelled))).orderBy(order, "doc_id").limit(rows)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.join(F.broadcast(chosen), "doc_id")


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = 20_000, held_out: int = 5) -> list[Rule]:
    """Rules from at most `sample` labelled documents; those whose bucket of `held_out` is 0 are left for testing."""
    sampled = labelled_sample(docs, labels, sample, held_out)
    counted = text_statistics(sampled.withColumn("doc_id", F.struct("doc_id", "quality")))
    wanted = [F.expr(e).alias(n) for n, e in FEATURES.items()]
    pdf = counted.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.quality").alias("quality"), *wanted).toArrow().to_pandas().sort_values("id", kind="stable")
    if not len(pdf):
        return []
    return learn_rules({n: pdf[n].to_numpy(np.float64) for n in FEATURES}, pdf["quality"].to_numpy() == 0)


def apply_rules(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """counted with base_failed, rule and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, "rule": rule_column(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
