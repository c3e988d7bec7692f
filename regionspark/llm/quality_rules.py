"""Quality rules by learned decision lists, in Spark expressions only.

Statistics of whole texts are built-in expressions. A decision list is learned on the driver from the statistics of at
most ``MAX_TRAIN`` labelled rows, the first by a hash of the id (the bound is a parameter): sequential covering grows a
conjunction of thresholds that tells low quality from high by information gain on two thirds of the rows, prunes its
last conditions while that raises its worth on the other third, and removes what it covers; it ends when a rule is not
clearly better than chance. The rules become one ordered conditional expression (when, when, ..., otherwise).

Repeated three-word windows: windows are hashed to longs; a text whose hashes are all distinct has none (equal windows
have equal hashes). For the others the windows of repeated hashes are compared as text.

Defined cases: a null text has no words, lines or symbols and fails the base rules, as an empty one does; rows that
repeat are judged each; labels other than 0 and 1, null ids and labels of unknown rows are not learned from; without
labels of both classes there are no learned rules; an empty table gives an empty table. Only the id and the text are
read of the table that is judged.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_TRAIN = 5000
#: Repeated windows up to which membership is tested one by one.
FEW = 24

WHITE = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def covered_words(positions: Column, width: int = 3) -> Column:
    """Words covered by windows of ``width`` at rising positions."""
    steps = F.zip_with(F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))), positions, lambda b, a: F.when(b.isNotNull(), F.least(F.lit(width), b - a)))
    return F.when(F.size(positions) == 0, F.lit(0)).otherwise(
        F.lit(width) + F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(0), lambda total, x: total + x)
    )


def repeat_words(words: Column, hashes: Column) -> Column:
    """Words in three-word windows that the text holds twice or more."""

    def spelled(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def of_few(again: Column) -> Column:
        at = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
        return exact(at)

    def of_many(again: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            marked,
            lambda s: exact(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def exact(at: Column) -> Column:
        """Of the windows with a repeated hash those with a repeated text: sorted by text, equal ones are neighbours."""
        texts = F.array_sort(F.transform(at, lambda i: F.struct(spelled(i).alias("g"), i.alias("i"))))
        kept = let(
            texts,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        return let(kept, covered_words)

    repeated = let(
        F.sort_array(hashes),
        lambda s: F.array_distinct(F.filter(s, lambda h, k: F.coalesce(F.get(s, k + 1) == h, F.lit(False)))),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(repeated, lambda again: F.when(F.size(again) <= FEW, of_few(again)).otherwise(of_many(again)))
    )


FEATURES = ("symbol_share", "bang_share", "upper_share", "bar_share", "repeat_share", "dup_line_share", "distinct_share", "mean_word", "n_words")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str) -> DataFrame:
    """Counts of every whole text, and shares for the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        *carried,
        text.alias("t"),
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit("\x20\t\x0b\x0c\r")) != "").alias("lines"),
    )
    windows = split.withColumn("n", F.size("words")).withColumn(
        "hashes",
        F.when(
            F.col("n") >= 3,
            F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    counts = windows.select(
        "doc_id",
        *carried,
        F.col("n").cast("long").alias("n_words"),
        F.length(without(F.col("t"), WHITE)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(without(F.col("t"), "!"))).cast("long").alias("n_bangs"),
        (F.length("t") - F.length(without(F.col("t"), "|"))).cast("long").alias("n_bars"),
        (F.length("t") - F.length(without(F.col("t"), UPPER))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        repeat_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
    )
    # They pass through a generator of one element, below which a filter on them is not pushed: pushed down, a condition
    # would compute the statistics anew wherever it names them.
    names = [c for c in counts.columns if c != "doc_id" and c not in carried]
    counted = counts.select("doc_id", *carried, F.explode(F.array(F.struct(*names))).alias("c")).select("doc_id", *carried, "c.*")

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1)).cast("double")

    return counted.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_bangs", "word_chars").alias("bang_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_bars", "n_words").alias("bar_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("word_chars", "n_words").alias("mean_word"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, table: np.ndarray) -> np.ndarray:
        column = table[:, FEATURES.index(self.feature)]
        return column >= self.threshold if self.at_least else column < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold


def covered_by(rule: list[Condition], table: np.ndarray) -> np.ndarray:
    out = np.ones(len(table), dtype=bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def grow(table: np.ndarray, low: np.ndarray) -> list[Condition]:
    """Adds the condition of the largest information gain until no high row is covered or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(table), dtype=bool)
    while len(rule) < 4 and (inside & ~low).any():
        p0, n0 = (inside & low).sum(), (inside & ~low).sum()
        best, gain = None, 1e-6
        for f, feature in enumerate(FEATURES):
            values = np.unique(table[inside, f])
            if len(values) < 2:
                continue
            cuts = (values[:-1] + values[1:]) / 2
            if len(cuts) > 64:
                cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 64)))
            for threshold in cuts:
                for at_least in (True, False):
                    held = inside & (table[:, f] >= threshold if at_least else table[:, f] < threshold)
                    p, n = (held & low).sum(), (held & ~low).sum()
                    if p and (value := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(feature, at_least, float(threshold)), value
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return rule


def prune(rule: list[Condition], table: np.ndarray, low: np.ndarray) -> list[Condition]:
    """The prefix of the rule that is worth most on rows that it was not grown on: (p - n) / (p + n)."""

    def worth(some: list[Condition]) -> float:
        inside = covered_by(some, table)
        p, n = (inside & low).sum(), (inside & ~low).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn(table: np.ndarray, low: np.ndarray, precision: float = 0.9, rules: int = 12) -> list[list[Condition]]:
    """An ordered list of conjunctions, each of which tells low quality."""
    out: list[list[Condition]] = []
    third = np.arange(len(table)) % 3 == 0
    left = np.ones(len(table), dtype=bool)
    while len(out) < rules and (left & low & ~third).sum() >= 3:
        rule = grow(table[left & ~third], low[left & ~third])
        if third.any() and (left & third & low).any():
            rule = prune(rule, table[left & third], low[left & third])
        inside = covered_by(rule, table) & left
        p, n = (inside & low).sum(), (inside & ~low).sum()
        if not rule or p < 3 or p < precision * (p + n):
            break
        out.append(rule)
        left &= ~inside
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered conditional expression: false where a rule tells low quality."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """The decision list of at most ``max_train`` labelled rows of ``docs``."""
    learned = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .filter("_id is not null and _label in (0, 1)")
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train)
    )
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(learned), "_id")
    rows = statistics(some, "_id", "_text", "_label").select("doc_id", "_label", *FEATURES).collect()
    if not rows:
        return []
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), tuple(r)))
    table = np.array([[float(r[f]) for f in FEATURES] for r in rows])
    return learn(table, np.array([r["_label"] == 0 for r in rows]))


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = statistics(docs, id_col, text_col).withColumn("base_failed", failed)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return found.select(*names, verdict(rules).alias("kept"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Ids should be unique: rows that share an id
    stay if one of them does."""
    # cut, so that the filter is not pushed below the statistics, where it would compute them anew for each condition
    judged = cut(judge(docs, learn_rules(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col))
    kept = judged.filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
