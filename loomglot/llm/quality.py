"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on a bounded sample of labelled rows; every path from a root becomes a conjunctive rule; lasso logistic
regression weighs the rules and most weights end at zero; the remaining rules are compiled into one column expression.
Statistics come from built-in string functions over whole texts, so scoring is one map over the scan.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import documents

#: Labelled rows used for the fit at most; taken in the order of a hash of their id.
SAMPLE_ROWS = 4000
ROUNDS, DEPTH, RATE, PENALTIES = 25, 3, 0.4, (0.03, 0.01, 0.003, 0.001)
VALIDATION = 5  # every fifth row of the sample chooses the penalty


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a whole text and its words, by name; all are finite doubles, 0 (or 1: words, lines) for an empty text."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "chars": F.char_length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "repeats": count(r"(?<!\S)(\S++)(?=\s\1(?!\S))"),
        "upper": count(r"\p{Lu}"),
        "letters": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{L}++", ""))).cast("double"),
        "digits": count(r"[0-9]"),
        "symbols": count(r"[^\p{L}\p{N}\s.,;:'\"()?-]"),
        "bars": count(r"[|•]"),
        "ends": count(r"[.!?](?!\S)"),
        "commas": count(r","),
        "lines": count(r"\n") + 1,
    }


#: Inputs of the rules: a numerator and a denominator among the statistics.
RATIOS = {
    "log_words": None,
    "distinct": ("distinct_words", "words"),
    "repeats": ("repeats", "words"),
    "upper": ("upper", "letters"),
    "letters": ("letters", "chars"),
    "digits": ("digits", "chars"),
    "symbols": ("symbols", "words"),
    "bars": ("bars", "words"),
    "ends": ("ends", "words"),
    "commas": ("commas", "words"),
    "word_length": ("letters", "words"),
    "line_words": ("words", "lines"),
}


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and the columns ``__f_<name>``; a null text counts as empty.

    The statistics come out of a one-row ``explode``: a filter on the score above cannot be pushed through it, which would write each statistic's
    regular expression out again in every rule. They are computed in a lambda, so that generated code stays small enough to be compiled.
    """
    own = F.transform(F.array(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.struct(t.alias("t"), F.split(t, r"\s+").alias("w")))
    found = F.transform(own, lambda x: F.struct(*(c.alias(k) for k, c in statistics(x["t"], x["w"]).items())))
    df = df.select("*", F.explode(found).alias("__s"))
    ratio = lambda a, b: F.col(f"__s.{a}") / F.greatest(F.col(f"__s.{b}"), F.lit(1.0))
    return df.withColumns({f"__f_{k}": F.log1p("__s.words") if pair is None else ratio(*pair) for k, pair in RATIOS.items()}).drop("__s")


@dataclass(frozen=True)
class Rules:
    """``sigmoid(bias + sum of the weights of the rules that hold)``."""

    bias: float
    weighted: tuple[tuple[float, tuple[tuple[int, float, bool], ...]], ...]

    def column(self) -> Column:
        names = list(RATIOS)

        def holds(rule):
            parts = (F.col(f"__f_{names[f]}") <= F.lit(t) if at_most else F.col(f"__f_{names[f]}") > F.lit(t) for f, t, at_most in rule)
            return functools.reduce(lambda a, b: a & b, parts)

        z = functools.reduce(lambda a, b: a + b, (F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.weighted), F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_matrix(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for f, t, at_most in rule:
            out[:, k] &= x[:, f] <= t if at_most else x[:, f] > t
    return out.astype(float)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on mean log-loss plus ``penalty`` times the L1 norm; the bias is free."""
    a = np.hstack([np.ones((len(r), 1)), r])
    rate = 4 / max(1e-9, np.linalg.norm(a, 2) ** 2 / len(a))
    w = z = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(steps):
        step = z - rate * (a.T @ (trees.sigmoid(a @ z) - y)) / len(a)
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = step + (momentum - 1) / after * (step - w), step, after
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """The ensemble for labelled rows, however few; only where a class is missing there is nothing to tell apart, and the score is constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))), ())
    _, grown = trees.boost(x, y, ROUNDS, DEPTH, RATE, least=max(1, min(5, len(y) // 8)))
    rules = sorted({p for t in grown for p in trees.paths(t)})
    if not rules:  # no statistic differs
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))), ())
    r = rule_matrix(x, rules)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows count once
    rules, r = [rules[k] for k in sorted(first)], r[:, sorted(first)]
    held = np.arange(len(y)) % VALIDATION == 0
    if len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)  # too few rows to spare any: the penalty is chosen on those of the fit

    def loss(penalty):
        b, w = lasso_logistic(r[~held], y[~held], penalty)
        judged = held if held.any() else ~held
        p = np.clip(trees.sigmoid(b + r[judged] @ w), 1e-6, 1 - 1e-6)
        return -np.mean(y[judged] * np.log(p) + (1 - y[judged]) * np.log(1 - p))

    bias, weights = lasso_logistic(r, y, min(PENALTIES, key=loss))
    return Rules(bias, tuple((float(w), rules[k]) for k, w in enumerate(weights) if abs(w) > 1e-6))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Learn from labelled rows outside the held-out fold.

    Rows without a quality label are left out; of several labels of an id the lowest counts. The sample is
    bounded by ``sample_rows``: ids in the order of their hash.
    """
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))  # bounded by sample_rows
    rows = rows.withColumn("__order", F.xxhash64("doc_id", "text")).orderBy("__order").limit(sample_rows)
    got = with_features(rows).select("__y", "__order", *(f"__f_{k}" for k in RATIOS)).orderBy("__order").collect()
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(RATIOS))
    return fit_rules(x, np.array([float(r["__y"]) for r in got]))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """``docs`` and the columns ``score`` (0 to 1, higher: better) and ``predicted``; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    out = with_features(docs.select(*names)).withColumn("score", rules.column())
    return out.select(*names, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored by their (zero) statistics; null ids stay and are not held out; repeated rows get
    equal scores; a very long text is scored whole, in time that grows with its length; an empty table gives no rows; without labels every score is 0.5. ``lang``, ``source``, ``doc_id`` and labels are
    no inputs of a score.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def crc_fold(doc_id: int) -> int:
    """The fold of an id, in plain Python."""
    return zlib.crc32(str(doc_id).encode()) % 3
