"""Quality classifier as a sparse rule ensemble: paths of a small forest become conjunctive rules over text statistics, a lasso
logistic regression keeps a few of them, and the kept rules are compiled into one Spark column expression.

Statistics are taken from the whole text of every row. Only the fit uses a bounded sample of the labelled rows (``SAMPLE``)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import smallest_hashes
from tomeflow.session import cut

#: Most labelled rows the fit uses; the rows with the smallest hash of their id are taken.
SAMPLE = 20_000
TREES = 12
DEPTH = 3
LASSO = 0.001
THRESHOLD = 0.3

BLOCK = 64

STATS = (
    "n_words", "mean_word", "distinct_in_block", "repeated_next", "top_word", "upper", "digits", "symbols", "pipes", "marks_per_word",
    "lines_per_word", "commas_stops",
)

_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58)))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = (np.arange(256) < 128) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_SPACE & ~np.isin(np.arange(256), list(b".,"))


def stats_of(text: str | None) -> tuple[float, ...]:
    """The statistics ``STATS`` of one text; all zero for null, empty and blank texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    if not found:
        return (0.0,) * len(STATS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, chars = len(found), int(count[~_SPACE].sum())
    tally = Counter(found)
    distinct = sum(len(set(found[k : k + BLOCK])) for k in range(0, n, BLOCK))  # by block, so that long texts compare with short ones
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    symbols = int(count[_SYMBOL].sum())
    return (
        float(n), chars / n, distinct / n, sum(map(bytes.__eq__, found[1:], found)) / n, max(tally.values()) / n,
        int(count[_UPPER].sum()) / letters, int(count[_DIGIT].sum()) / chars, symbols / chars,
        int(count[124]) / n, symbols / n, int(count[10]) / n, int(count[44] + count[46]) / n,
    )


def stats(text: Column) -> Column:
    """Struct of the statistics ``STATS`` (doubles)."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([stats_of(x) for x in batch], columns=list(STATS), dtype="float64")

    return udf(text)


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions: each rule is a tuple of (statistic, is_at_most, threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, row: Column) -> Column:
        """Probability of label 1 as a column expression over the struct ``row`` of statistics."""
        z = F.lit(self.intercept)
        for terms, weight in self.rules:
            z = z + F.when(rule_column(terms, row), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_column(terms: tuple[tuple[str, bool, float], ...], row: Column) -> Column:
    out = F.lit(True)
    for name, at_most, limit in terms:
        out = out & ((row[name] <= limit) if at_most else (row[name] > limit))
    return out


def tree_paths(text: str, names: tuple[str, ...]) -> set[tuple[tuple[str, bool, float], ...]]:
    """Every path from a root to a node below it, as a conjunction, read from the printed form of a tree or forest.
    Terms on one statistic and side are merged to the tightest."""
    paths, open_terms = set(), []
    for line in text.splitlines():
        if not (m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+?)\)$", line)):
            if re.match(r"\s*Tree \d+", line):
                open_terms = []
            continue
        depth = len(m[1])
        open_terms = [t for t in open_terms if t[0] < depth] + [(depth, names[int(m[2])], m[3] == "<=", float(m[4]))]
        tight: dict[tuple[str, bool], float] = {}
        for _, name, at_most, limit in open_terms:
            old = tight.get((name, at_most), limit)
            tight[name, at_most] = min(old, limit) if at_most else max(old, limit)
        paths.add(tuple(sorted((name, at_most, limit) for (name, at_most), limit in tight.items())))
    return paths


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Rules:
    """Fit on rows (label 0/1, row struct of statistics), all of which are used.

    Without labelled rows of both kinds the result has no rules: the score is the share of label 1 (0.5 without any row)."""
    picked = cut(labelled.select(F.col("label").cast("double").alias("label"), *(F.col("row")[s].alias(s) for s in STATS)))
    n, ones = picked.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = min(max((ones + 0.5) / (n + 1), 0.01), 0.99)
        return Rules(float(np.log(share / (1 - share))), ())
    train = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(picked.coalesce(2))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(train)
    paths = sorted(tree_paths(forest.toDebugString, STATS))
    named = picked.select("label", *(rule_column(p, F.struct(*STATS)).cast("double").alias(f"r{i}") for i, p in enumerate(paths)))
    rows = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="features").transform(named).select("label", "features").coalesce(2)
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(rows)
    weights = model.coefficients.toArray()
    return Rules(float(model.intercept), tuple((p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-9))


def classify(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs``, then ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if the score is at least
    ``THRESHOLD``); own columns with those two names are replaced.

    ``labels`` (doc_id, ``label``) are learned from where ``learn`` holds for their id; the ``sample`` labels with the smallest
    hash of id are used, so what is broadcast is bounded. Null labels and null ids are not learned from; a row labelled twice
    counts twice; null and empty texts get the score of all-zero statistics; repeated rows are scored each; an empty table gives
    an empty result, and without labels of both kinds all rows get one score."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).where("__id is not null and __label is not null")
    picked = cut(smallest_hashes(known.where(learn(F.col("__id"))), sample, "__id", "__label"))
    taught = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id")
    rules = fit(taught.select(F.col("__label").alias("label"), stats(F.col("__text")).alias("row")))
    scored = docs.withColumn("__row", stats(F.col(text))).withColumn("score", rules.score(F.col("__row")))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)).drop("__row")
