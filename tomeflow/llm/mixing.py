"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token sums are taken per cell (source, language, topic) with partial aggregation, so a source with a third of all rows is one
number per task. Raking then works on the cells alone: each round scales them to one marginal after the other. Cells are written
to the shared folder every round. Texts never pass a shuffle: rates come back to the rows by a broadcast of checked size (beyond
it Spark shuffles)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeflow.llm.common import small
from tomeflow.session import cut

DIMENSIONS = ("source", "lang", "topic")
#: Targets where the caller gives none: each dimension's token shares to this power, normalised. 1 keeps them, 0 makes them equal.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
TOLERANCE = 1e-4
#: Rounds in which the error has to halve; raking ends when it does not.
PATIENCE = 20
CELL_ROWS = 100_000
TOPIC_ROWS = 500_000
SEED = 17
NONE = "(none)"


def _value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def unused(name: str, df: DataFrame) -> str:
    """``name`` with so many underscores before it that ``df`` has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def described(docs: DataFrame, topics: DataFrame | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one struct column ``__cell`` (source, lang, topic as strings) and ``__tokens`` (words of the whole text).
    ``topics`` (doc_id, topic) gives the topics; a document with several gets the largest. Null or missing values are ``NONE``."""
    topic, own = F.lit(NONE), docs.columns
    if topics is not None:
        given, key = unused("topic", docs), unused("id", docs)
        one = topics.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("topic").alias(given))
        docs = docs.withColumn(key, F.col(doc_id)).join(small(one, TOPIC_ROWS), key, "left").drop(key)
        topic = _value(F.col(given))
    cell = F.struct(*(_value(F.col(c) if c in own else F.lit(None)).alias(c) for c in ("source", "lang")), topic.alias("topic"))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(*(F.col(c) for c in own), cell.alias("__cell"), tokens.alias("__tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets (value, share) of one dimension: its token shares to ``power``, not yet normalised."""
    return cells.where("tokens > 0").groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, patience: int = PATIENCE) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``mass``, summing to 1, whose marginals meet ``targets`` (value, share) per dimension, and
    ``off``, how far the worst marginal still is from its share (the same on every row).

    Shares need not sum to one; of a value named twice they add up. Cells without tokens, or with a value whose target is zero or
    missing, get no mass; targets no cell can meet are left out and the others scaled up. Rounds go on until no marginal is off by
    more than ``tolerance``, or, as targets may contradict each other, until the error has not halved in ``patience`` rounds: then
    they hold for the last dimension and ``off`` tells what is missing in the others."""
    now = cells
    for d, target in targets.items():
        now = now.join(small(target.groupBy(_value(F.col("value")).alias(d)).agg(F.sum("share").alias(f"to_{d}")), CELL_ROWS), d, "left")
    open_ = reduce(and_, (F.coalesce(F.col(f"to_{d}") > 0, F.lit(False)) for d in targets), F.col("tokens") > 0)
    now = cut(now.withColumn("mass", F.when(open_, F.col("tokens").cast("double")).otherwise(0.0)))
    live = now.where("mass > 0")
    # normalised over the values that some cell can meet; one number per dimension
    totals = {d: live.groupBy(d).agg(F.first(f"to_{d}").alias("w")).agg(F.sum("w")).first()[0] or 1.0 for d in targets}
    total = live.agg(F.sum("mass")).first()[0] or 1.0
    now = now.withColumn("mass", F.col("mass") / total)
    errors: list[float] = []
    while not errors or (errors[-1] > tolerance and (len(errors) <= patience or errors[-1] < errors[-1 - patience] / 2)):
        now = now.withColumn("off", F.lit(0.0))
        for d in targets:
            aim, have = F.col(f"to_{d}") / totals[d], F.sum("mass").over(Window.partitionBy(d))
            now = now.withColumn("have", have).withColumn("off", F.when(F.col("mass") > 0, F.greatest("off", F.abs(F.col("have") - aim))).otherwise(F.col("off")))
            now = now.withColumn("mass", F.when(F.col("mass") > 0, F.col("mass") * aim / F.col("have")).otherwise(0.0))
        now = cut(now)
        errors.append(now.agg(F.max("off")).first()[0] or 0.0)
    return now.select(*cells.columns, "mass", F.lit(errors[-1]).alias("off"))


def mix(docs: DataFrame, topics: DataFrame | None = None, targets: dict[str, DataFrame] | None = None, budget: int | None = None, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` and, in place of own columns of these names: topic, tokens, rate, probability, copies, off.

    rate is the expected number of copies that brings the token shares of source, language and topic to ``targets`` (dimension to
    (value, share); without: ``POWERS``) at ``budget`` tokens in all (without: those of ``docs``). probability is the chance of
    being drawn at all, min(1, rate). off is the largest error of a marginal that raking has left (see ``rake``). copies is rate rounded up or down at random, by a hash of id, text and ``seed``: a repeated
    row always fares like the first, and a second run draws the same. Null and missing values are the value ``NONE``; null and
    empty texts weigh nothing and have rate 0; an empty table gives an empty result."""
    known = described(docs, topics, text, doc_id)
    cells = cut(known.groupBy("__cell").agg(F.sum("__tokens").alias("tokens")).select("__cell.*", "tokens"))
    wanted = targets or {d: tempered(cells, d, p) for d, p in POWERS.items()}
    size = F.lit(budget if budget is not None else cells.agg(F.sum("tokens")).first()[0] or 0)
    rates = rake(cells, wanted).select(F.struct(*DIMENSIONS).alias("__cell"), F.when(F.col("mass") > 0, size * F.col("mass") / F.col("tokens")).otherwise(0.0).alias("__rate"), F.col("off").alias("__off"))
    rated = known.join(small(rates, CELL_ROWS), "__cell", "left")
    rate = F.when(F.col("__tokens") > 0, F.col("__rate")).otherwise(0.0)
    unit = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)), 11) / F.lit(float(1 << 53))
    own = [F.col(c) for c in docs.columns if c not in ("topic", "tokens", "rate", "probability", "copies", "off")]
    out = rated.select(*own, F.col("__cell.topic").alias("topic"), F.col("__tokens").alias("tokens"), rate.alias("rate"), F.least(F.lit(1.0), rate).alias("probability"), F.col("__off").alias("off"), unit.alias("__unit"))
    return out.withColumn("copies", (F.floor("rate") + (F.col("__unit") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")).drop("__unit")
