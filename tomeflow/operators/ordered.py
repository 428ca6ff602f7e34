"""Ordered windows that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. ``scan`` cuts each key into chunks by a monotone
expression of the ordering columns: rows are windowed inside their chunk, each chunk is reduced to one carry row, the
carries are windowed per key, and a join hands every chunk what came before and after it. A key of n rows then costs
one task at most n / chunk-size carry rows. There is one plan for every size and no job runs while it is built. Null keys
form a key of their own; a null order value sorts first and is in the first chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tomeflow.session import cut

CHUNK_ROWS = 4096
_CHUNK = "__chunk"


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column


def lag(expr: Column) -> Spec:
    """Value on the row just before (null values included)."""
    return Spec("lag", expr)


def lead(expr: Column) -> Spec:
    """Value on the row just after (null values included)."""
    return Spec("lead", expr)


def last_before(expr: Column) -> Spec:
    """Last non-null value on an earlier row."""
    return Spec("last_before", expr)


def last_upto(expr: Column) -> Spec:
    """Last non-null value on this or an earlier row."""
    return Spec("last_upto", expr)


def first_after(expr: Column) -> Spec:
    """First non-null value on a later row."""
    return Spec("first_after", expr)


def first_upto(expr: Column) -> Spec:
    """First non-null value on this or an earlier row."""
    return Spec("first_upto", expr)


def running_sum(expr: Column) -> Spec:
    """Sum up to and including this row."""
    return Spec("running_sum", expr)


def max_before(expr: Column) -> Spec:
    """Largest value on an earlier row, null on the first."""
    return Spec("max_before", expr)


def row_number() -> Spec:
    return Spec("running_sum", F.lit(1))


def chunk_of(order: str, size: int = CHUNK_ROWS) -> Column:
    """Chunk number for a dense integer order column."""
    return F.floor(F.col(order) / size)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column, /, **specs: Spec) -> DataFrame:
    """Add one column per spec. ``chunk`` must never decrease along ``order`` within a key.

    Keys and chunks are made free of nulls, each null key with a flag, so that windows and join ask for the same
    distribution and the rows pass one shuffle only."""
    src, parts, filled, back_to = _filled(df.withColumn(_CHUNK, F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 63)))), keys)
    parts = [*parts, _CHUNK]
    boxed = {n: F.struct(s.expr.alias("v")) if s.kind in ("lag", "lead") else s.expr for n, s in specs.items()}
    for n, e in boxed.items():
        src = src.withColumn(f"__in_{n}", e)
    local = W.partitionBy(*parts).orderBy(*order)
    back = W.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    over = W.partitionBy(*parts[:-1]).orderBy(_CHUNK)
    over_back = W.partitionBy(*parts[:-1]).orderBy(F.col(_CHUNK).desc())
    pos = F.struct(*order)

    here, reduce_, carry, final = {}, [], {}, {}
    for n, s in specs.items():
        e, c = F.col(f"__in_{n}"), F.col(f"__carry_{n}")
        seen = F.when(e.isNotNull(), pos)
        before = over.rowsBetween(W.unboundedPreceding, -1)
        if s.kind in ("lag", "last_before", "last_upto"):
            if s.kind == "lag":
                here[n] = F.lag(e).over(local)
            else:
                upto = 0 if s.kind == "last_upto" else -1
                here[n] = F.last(e, True).over(local.rowsBetween(W.unboundedPreceding, upto))
            reduce_.append(F.max_by(e, seen).alias(f"__carry_{n}"))
            carry[n] = F.last(c, True).over(before)
            final[n] = F.coalesce(F.col(n), c)
        elif s.kind == "first_upto":
            here[n] = F.first(e, True).over(local.rowsBetween(W.unboundedPreceding, 0))
            reduce_.append(F.min_by(e, seen).alias(f"__carry_{n}"))
            carry[n] = F.first(c, True).over(before)
            final[n] = F.coalesce(c, F.col(n))
        elif s.kind in ("lead", "first_after"):
            if s.kind == "lead":
                here[n] = F.lead(e).over(local)
            else:
                here[n] = F.last(e, True).over(back.rowsBetween(W.unboundedPreceding, -1))
            reduce_.append(F.min_by(e, seen).alias(f"__carry_{n}"))
            carry[n] = F.last(c, True).over(over_back.rowsBetween(W.unboundedPreceding, -1))
            final[n] = F.coalesce(F.col(n), c)
        elif s.kind == "running_sum":
            here[n] = F.sum(e).over(local.rowsBetween(W.unboundedPreceding, 0))
            reduce_.append(F.sum(e).alias(f"__carry_{n}"))
            carry[n] = F.sum(c).over(before)
            final[n] = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(c, F.lit(0))
        else:
            here[n] = F.max(e).over(local.rowsBetween(W.unboundedPreceding, -1))
            reduce_.append(F.max(e).alias(f"__carry_{n}"))
            carry[n] = F.max(c).over(before)
            final[n] = F.greatest(F.col(n), c)
        if s.kind in ("lag", "lead"):
            final[n] = final[n]["v"]

    rows = src.select(*[c for c in src.columns if c not in filled or c in order], *[c.alias(n) for n, c in here.items()])
    carries = src.groupBy(*parts).agg(*reduce_)
    at = {c: f"__at_{i}" for i, c in enumerate(parts)}
    carries = carries.select(*[F.col(c).alias(a) for c, a in at.items()], *[c.alias(f"__carry_{n}") for n, c in carry.items()])
    joined = rows.join(carries, [F.col(c) == F.col(a) for c, a in at.items()], "left")
    return joined.select(*[back_to.get(c, F.col(c)) for c in df.columns if c not in specs], *[c.alias(n) for n, c in final.items()])


def _filled(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str], dict[str, Column]]:
    """``df`` with columns that stand for ``keys`` and are never null, their names, the keys they stand for, and the way back.
    Texts and whole numbers get a value and a flag; keys of other types are boxed."""
    stand, back = {}, {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        if isinstance(kind, (T.StringType, T.IntegralType)):
            stand |= {f"__key{i}": F.coalesce(F.col(k), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)), f"__null{i}": F.col(k).isNull()}
            back[k] = F.when(~F.col(f"__null{i}"), F.col(f"__key{i}")).alias(k)
        else:
            stand[f"__key{i}"] = F.struct(F.col(k).alias("v"))
            back[k] = F.col(f"__key{i}")["v"].alias(k)
    return df.select("*", *[c.alias(n) for n, c in stand.items()]), list(stand), list(back), back


def row_numbers(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """``df`` with the 1-based place of every row inside its key, for any order and any skew.

    Rows are dealt out by ranges of key and order, so a key with most of the rows, or with many in one instant, is spread over
    many parts; each part numbers its own rows, and the numbers of rows in earlier parts of the key (one row per key and part)
    are added. The parts are written once, as their bounds are sampled. ``order`` (names, or columns with a direction) has to
    tell rows apart for a fixed result; without ``keys`` the whole table is numbered. A null key is a key of its own."""
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__part_of"), before.alias("__start"))
    placed = parts.withColumn("__place", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order)))
    same = F.col("__part") == F.col("__part_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(starts, same).select(*df.columns, (F.col("__start") + F.col("__place")).alias(name))
