"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.session import cut

#: Word separators of every word-based operator here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of ``text`` (runs of anything but ASCII white space) as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learning_row(doc_id: Column, mod: int, held: int) -> Column:
    """True for rows whose crc32(doc_id as text) mod ``mod`` is not ``held``. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod != held, F.lit(False))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, so that Spark shuffles both sides.
    The count is one number per task; of a table that was just written it reads file footers only."""
    return F.broadcast(df) if df.count() <= rows else df


def smallest_hashes(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hash of ``by`` (ties: by its values), a sample that any run repeats.

    A bound on the hash, from the number of rows, leaves about twice as many rows to be ordered, so what tasks hand to the driver
    does not grow with their number; if too few are left (very unequal repeats), all rows are ordered."""
    rows = df.withColumn("__h", F.pmod(F.xxhash64(*by), F.lit(1 << 31)))
    total = df.count()
    if total > 4 * n:
        few = rows.where(F.col("__h") < int((1 << 31) * 2 * n / total))
        rows = few if few.limit(n).count() == n else rows
    return rows.orderBy("__h", *by).limit(n).drop("__h")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps (joins and minima only) until all that is left are stars; each round is written to the
    shared folder, so neither the plan nor recovery grows with the rounds. Only nodes that occur in an edge are returned.
    Hubs are safe: minima are pre-aggregated and the join on the hub is one Spark can split. Empty edges give an empty table.
    Raises if it has not converged after ``rounds`` rounds (paths double per round, so 60 is far beyond any real input)."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        # done once every node has one edge at most and no node is both a member and a root
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("member"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("member").alias("m"), F.max("root").alias("r")).where("m + r > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        e = cut(met.select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct())
    raise RuntimeError("components have not converged")
