"""The audit log as a stream. The log is append-only, so both operators follow it without rereading it.

Each batch is reduced before it is written: one row per key, under the batch's number, so a repeated batch overwrites itself and
earlier increments are never rewritten. Folding the increments gives what the batch operator gives on all events so far, however
late an event comes; nothing waits in state and nothing is dropped. ``compact`` folds old increments into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tomeflow.operators.audit import UPDATE
from tomeflow.functions import changes as C

DAY_KEYS = ["object_type", "description", "day"]


def follow(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at ``path``, a folder of part files or a single file, as a stream. Spark streams folders only, so a
    single file is followed by its name in the folder above."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rpartition("/")[2] == name for f in spark.read.schema(schema).parquet(path).inputFiles()):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _increments(events: DataFrame, reduce_: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        reduce_(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_daily(events: DataFrame, to_labels: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """The last event per object type, description and day, the keys of the batch operator; ``to_labels`` gives them."""

    def reduce_(batch: DataFrame) -> DataFrame:
        rows = to_labels(batch).withColumn("day", F.to_date("datetime"))
        return rows.groupBy(*DAY_KEYS).agg(F.max(F.struct("datetime", "id")).alias("m"), F.min("datetime").alias("first_at"))

    return _increments(events, reduce_, path, checkpoint)


def _folded_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DAY_KEYS).agg(F.max("m").alias("m"), F.min("first_at").alias("first_at"))


def daily(spark: SparkSession, path: str) -> DataFrame:
    rows = _folded_days(spark.read.parquet(path))
    return rows.select(*DAY_KEYS, F.col("m.id").alias("id"), F.col("m.datetime").alias("datetime"), "first_at")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the daily increments under ``path`` folded, as the increment -1 of the new folder ``into``; a stream that goes
    on with ``into`` adds its own beside it."""
    _folded_days(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{into}/batch=-1")


def touch_updated(events: DataFrame, to_document: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Latest change per document, kept as one small increment per batch; ``current`` folds them."""

    def reduce_(batch: DataFrame) -> DataFrame:
        k = F.coalesce(C.keys(), F.array().cast("array<string>"))
        real = F.size(F.array_except(k, F.array(F.lit("status"), F.lit("updated")))) > 0
        rows = to_document(batch.filter((F.col("event_type") != UPDATE) | real))
        return rows.groupBy("document_id").agg(F.max(F.struct("datetime", "id", "user_id")).alias("m"))

    return _increments(events, reduce_, path, checkpoint)


def current(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).groupBy("document_id").agg(F.max("m").alias("m"))
    return rows.select("document_id", F.col("m.datetime").alias("updated"), F.col("m.user_id").alias("updated_by"))
