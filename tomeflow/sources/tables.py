"""Reading tables: parquet folders or a relational store over JDBC, always with a known schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One parquet table under ``root``; filters and columns are pushed to the scan."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, partitions: int = 16, where: str | None = None, **options: str) -> DataFrame:
    """A relational table in ``partitions`` range reads on a numeric column; the bounds are the column's own least and greatest
    value, asked of the store first. ``where`` is a condition in the store's SQL that limits rows before they are cut into ranges;
    filters and columns chosen later are pushed to the store by Spark. Rows without a value in ``column`` come with the first range."""
    source = f"(SELECT * FROM {table} WHERE {where}) t" if where else table
    store = lambda **more: spark.read.format("jdbc").options(url=url, fetchsize="10000", **options, **more)
    low, high = store(query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {source}").load().first()
    if low is None or low == high:
        return store(dbtable=source).load()
    ranges = {"partitionColumn": column, "lowerBound": str(int(low)), "upperBound": str(int(high) + 1), "numPartitions": str(min(partitions, int(high) - int(low) + 1))}
    return store(dbtable=source, **ranges).load()
