"""The given tables seen as documents, sections, subsections, events, users and images."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tomeflow.plans import role_text as R
from tomeflow.session import cut
from tomeflow.sources.tables import read_table


def _split(projection: str) -> list[str]:
    """Top-level commas of a projection text."""
    out, depth, quote, start = [], 0, False, 0
    for i, ch in enumerate(projection):
        if ch == "'":
            quote = not quote
        elif not quote and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quote and depth == 0 and ch == ",":
            out.append(projection[start:i])
            start = i + 1
    return [p.strip().replace('AS "group"', "AS `group`") for p in [*out, projection[start:]]]


class Roles:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    @cached_property
    def documents(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.selectExpr(*_split(R.DOCUMENTS))

    @cached_property
    def sections(self) -> DataFrame:
        """Numbered by keys alone; the texts are made of them afterwards, so that none passes the shuffle."""
        rows = self.table("orders").selectExpr("o_orderkey", "o_custkey", f"{R.text('o_custkey')} AS document_id")
        numbered = rows.withColumn("order", F.row_number().over(W.partitionBy("document_id").orderBy("o_orderkey")))
        own = [p for p in _split(R.SECTIONS) if not p.endswith((" AS document_id", " AS seq_key"))]
        return numbered.selectExpr(own[0], "document_id", *own[1:], "`order`")

    @cached_property
    def subsections(self) -> DataFrame:
        """Rows of an order, seven at most, numbered; so a plain window serves here, as for the orders of a customer. As with
        sections, the texts are made after the shuffle."""
        rows = self.table("lineitem").selectExpr("l_orderkey", *R.LINE_ORDER, f"{R.text('l_orderkey')} AS section_id")
        numbered = rows.withColumn("order", F.row_number().over(W.partitionBy("section_id").orderBy(*R.LINE_ORDER)))
        own = [p for p in _split(R.SUBSECTIONS) if not p.endswith(" AS section_id")]
        return numbered.selectExpr("concat_ws('-', section_id, `order`) AS id", "section_id", *own, "`order`")

    def stored(self) -> Roles:
        """Write the numbered subsections once, as a store would hold them, for queries that read them several times."""
        self.__dict__["subsections"] = cut(self.subsections)
        return self

    @cached_property
    def tree(self) -> DataFrame:
        """Subsections with the document, name and order of their section."""
        head = self.sections.select(
            F.col("id").alias("section_id"), "document_id", F.col("name").alias("section_name"),
            F.col("order").alias("section_order"),
        )
        return self.subsections.join(head, "section_id")

    @cached_property
    def events(self) -> DataFrame:
        rows = self.table("events").selectExpr(*_split(R.EVENTS))
        return rows.withColumn("datetime", F.col("datetime").cast("timestamp"))

    @cached_property
    def users(self) -> DataFrame:
        rows = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.selectExpr(*_split(R.USERS))

    @cached_property
    def images(self) -> DataFrame:
        return self.table("part").selectExpr(*_split(R.IMAGES))

    @cached_property
    def raw_html(self) -> DataFrame:
        return self.table("pages").selectExpr(*_split(R.RAW_HTML))
