"""Exports. Every sink writes in parallel, one file per partition; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow import schemas
from tomeflow.session import cut

CSV = {
    "header": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.options(**CSV, compression=compression).mode("overwrite").csv(path)


def pack_uploads(uploads: DataFrame, path: str) -> None:
    """Uploads (``filename``, ``content`` in bytes) into a store that ``readers.read_uploads(..., packed=True)`` reads."""
    uploads.select("filename", "content").write.parquet(path)


def nested(docs: DataFrame, sections: DataFrame, subsections: DataFrame) -> DataFrame:
    """Unarchived documents with sorted sections and subsections. Built level by level: a document's row holds its own
    tree, which is what the export is."""
    x = subsections.select("section_id", F.struct("order", "id", "name", "tag", "html_id", "html_class", "callout_box", "body").alias("x"))
    x = x.groupBy("section_id").agg(F.array_sort(F.collect_list("x")).alias("subsections"))
    s = sections.join(x, sections["id"] == x["section_id"], "left")
    empty = F.array().cast("array<struct<order:int,id:string,name:string,tag:string,html_id:string,html_class:string,callout_box:boolean,body:string>>")
    one = F.struct("order", "id", "name", "html_id", "html_class", "has_section_page", F.coalesce("subsections", empty).alias("subsections"))
    s = s.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).alias("sections"))
    top = [F.nullif(F.col(c), F.lit("")).alias(c) for c in schemas.TOP_FIELDS]
    d = docs.filter(F.col("archived").isNull()).select("id", "status", "group", *top)
    return d.join(s, d["id"] == s["document_id"], "left").drop("document_id")


def write_nested_json(docs: DataFrame, sections: DataFrame, subsections: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON lines, compressed, as every row repeats the names of its fields; null and blank top-level fields are left out."""
    nested(docs, sections, subsections).write.mode("overwrite").json(path, compression=compression)


def compare_rows(compared: DataFrame) -> DataFrame:
    """Comparison table without MATCH rows; the new-name column is there only if some update renamed a row."""
    rows = cut(compared.filter("status <> 'MATCH'").select("status", "section_name", "old_name", "new_name", "old_value", "new_value"))
    renamed = rows.agg(F.bool_or((F.col("status") == "UPDATE") & (F.col("old_name") != F.col("new_name")))).first()[0]
    either = F.when(F.col("status") == "ADD", F.col("new_name")).otherwise(F.coalesce(F.nullif("old_name", F.lit("")), "new_name"))
    name = F.col("old_name") if renamed else either
    extra = [F.col("new_name").alias("New section name")] if renamed else []
    return rows.select(F.col("status").alias("Status"), F.col("section_name").alias("Step name"), name.alias("Section name"), F.col("old_value").alias("Old value"), *extra, F.col("new_value").alias("New value"))


def link_rows(external: DataFrame, docs: DataFrame, base_url: str) -> DataFrame:
    d = docs.filter(F.col("archived").isNull()).select(F.col("id").alias("document_id"), "number", "title")
    url = F.concat_ws("/", F.lit(base_url), "document_id", F.lit("section"), "section_id", F.lit("subsection"), "subsection_id", F.lit("edit"))
    return external.join(d, "document_id").select("document_id", "number", "title", "url", "link_text", "domain", url.alias("edit_url"))


def report_name(base: str, group: str | None = None, start: str | None = None, end: str | None = None) -> str:
    """``base_group_start_end.csv`` without the parts that are missing."""
    return "_".join(p for p in (base, group, start, end) if p) + ".csv"


def inventory(docs: DataFrame, templates: DataFrame, base_url: str) -> DataFrame:
    def part(df: DataFrame, kind: str) -> DataFrame:
        url = F.concat_ws("/", F.lit(base_url), F.lit(kind), "id", F.lit("edit"))
        return df.select(F.lit(kind).alias("type"), "id", url.alias("url"), "number", "title", "status", "created", "updated")

    return part(docs, "document").unionByName(part(templates, "template")).orderBy("created", "id")


def append_events(accepted: DataFrame, path: str) -> None:
    accepted.write.mode("append").parquet(path)
