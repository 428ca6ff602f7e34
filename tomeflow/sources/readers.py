"""Reading uploads, nested document JSON, question files and image listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow import schemas
from tomeflow.operators.audit import stable_uuid

IMAGE = r"(?i)\.(jpe?g|png)$"


def read_uploads(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Uploads as ``path``, ``filename``, ``content`` (bytes) and ``size``, from a folder with a file each or, with ``packed``, from
    a store of many uploads a file (``sinks.pack_uploads``). Many small uploads belong in a store: listing and opening a file
    each costs the driver milliseconds, whatever its size. Folders may name the file (``filename=...``). Spark lists no files of
    zero bytes, so an empty upload gives no row from a folder; from a store it gives one."""
    if packed:
        rows = spark.read.schema("filename string, content binary").parquet(path)
        return rows.select(F.col("_metadata.file_path").alias("path"), "filename", "content", F.octet_length("content").cast("bigint").alias("size"))
    files = spark.read.format("binaryFile").load(path)
    name = F.col("filename").cast("string") if "filename" in files.columns else F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), "content", F.col("length").alias("size"))


def content_kind(content: Column) -> Column:
    """html, word, pdf or other, by the leading bytes; a byte order mark and white space may come before a tag."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return F.when(head.rlike(r"^(?:\u00EF\u00BB\u00BF)?\s*<"), "html").when(head.startswith("PK\u0003\u0004"), "word").when(head.startswith("%PDF-"), "pdf").otherwise("other")


def judge_uploads(files: DataFrame) -> DataFrame:
    """``filename``, ``kind``, ``reason`` (null if accepted) and ``html`` (null if rejected) of ``read_uploads`` rows, in one pass. The
    content decides, not only the name: HTML needs an HTML name, leading bytes of HTML and valid UTF-8. Word files are
    recognised; decoding them is a separate step."""
    named = F.lower("filename").rlike(r"\.html?$")
    reason = (
        F.when((F.col("kind") == "word") | F.lower("filename").endswith(".docx"), "Word file: convert to HTML first")
        .when(~named, "Please import a .docx or HTML file.").when(F.col("kind") != "html", F.concat(F.lit("Not HTML inside: "), "kind"))
        .when(~F.is_valid_utf8("content"), "Not UTF-8.")
    )
    rows = files.withColumn("kind", content_kind(F.col("content"))).withColumn("reason", reason)
    html = F.regexp_replace(F.decode("content", "UTF-8"), "^\uFEFF", "")
    return rows.select("filename", "kind", "reason", F.when(F.col("reason").isNull(), html).alias("html"))


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with ``html``, rejected with a reason) of ``judge_uploads``."""
    rows = judge_uploads(files)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").drop("html")


def nested_lines(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON lines as parsed, with a ``__reason`` where a line is to be rejected: it is no such JSON, or a document without an
    id or without sections."""
    lines = spark.read.schema(f"{schemas.NESTED_DOCUMENT}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    reason = F.when(F.col("__bad").isNotNull(), "malformed").when(F.col("id").isNull(), "no id").when(F.coalesce(F.size("sections"), F.lit(0)) < 1, "no sections")
    return lines.withColumn("__reason", reason)


def nested_rejects(told: DataFrame) -> DataFrame:
    """``line`` (what came in), ``id`` and ``reason`` of the rejected ones of ``nested_lines``."""
    return told.filter("__reason IS NOT NULL").select("id", F.col("__reason").alias("reason"), F.coalesce("__bad", F.to_json(F.struct("id", *schemas.TOP_FIELDS))).alias("line"))


def nested_tables(told: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sections, subsections) of the good ones of ``nested_lines``, linked by new ids."""
    raw = told.filter("__reason IS NULL").withColumn("source_id", F.col("id")).withColumn("id", stable_uuid("import", F.col("id")))
    docs = raw.select("id", "source_id", F.lit(group).alias("group"), F.lit("draft").alias("status"), *schemas.TOP_FIELDS)
    s = raw.select(F.col("id").alias("document_id"), F.posexplode("sections").alias("n", "s"))
    s = s.withColumn("section_id", F.concat_ws("-", "document_id", F.col("n").cast("string")))
    sections = s.select(F.col("section_id").alias("id"), "document_id", "s.name", "s.order", "s.html_id", "s.html_class", "s.has_section_page")
    x = s.select("section_id", F.posexplode("s.subsections").alias("n", "x"))
    subs = x.select(F.concat_ws("-", "section_id", F.col("n").cast("string")).alias("id"), "section_id", *[f"x.{c}" for c in ("name", "order", "tag", "html_id", "html_class", "callout_box", "body")])
    return docs, sections, subs


def nested_rows(told: DataFrame, group: str) -> DataFrame:
    """The subsections of ``nested_tables``, each with its section and document as structs ``section`` and ``document``. What the
    three tables give when joined, but a line holds all of it, so nothing passes a shuffle."""
    docs = nested_tables(told, group)[0].columns
    raw = told.filter("__reason IS NULL").withColumn("source_id", F.col("id")).withColumn("id", stable_uuid("import", F.col("id")))
    raw = raw.withColumns({"group": F.lit(group), "status": F.lit("draft")})
    s = raw.select(F.struct(*docs).alias("document"), F.posexplode("sections").alias("n", "s"))
    own = [F.col(f"s.{c}").alias(c) for c in ("name", "order", "html_id", "html_class", "has_section_page")]
    key = F.concat_ws("-", "document.id", F.col("n").cast("string"))
    x = s.select("document", F.struct(key.alias("id"), F.col("document.id").alias("document_id"), *own).alias("section"), F.posexplode("s.subsections").alias("n", "x"))
    key = F.concat_ws("-", "section.id", F.col("n").cast("string"))
    return x.select(key.alias("id"), F.col("section.id").alias("section_id"), *[f"x.{c}" for c in ("name", "order", "tag", "html_id", "html_class", "callout_box", "body")], "section", "document")


def read_nested_json(spark: SparkSession, path: str, group: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, sections, subsections, rejects) from nested JSON lines. Incoming id, archived, status and group are ignored:
    the id is made anew, the group is given. Rejects are lines that are no such JSON, documents without an id and documents
    without sections, each with ``line`` (what came in), ``id`` and ``reason``; every line is either read or rejected."""
    told = nested_lines(spark, path)
    return *nested_tables(told, group), nested_rejects(told)


def read_questions(spark: SparkSession, path: str, page: int | None = None) -> DataFrame:
    q = spark.read.schema(schemas.QUESTIONS).json(path)
    return q if page is None else q.filter(F.col("page") == page)


def max_page(questions: DataFrame) -> DataFrame:
    return questions.agg(F.coalesce(F.max("page"), F.lit(1)).alias("max_page"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a folder: names, sizes and times only, contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return list_images(files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")))


def list_images(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("key").rlike(IMAGE))


def recent_images(objects: DataFrame) -> DataFrame:
    return list_images(objects).orderBy(F.desc("last_modified"), "key")
