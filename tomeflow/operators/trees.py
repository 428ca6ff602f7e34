"""Order-aware operators on the document tree: neighbours, heading checks, numbering and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.functions import text as X
from tomeflow.operators import ordered
from tomeflow.operators.filters import blank
from tomeflow.session import cut

SECTION_KEY = ["section_id"]


def _scan(subsections: DataFrame, **specs) -> DataFrame:
    return ordered.scan(subsections, SECTION_KEY, ["order"], ordered.chunk_of("order"), **specs)


def tree_join(docs: DataFrame, sections: DataFrame, subsections: DataFrame) -> DataFrame:
    """Document ⋈ section ⋈ subsection on ids."""
    d = docs.select(F.col("id").alias("document_id"), "title")
    s = sections.select(F.col("id").alias("section_id"), "document_id", F.col("name").alias("section_name"), F.col("order").alias("section_order"))
    return subsections.join(s, "section_id").join(d, "document_id")


def neighbours(rows: DataFrame, key: str = "section_id") -> DataFrame:
    """Previous and next row by order: subsections of a section, or, with ``key`` document_id, sections of a document."""
    return ordered.scan(rows, [key], ["order"], ordered.chunk_of("order"), previous_id=ordered.lag(F.col("id")), next_id=ordered.lead(F.col("id")))


def next_tagged(subsections: DataFrame) -> DataFrame:
    """Next and previous subsection that carries a heading tag, whatever lies between."""
    tagged = F.when(F.col("tag") != "", F.col("id"))
    return _scan(subsections, next_tagged_id=ordered.first_after(tagged), previous_tagged_id=ordered.last_before(tagged))


def _level(tag: str) -> Column:
    return F.substring(tag, 2, 1).cast("int")


def _heading_scan(subsections: DataFrame) -> DataFrame:
    """One pass that gives every row its next row, its next tagged row and its place; both heading checks read it."""
    rows = subsections.select("id", "section_id", "order", "name", "tag", blank("body").alias("empty"))
    head = F.struct("id", "name", "tag")
    return _scan(rows, nxt=ordered.lead(head), tagged=ordered.first_after(F.when(F.col("tag") != "", head)), place=ordered.row_number())


def _repeated() -> Column:
    here, there = _level("tag"), _level("nxt.tag")
    error = F.when(here == there, F.format_string("Repeated heading level: two %s headings in a row.", "nxt.tag")).when(
        here > there,
        F.format_string("Incorrectly nested heading level: %s immediately followed by a larger %s.", "tag", "nxt.tag"),
    )
    hit = F.col("empty") & (F.col("name") != "") & (F.col("nxt.name") != "") & error.isNotNull()
    return F.when(hit, F.struct(F.col("nxt.id").alias("id"), F.col("nxt.name").alias("name"), error.alias("error")))


def _skipped_later() -> Column:
    hit = (F.col("name") != "") & (F.col("tagged.name") != "") & (F.col("tag") != "") & (_level("tagged.tag") - _level("tag") > 1)
    error = F.format_string("Incorrectly nested heading level: %s followed by an %s.", "tag", "tagged.tag")
    return F.when(hit, F.struct(F.col("tagged.id").alias("id"), F.col("tagged.name").alias("name"), error.alias("error")))


def _skipped_first() -> Column:
    hit = (F.col("place") == 1) & (F.col("tag") != "") & (_level("tag") > 3)
    error = F.format_string("Incorrectly nested heading level: h2 (%s) followed by an %s.", "section_name", "tag")
    return F.when(hit, F.struct("id", "name", error.alias("error")))


def _errors(rows: DataFrame, *kinds: Column) -> DataFrame:
    return rows.select("section_id", F.explode(F.array_compact(F.array(*kinds))).alias("e")).select("section_id", "e.*")


def _with_section_name(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    names = sections.select(F.col("id").alias("section_id"), F.col("name").alias("section_name"))
    return _heading_scan(subsections).join(names, "section_id")


def repeated_headings(subsections: DataFrame) -> DataFrame:
    """Bodyless named heading directly followed by a named heading of the same or a larger level."""
    return _errors(_heading_scan(subsections), _repeated())


def skipped_headings(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    """Headings that jump a level against the previous heading, or a first heading below h3."""
    return _errors(_with_section_name(subsections, sections), _skipped_first(), _skipped_later())


def union_heading_errors(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    """Both heading checks as one list, from one pass over the rows."""
    return _errors(_with_section_name(subsections, sections), _repeated(), _skipped_first(), _skipped_later())


def heading_error_flags(subsections: DataFrame, errors: DataFrame) -> DataFrame:
    """Each subsection with its first heading error, if any."""
    one = errors.groupBy("id").agg(F.max(F.struct(F.col("error").startswith("Repeated").alias("r"), "error")).alias("e"))
    return subsections.join(one.select("id", F.col("e.error").alias("heading_error")), "id", "left")


def next_order(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """Next free section order per document, 1 where it has none."""
    top = sections.groupBy("document_id").agg(F.max("order").alias("top"))
    return docs.select(F.col("id").alias("document_id")).join(top, "document_id", "left").select(
        "document_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_order")
    )


def heading_ids(tree: DataFrame) -> DataFrame:
    """``{n}--{section}--{subsection}`` with n counting through the document in section and subsection order.

    n is the rows of earlier sections plus the place in the own section; both parts are chunked scans, so
    neither a large document nor a large section lands in one task. The rows are written once and read by both.
    """
    tree = cut(tree)
    rows = _scan(tree, place=ordered.row_number())
    sizes = tree.groupBy("document_id", "section_id", "section_order").agg(F.count("*").alias("rows"))
    upto = ordered.scan(sizes, ["document_id"], ["section_order"], ordered.chunk_of("section_order"), upto=ordered.running_sum(F.col("rows")))
    start = upto.select("section_id", (F.col("upto") - F.col("rows")).alias("start"))
    number = F.col("start") + F.col("place")
    new_id = F.concat_ws("--", number.cast("string"), X.slug(F.col("section_name")), X.slug(F.col("name")))
    return rows.join(start, "section_id").withColumn("new_html_id", new_id).withColumn("number", number).drop("place", "start")


def insert_order_space(rows: DataFrame, at: Column) -> DataFrame:
    """Make room: orders at or after ``at`` move up by one."""
    return rows.withColumn("order", F.when(F.col("order") >= at, F.col("order") + 1).otherwise(F.col("order")))


def first_subsection(tree: DataFrame) -> DataFrame:
    """First subsection of the first section of each document; a min, so it is combined before the shuffle."""
    return tree.groupBy("document_id").agg(F.min(F.struct("section_order", "order", "id")).alias("m")).select("document_id", F.col("m.id").alias("id"))


def step_2_section(sections: DataFrame) -> DataFrame:
    """The section whose name holds "Step 2", else the one with order 2."""
    named = F.lower("name").contains("step 2")
    rows = sections.filter(named | (F.col("order") == 2))
    return rows.groupBy("document_id").agg(F.min(F.struct((~named).alias("fallback"), "order", "id")).alias("m")).select(
        "document_id", F.col("m.id").alias("section_id")
    )


def group_by_header(subsections: DataFrame) -> DataFrame:
    """Header groups of a section: id, section_id, order, name, tag, ``group_no`` and ``heading`` of each row; an empty header row
    that only repeats the group's name is left out, as are later bare rows of that name while their group is still empty.

    Names and flags are written once; bodies are looked at on the way and stay where they are."""
    header = F.lower(F.trim("name")).isin(V.GROUP_HEADERS) | F.lower("tag").isin("h2", "h3")
    bare = (F.col("body") == "") & (F.col("instructions") == "")
    rows = cut(subsections.select("id", "section_id", "order", "name", "tag", header.alias("is_header"), bare.alias("bare")))
    at = F.coalesce("order", F.lit(-(1 << 31))).alias("at")  # a row without an order comes first
    rows = _scan(rows, heads=ordered.running_sum(F.col("is_header").cast("int")), head=ordered.last_upto(F.when(F.col("is_header"), F.struct(at, "name"))), first=ordered.first_upto(F.struct(at, "name", "is_header")))
    opened = F.coalesce(F.col("head.at"), F.col("first.at"))
    rows = rows.withColumn("heading", F.coalesce("head.name", "first.name")).withColumn("group_no", F.col("heads") + (~F.col("first.is_header")).cast("int")).withColumn("opened", opened)
    same = F.lower(F.trim("name")) == F.lower(F.trim("heading"))
    rows = cut(rows.select("id", "section_id", "order", "name", "tag", "group_no", "heading", "opened", F.when(~(F.col("bare") & same), at).alias("kept")))
    rows = _scan(rows, upto=ordered.last_upto(F.col("kept")))
    return rows.filter(F.col("upto") >= F.col("opened")).drop("opened", "kept", "upto")


def toc_items(sections: DataFrame, subsections: DataFrame) -> DataFrame:
    """Table-of-contents size: sections, h3 headings of sections with their own page, and one more."""
    h3 = subsections.filter(F.col("tag") == "h3").groupBy("section_id").agg(F.count("*").alias("h3"))
    rows = sections.join(h3, sections["id"] == h3["section_id"], "left")
    counted = F.when(F.col("has_section_page") & ~F.lower("name").contains("contacts"), F.coalesce("h3", F.lit(0))).otherwise(0)
    n = rows.groupBy("document_id").agg((F.count("*") + F.sum(counted) + 1).alias("items"))
    return n.withColumn("size", F.when(F.col("items") <= 23, "normal").otherwise("small"))


def page_break_rules(tree: DataFrame) -> DataFrame:
    """Set the page-break class where the subsection name equals and the section name contains a rule."""
    hit = F.lit(False)
    for name, part in V.PAGE_BREAK_RULES:
        hit = hit | ((F.lower("name") == name) & F.lower("section_name").contains(part))
    return tree.withColumn("html_class", F.when(hit, "page-break-before").otherwise(F.col("html_class")))


def insert_public_info(tree: DataFrame, name: str, tag: str, body: str) -> DataFrame:
    """Add one fixed subsection to each document's first step-3 section and renumber that section.

    It follows the last of three named subsections, or goes last; sections that have it already are left alone.
    """
    step3 = tree.filter(F.lower("section_name").isin(V.STEP_3_NAMES))
    anchor = F.lower("name").isin(V.STEP_3_ANCHORS)
    target = step3.groupBy("document_id").agg(F.min(F.struct("section_order", "section_id", "section_name")).alias("m")).select("document_id", "m.*")
    facts = step3.groupBy("section_id").agg(
        F.max(F.when(anchor, F.col("order"))).alias("after"), F.max("order").alias("top"), F.bool_or(F.col("name") == name).alias("has")
    )
    places = target.join(facts, "section_id").filter(~F.col("has")).select(
        "document_id", "section_id", "section_name", "section_order", F.coalesce("after", "top").alias("after")
    )
    moved = tree.select("document_id", "section_id", "section_name", "section_order", "id", "name", "tag", "body", "order").join(
        places.select("section_id", "after"), "section_id", "left"
    )
    moved = moved.withColumn("order", F.col("order") + F.coalesce((F.col("order") > F.col("after")).cast("int"), F.lit(0))).drop("after")
    added = places.select(
        "document_id", "section_id", "section_name", "section_order", F.concat("section_id", F.lit("-public")).alias("id"),
        F.lit(name).alias("name"), F.lit(tag).alias("tag"), F.lit(body).alias("body"), (F.col("after") + 1).alias("order"),
    )
    return moved.unionByName(added)
