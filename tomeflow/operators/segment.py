"""HTML documents → tokens → blocks → sections → subsections.

Each document is one stored text value, so everything grouped by ``doc_id`` here is bounded by one cell. Documents are
spread by id once, before they are cut; every window and aggregate below reuses that partitioning, with no second
shuffle of the (much larger) token stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tomeflow import fixed_values as V
from tomeflow.operators import ordered
from tomeflow.functions import markup as M
from tomeflow.functions import text as X
from tomeflow.operators.filters import section_page_flag
from tomeflow.operators.templates import PLACEHOLDER

#: A tag, its attributes (which may hold ">" in quotes) and the text up to the next tag; a "<" that opens no tag is text.
TOKEN = r"""(?s)<(/?[a-zA-Z][a-zA-Z0-9]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>([^<]*+(?:<(?![/a-zA-Z])[^<]*+)*+)"""
#: Text before the first tag, or of a page without tags.
LEAD = r"(?s)^([^<]*+(?:<(?![/a-zA-Z])[^<]*+)*+)"
HIDDEN = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<![a-zA-Z][^>]*>|<\?[^>]*>"
STARTS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "tr", "table", "hr", "ul", "ol", "div", "img"]
CLOSES = ["/" + t for t in STARTS if t not in ("hr", "img")]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
KEY_CALLOUTS = {"key facts": "Key facts", "key dates": "Key dates"}



def _tok():
    return W.partitionBy("doc_id").orderBy("pos")


def _unit():
    return W.partitionBy("doc_id").orderBy("unit")


def html_tokens(raw: DataFrame, html: str = "html", spread: bool = True) -> DataFrame:
    """Ordered tags with attributes and the decoded text after them; comments, scripts, styles and declarations removed. Text
    before the first tag, or that of a page without tags, is a token without tag at place -1.

    With ``spread`` pages are dealt out by id, once, for windows per page to come; readers of single tags need no shuffle."""
    clean = F.regexp_replace(html, HIDDEN, "")
    rows = raw.select("doc_id", clean.alias("h"))
    rows = rows.repartition("doc_id") if spread else rows
    found = F.transform(F.regexp_extract_all("h", F.lit(TOKEN), F.lit(0)), lambda m, i: F.struct(i.alias("pos"), m.alias("m")))
    lead = F.regexp_extract("h", LEAD, 1)
    first = F.when(lead.rlike(r"\S"), F.array(F.struct(F.lit(-1).alias("pos"), lead.alias("m")))).otherwise(F.array().cast("array<struct<pos:int,m:string>>"))
    rows = rows.select("doc_id", F.inline(F.concat(first, found)))
    tag = F.lower(F.regexp_extract("m", TOKEN, 1))
    text = F.when(F.col("pos") < 0, F.col("m")).otherwise(F.regexp_extract("m", TOKEN, 3))
    return rows.select("doc_id", "pos", tag.alias("tag"), F.regexp_extract("m", TOKEN, 2).alias("attrs"), M.decoded(text).alias("text"))


def with_depth(tokens: DataFrame) -> DataFrame:
    void = F.col("tag").isin("", "br", "hr", "img", "meta", "input", "link")
    step = F.when(F.col("tag").startswith("/"), -1).when(void, 0).otherwise(1)
    return tokens.withColumn("depth", F.sum(step).over(_tok()))


def in_tables(tokens: DataFrame) -> DataFrame:
    """``tokens`` with their place in the tree of tables: ``depth_t`` (open tables), ``tbl`` (number of the innermost open one,
    0 outside), ``tr`` and ``cell`` (rows and cells begun in that table up to here).

    Brackets are matched by depth: the innermost table is the last one that was opened at the current depth. A closing tag too
    many closes nothing. Rows and cells are counted inside their own table, so a table in a cell does not disturb its rows, and
    closing tags of rows and cells may be missing."""
    tag = F.col("tag")
    step = F.when(tag == "table", 1).when(tag == "/table", -1).otherwise(0)
    rows = tokens.withColumn("__sum", F.sum(step).over(_tok())).withColumn("__nth", F.sum((tag == "table").cast("int")).over(_tok()))
    rows = rows.withColumn("depth_t", F.col("__sum") - F.least(F.min("__sum").over(_tok()), F.lit(0)))
    level = W.partitionBy("doc_id", "depth_t").orderBy("pos")
    inner = F.last(F.when(tag == "table", F.col("__nth")), True).over(level)
    rows = rows.withColumn("tbl", F.when(F.col("depth_t") > 0, inner).otherwise(0))
    own = W.partitionBy("doc_id", "tbl").orderBy("pos")
    rows = rows.withColumn("tr", F.sum((tag == "tr").cast("int")).over(own)).withColumn("cell", F.sum(tag.isin("td", "th").cast("int")).over(own))
    return rows.drop("__sum", "__nth")


def segments(tokens: DataFrame) -> DataFrame:
    """Every run of tokens from one block tag to the next, with its text (page titles left out) and its place in tables."""
    tag = F.col("tag")
    rows = in_tables(tokens).withColumn("seg", F.sum(F.when(tag.isin(STARTS + CLOSES), 1).otherwise(0)).over(_tok()))
    item = F.struct("pos", F.when(tag == "title", "").otherwise(F.col("text")).alias("text"))
    first = ["tag", "attrs", "depth_t", "tbl", "tr", "cell"]
    return rows.groupBy("doc_id", "seg").agg(
        F.min("pos").alias("pos"), *(F.min_by(c, "pos").alias(c) for c in first),
        X.squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "")).alias("text"),
    )


def blocks(tokens: DataFrame) -> DataFrame:
    """Runs of text under one block tag, each with its place in tables (``in_tables``). Text after a closing block tag, or before
    the first one, is a paragraph of its own, inside the cell it stands in."""
    loose = F.col("tag").startswith("/") | (F.col("seg") == 0)
    out = segments(tokens).filter((F.col("tag").isin(STARTS) & (F.col("seg") > 0)) | (loose & (F.col("text") != "")))
    return out.withColumn("attrs", F.when(loose, "").otherwise(F.col("attrs"))).withColumn("tag", F.when(loose, "p").otherwise(F.col("tag")))


def units(blocks_: DataFrame) -> DataFrame:
    """Top-level flow: one row per block outside tables, one per whole outermost table; empty ones dropped."""
    start = (F.col("depth_t") == 0) | ((F.col("tag") == "table") & (F.col("depth_t") == 1))
    w = W.partitionBy("doc_id").orderBy("seg")
    rows = blocks_.withColumn("unit", F.sum(start.cast("int")).over(w))
    cell, head = F.col("tag").isin("td", "th"), F.col("tag").isin(HEADINGS)
    item = F.when(F.col("text") != "", F.struct("seg", "text"))
    body_item = F.when((F.col("text") != "") & ~head, F.struct("seg", "text"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["text"]), " ")
    out = rows.groupBy("doc_id", "unit").agg(
        F.min_by("tag", "seg").alias("tag"), F.min_by("attrs", "seg").alias("attrs"),
        F.sum((F.col("tag") == "tr").cast("int")).alias("rows"), F.sum(cell.cast("int")).alias("cells"),
        F.bool_or(F.col("tag") == "img").alias("has_img"),
        joined(F.collect_list(item)).alias("text"), joined(F.collect_list(body_item)).alias("inner"),
        F.min_by("text", F.when(head, F.col("seg"))).alias("head_text"), F.min_by("tag", F.when(head, F.col("seg"))).alias("head_tag"),
    )
    out = out.withColumn("is_callout", (F.col("tag") == "table") & (F.col("rows") == 1) & (F.col("cells") == 1))
    return out.filter((F.col("text") != "") | F.col("has_img") | F.col("tag").isin("hr", "br"))


def heading_level(units_: DataFrame) -> DataFrame:
    """Section level per document: h1 if there is one, else h2; an h2 before the first h1 is an error."""
    h1, h2 = F.col("tag") == "h1", F.col("tag") == "h2"
    full = F.col("text") != ""
    g = units_.groupBy("doc_id").agg(
        F.min(F.when(h1 & full, F.col("unit"))).alias("u1"), F.min(F.when(h2 & full, F.col("unit"))).alias("u2"),
        F.min_by("text", F.when(h1 & full, F.col("unit"))).alias("t1"), F.min_by("text", F.when(h2 & full, F.col("unit"))).alias("t2"),
    )
    bad = F.col("u2") < F.col("u1")
    quote = F.format_string('Heading 2 "%s" comes before the first Heading 1 "%s".', "t2", "t1")
    return g.select("doc_id", F.when(F.col("u1").isNull(), "h2").otherwise("h1").alias("level"), F.when(bad, quote).alias("error"))


def assign_sections(units_: DataFrame) -> DataFrame:
    """Units with the number of their section; what comes before the first section heading is dropped."""
    w = W.partitionBy("doc_id")
    level = F.when(F.max(F.col("tag") == "h1").over(w), "h1").otherwise("h2")
    rows = units_.withColumn("level", level)
    rows = rows.withColumn("is_section", F.col("tag") == F.col("level"))
    return rows.withColumn("section", F.sum(F.col("is_section").cast("int")).over(_unit())).filter("section > 0")


def sections(assigned: DataFrame) -> DataFrame:
    id_ = M.attribute("attrs", "id")
    return assigned.filter("is_section").select("doc_id", F.col("section").alias("order"), F.col("text").alias("name"), id_.alias("html_id"), section_page_flag(F.col("text")).alias("has_section_page"))


def _key_title(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, shown in KEY_CALLOUTS.items():
        out = F.when(F.lower(c) == low, shown).otherwise(out)
    return out


def key_callouts(assigned: DataFrame) -> DataFrame:
    """``key_title`` on headings and paragraphs that name the callout table right after them."""
    w = W.partitionBy("doc_id", "section").orderBy("unit")
    nxt = F.lead("is_callout").over(w)
    can = F.col("tag").isin(HEADINGS + ["p"]) & F.coalesce(nxt, F.lit(False))
    return assigned.withColumn("key_title", F.when(can, _key_title(F.col("text"))))


def assign_subsections(assigned: DataFrame) -> DataFrame:
    """Subsections: a heading, a callout table, the first body block of a section, or what follows a callout opens one."""
    rows = key_callouts(assigned.filter(~F.col("is_section")))
    w = W.partitionBy("doc_id", "section").orderBy("unit")
    tags = F.when(F.col("level") == "h1", F.array(*map(F.lit, HEADINGS[1:]))).otherwise(F.array(*map(F.lit, HEADINGS[2:])))
    is_head = F.array_contains(tags, F.col("tag")) | F.col("key_title").isNotNull()
    rows = rows.withColumn("is_head", is_head)
    opens = F.col("is_head") | F.col("is_callout") | (F.row_number().over(w) == 1) | F.coalesce(F.lag("is_callout").over(w), F.lit(False))
    rows = rows.withColumn("order", F.sum(opens.cast("int")).over(w))
    item = F.when(~F.col("is_head"), F.struct("unit", F.when(F.col("is_callout"), F.col("inner")).otherwise(F.col("text")).alias("text")))
    g = rows.groupBy("doc_id", "section", "order").agg(
        F.min_by(F.struct("is_head", "is_callout", "tag", "text", "head_text", "head_tag", "key_title", "attrs", "level"), "unit").alias("f"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n").alias("body"),
    )
    own = F.when(F.col("f.is_head"), F.col("f.tag")).when(F.col("f.is_callout"), F.col("f.head_tag"))
    name = F.when(F.col("f.is_head"), F.coalesce("f.key_title", "f.text")).when(
        F.col("f.is_callout"), F.coalesce(_key_title(F.col("f.head_text")), F.col("f.head_text"))
    )
    lower = F.concat(F.lit("h"), F.substring(own, 2, 1).cast("int") + 1)
    keyed = F.col("f.key_title").isNotNull() | (F.col("f.is_callout") & _key_title(F.col("f.head_text")).isNotNull())
    tag = F.when(keyed, "h4").when(F.col("f.level") == "h1", lower).otherwise(own)
    return g.select(
        "doc_id", "section", "order", F.coalesce(name, F.lit("")).alias("name"), F.coalesce(tag, F.lit("")).alias("tag"),
        F.when(F.col("f.is_head"), M.attribute("f.attrs", "id")).otherwise("").alias("html_id"),
        F.col("f.is_callout").alias("callout_box"), "body",
    )


def _last(cond: Column) -> Column:
    return F.last(F.when(cond, F.col("unit")), True).over(_unit().rowsBetween(W.unboundedPreceding, 0))


def _level_upto(n: int) -> Column:
    return F.col("tag").isin(HEADINGS[:n])


def merge_label_value(units_: DataFrame, title: str = "funding details") -> DataFrame:
    """Inside the named h3/h4 part, join a paragraph ending in ":" with the value paragraph after it."""
    start = F.lower("text") == title
    scope = F.lit(False)
    for n in (3, 4):
        mine = _last(start & (F.col("tag") == f"h{n}"))
        scope = scope | F.coalesce(mine == _last(_level_upto(n)), F.lit(False))
    rows = units_.withColumn("in_scope", scope & (F.col("tag") == "p"))
    rows = rows.withColumn("is_label", F.col("in_scope") & F.col("text").endswith(":"))
    value = F.lead("in_scope").over(_unit()) & ~F.lead("is_label").over(_unit())
    rows = rows.withColumn("joins", F.col("is_label") & F.coalesce(value, F.lit(False)))
    text = F.when(F.col("joins"), F.concat("text", F.lit(" "), F.lead("text").over(_unit()))).otherwise(F.col("text"))
    rows = rows.withColumn("merged", text).withColumn("gone", F.coalesce(F.lag("joins").over(_unit()), F.lit(False)))
    return rows.filter(~F.col("gone")).withColumn("text", F.col("merged")).drop("in_scope", "is_label", "joins", "merged", "gone")


def drop_known_section(units_: DataFrame, title: str = "before you begin") -> DataFrame:
    """Remove the titled heading and what follows, up to a heading of the same or a higher level or a metadata line."""
    named = F.lower(F.regexp_replace("text", r"^[ :.\-]+|[ :.\-]+$", "")) == title
    stop_line = _last((F.col("tag") == "p") & X.looks_like_label(F.col("text")))
    inside = F.lit(False)
    for n in range(1, 7):
        mine = _last(named & (F.col("tag") == f"h{n}"))
        inside = inside | F.coalesce((mine == _last(_level_upto(n))) & (F.coalesce(stop_line, F.lit(-1)) < mine), F.lit(False))
    return units_.withColumn("__in", inside).filter(~F.col("__in")).drop("__in")


INSTRUCTIONS = r"^(instructions for (new )?\w+ (writers|(\w+ )?team)|.+-specific instructions)"


def _instructs() -> Column:
    return F.col("is_callout") & F.lower("text").rlike(INSTRUCTIONS)


def split_instructions(units_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, instructions): one-cell tables that open with instruction wording leave the content."""
    return units_.filter(~_instructs()), units_.filter(_instructs())


def instructed(units_: DataFrame) -> DataFrame:
    """All units of the documents that hold an instruction; only there can one be attached to anything."""
    return units_.withColumn("__has", F.bool_or(_instructs()).over(W.partitionBy("doc_id"))).filter("__has").drop("__has")


def normal_title(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"\s*\(.*\)\s*$", "")))


def attach_instructions(subsections: DataFrame, instructions: DataFrame) -> DataFrame:
    """(doc_id, section, order, instructions): the first subsection in document order whose title, or unnamed body start,
    equals the instruction's ``title``; one instruction per subsection."""
    named = F.col("name") != ""
    s = subsections.withColumn("__named", named).withColumn("__key", F.when(named, normal_title(F.col("name"))).otherwise(""))
    # an instruction looks for its title among the named and for any unnamed: one join, so the subsections are made once
    i = instructions.select("doc_id", "unit", "instructions", normal_title(F.col("title")).alias("norm"))
    key = lambda named, text: F.struct(F.lit(named).alias("__named"), text.alias("__key"))
    i = i.select("*", F.inline(F.array(key(True, F.col("norm")), key(False, F.lit("")))))
    begins = F.lower(F.trim("body")).startswith(F.col("norm")) & (F.col("norm") != "")
    place = F.struct("section", "order")
    both = s.join(i, ["doc_id", "__named", "__key"]).filter(F.col("__named") | begins)
    first = both.groupBy("doc_id", "unit").agg(F.min_by(F.struct("section", "order", "instructions"), place).alias("m")).select("doc_id", "unit", "m.*")
    return first.groupBy("doc_id", "section", "order").agg(F.min_by("instructions", "unit").alias("instructions"))


def detect_endnotes(tokens: DataFrame) -> DataFrame:
    """Documents without an Endnotes heading, with the token where one belongs: the last plain hr, else the last list of notes.
    The text of a heading or item includes that of the tags inside it."""
    tag = F.col("tag")
    rows = blocks(tokens).withColumn("next_tag", F.lead("tag").over(W.partitionBy("doc_id").orderBy("seg")))
    rows = rows.withColumn("li_attrs", F.when(F.col("next_tag") == "li", F.lead("attrs").over(W.partitionBy("doc_id").orderBy("seg"))))
    g = rows.groupBy("doc_id").agg(
        F.bool_or(tag.isin("h1", "h2") & (F.col("text") == "Endnotes")).alias("has"),
        F.max(F.when(tag == "hr", F.struct("pos", "attrs"))).alias("hr"),
        F.max(F.when(tag == "ol", F.struct("pos", "li_attrs"))).alias("ol"),
    )
    by_hr = F.col("hr.pos").isNotNull() & ~F.col("hr.attrs").contains("style=")
    by_ol = F.coalesce(M.attribute(F.col("ol.li_attrs"), "id").rlike("^(footnote|endnote)"), F.lit(False))
    kind = F.when(by_hr, "rule").when(by_ol, "list")
    out = g.filter(~F.col("has")).withColumn("kind", kind).filter("kind IS NOT NULL")
    return out.select("doc_id", "kind", F.when(F.col("kind") == "rule", F.col("hr.pos")).otherwise(F.col("ol.pos")).alias("pos"))


def table_captions(units_: DataFrame) -> DataFrame:
    """A table's caption is the block before it when that opens with "table: " or "Table: "."""
    before = F.lag("text").over(_unit())
    return units_.withColumn("before", before).filter((F.col("tag") == "table") & F.lower("before").startswith("table: ")).select("doc_id", "unit", F.col("before").alias("caption"))


def table_cells(blocks_: DataFrame) -> DataFrame:
    """Cells with table, row (1-based inside the table) and the text of everything in the cell; what stands in a table inside the
    cell is in that table's cells."""
    rows = blocks_.filter("cell > 0 AND tbl > 0 AND tag NOT IN ('tr', 'table')")
    item = F.struct("seg", "text")
    return rows.groupBy("doc_id", "tbl", "cell").agg(
        F.min_by("tag", "seg").alias("tag"), F.min_by("attrs", "seg").alias("attrs"), F.min("tr").alias("tr"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ")).alias("text"),
    ).withColumn("row", F.dense_rank().over(W.partitionBy("doc_id", "tbl").orderBy("tr"))).drop("tr")


def table_header_fix(cells: DataFrame) -> DataFrame:
    """First row holds header cells; in an all-header table of several rows only the first row keeps them. A table with a
    cell that spans rows stays as it is."""
    w = W.partitionBy("doc_id", "tbl")
    spanned = F.max(~M.attribute("attrs", "rowspan").isin("", "1")).over(w)
    all_th = F.min((F.col("tag") == "th").cast("int")).over(w) == 1
    many = F.max("row").over(w) > 1
    tag = F.when(spanned, F.col("tag")).when(F.col("row") == 1, "th").when(all_th & many, "td").otherwise(F.col("tag"))
    return cells.withColumn("new_tag", tag)


def header_widths(fixed: DataFrame) -> DataFrame:
    """Width class of each header cell (``table_header_fix`` rows): by the number of header cells in its row, and with three of
    them by what they say."""
    th = F.col("new_tag") == "th"
    n = F.sum(th.cast("int")).over(W.partitionBy("doc_id", "tbl", "row"))
    low = F.lower("text")
    said = F.when(low == "component", "w-45").when(low.startswith("how to upload") | low.startswith("how to submit"), "w-40").when(low.contains("page limit"), "w-15").otherwise("w-33")
    width = F.when(n == 3, said).when(n == 4, "w-25").when(n == 5, "w-20").otherwise("")
    return fixed.withColumn("width", F.when(th, width))


def table_shape(cells: DataFrame) -> DataFrame:
    """Columns, rows, words and the size class of each table."""
    words = F.regexp_count("text", F.lit(r"(?U)\S+"))
    th = F.col("tag") == "th"
    by_row = cells.groupBy("doc_id", "tbl", "row").agg(
        F.count("*").alias("cols"), F.sum(F.when(~th, words).otherwise(0)).alias("words"), F.sum(words).alias("all_words"),
        F.bool_or(th & (F.col("text") == "Recommended For")).alias("rec"), F.bool_or(th & (F.col("text") == "Criterion")).alias("cri"),
    )
    g = by_row.groupBy("doc_id", "tbl").agg(
        F.max(F.when(F.col("row") == 1, F.col("cols"))).alias("columns"), F.count("*").alias("rows"), F.sum("words").alias("words"),
        F.sum((F.col("all_words") == 0).cast("int")).alias("empty_rows"), F.bool_or("rec").alias("rec"), F.bool_or("cri").alias("cri"),
    )
    size = (
        F.when(F.col("rec"), "large").when(F.col("cri"), "criterion").when((F.col("words") == 0) & (F.col("columns") < 4), "small")
        .when(F.col("words") > 120, "large").when(F.col("columns") >= 3, "large").otherwise("small")
    )
    return g.select("doc_id", "tbl", "columns", "rows", "words", "empty_rows", size.alias("size"))


def images(tokens: DataFrame) -> DataFrame:
    return tokens.filter("tag = 'img'").withColumn("src", M.attribute("attrs", "src"))


def missing_alt_text(tokens: DataFrame) -> DataFrame:
    """Every image with its alternative text, blank lines in it collapsed, and whether it has none at all (alt="" is one)."""
    missing = ~F.col("attrs").rlike(r"(?i)(?:^|[\s\"'])alt\s*=")
    alt = F.replace(M.decoded(M.attribute("attrs", "alt")), F.lit("\n\n"), F.lit("\n"))
    return images(tokens).select("doc_id", "pos", "src", alt.alias("alt"), missing.alias("missing"))


def inline_image_paths(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """Path under the document number for images that are not embedded; documents without a number are skipped."""
    rows = images(tokens).filter(~F.col("src").startswith("data:")).join(docs.filter("number <> ''").select("doc_id", "number"), "doc_id")
    file = F.element_at(F.split("src", "/"), -1)
    return rows.select("doc_id", "pos", "src", F.concat(F.lit("/static/img/inline/"), F.lower("number"), F.lit("/"), file).alias("new_src"))


def unwrap_tracking(url: Column) -> Column:
    """Target of a search-engine redirect, other urls unchanged."""
    q = F.try_url_decode(F.regexp_extract(F.replace(url, F.lit("&amp;"), F.lit("&")), "[?&]q=([^&]*)", 1))
    return F.when(url.startswith("https://www.google.com/url?") & url.contains("q="), q).otherwise(url)


def anchors(tokens: DataFrame) -> DataFrame:
    href = M.attribute("attrs", "href")
    id_ = M.attribute("attrs", "id", "name")
    return tokens.filter("tag = 'a'").withColumn("href", href).withColumn("anchor_id", id_)


def anchor_elements(tokens: DataFrame) -> DataFrame:
    """One row per anchor, with the text of all that is inside it: ``pos``, ``attrs``, ``text``, ``first`` and ``last`` (its tokens,
    a span around the anchor alone included; ``last`` is null if it is never closed), ``after`` (text right behind it) and
    ``then`` (text of the element after that, if it holds nothing but text)."""
    tag, here = F.col("tag"), _tok().rowsBetween(W.unboundedPreceding, 0)
    bare = F.trim("text") == ""
    wraps = F.coalesce((F.lag("tag").over(_tok()) == "span") & (F.lag(bare).over(_tok())), F.lit(False))
    closed = F.coalesce((F.lead("tag").over(_tok()) == "/span") & bare, F.lit(False))
    only = lambda n: F.when(F.lead("tag", n + 1).over(_tok()) == F.concat(F.lit("/"), F.lead("tag", n).over(_tok())), F.lead("text", n).over(_tok()))
    rows = tokens.withColumn("__open", F.last(F.when(tag.isin("a", "/a"), F.struct("pos", (tag == "a").alias("opens"))), True).over(here))
    rows = rows.withColumn("__last", F.last(F.when(tag == "a", F.col("pos")), True).over(_tok().rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("__wraps", wraps).withColumn("__closed", closed)
    rows = rows.withColumn("__next", F.lead("text").over(_tok())).withColumn("__then1", only(1)).withColumn("__then2", only(2))
    rows = rows.withColumn("__of", F.when(tag == "/a", F.col("__last")).when(F.col("__open.opens"), F.col("__open.pos"))).filter("__of IS NOT NULL")
    item, end = F.when(tag != "/a", F.struct("pos", "text")), tag == "/a"
    g = rows.groupBy("doc_id", F.col("__of").alias("pos")).agg(
        F.min_by("attrs", "pos").alias("attrs"), F.min_by("__wraps", "pos").alias("wraps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "").alias("text"),
        F.min_by(F.struct("pos", F.col("__closed").alias("closed"), "text", "__next", "__then1", "__then2"), F.when(end, F.col("pos"))).alias("e"),
    )
    wrapped = F.col("wraps") & F.coalesce(F.col("e.closed"), F.lit(False))
    return g.select(
        "doc_id", "pos", "attrs", "text", (F.col("pos") - wrapped.cast("int")).alias("first"), (F.col("e.pos") + wrapped.cast("int")).alias("last"),
        F.when(wrapped, F.col("e.__next")).otherwise(F.col("e.text")).alias("after"), F.when(wrapped, F.col("e.__then2")).otherwise(F.col("e.__then1")).alias("then"),
    )


def merge_adjacent_links(tokens: DataFrame) -> DataFrame:
    """Anchors of the same target, or of the same id without a target, with nothing but space between them become one row, their
    texts joined, a space between where one stood. ``drops_space``: what follows is space and then punctuation, so the space goes."""
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = anchor_elements(tokens).withColumn("href", M.attribute("attrs", "href")).withColumn("id", M.attribute("attrs", "id"))
    blank = F.trim(F.lag("after").over(w)) == ""
    same = (F.col("href") == F.lag("href").over(w)) & ((F.col("href") != "") | ((F.col("id") != "") & (F.col("id") == F.lag("id").over(w))))
    joins = F.coalesce(blank & same & (F.lag("last").over(w) + 1 == F.col("first")), F.lit(False))
    piece = F.concat(F.when(joins & (F.lag("after").over(w) != ""), " ").otherwise(""), F.col("text"))
    rows = rows.withColumn("piece", piece).withColumn("joins", joins)
    rows = rows.withColumn("run", F.sum((~F.col("joins")).cast("int")).over(w)).filter("href <> '' OR id <> ''")
    glue = (F.col("after") != "") & (F.trim("after") == "") & F.coalesce(F.col("then").rlike("^[.,;!?]"), F.lit(False))
    item = F.struct("pos", F.col("piece").alias("text"))
    return rows.groupBy("doc_id", "run").agg(
        F.min("pos").alias("pos"), F.min("href").alias("href"), F.min_by("id", "pos").alias("id"), F.count("*").alias("links"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "").alias("text"),
        F.max_by(F.coalesce(glue, F.lit(False)), "pos").alias("drops_space"),
    ).drop("run")


def block_names(tokens: DataFrame) -> DataFrame:
    """(doc_id, id, target_pos, new_id) of every id of a document. An empty anchor hands its id to the block it stands in, or, if
    that has no text and is no heading, to the next block that has or is. A block named several times keeps the last of these
    ids, else its own; ``new_id`` is that name. Ids of anything else name themselves. Of an id given twice the first counts."""
    tag = F.col("tag")
    nxt = F.lead("tag").over(_tok())
    empty = (tag == "a") & (F.trim("text") == "") & (nxt == "/a") & (M.attribute("attrs", "href") == "")
    rows = in_tables(tokens).withColumn("seg", F.sum(F.when(tag.isin(STARTS + CLOSES), 1).otherwise(0)).over(_tok()))
    rows = rows.withColumn("id", M.attribute("attrs", "id", "name")).withColumn("__empty", F.coalesce(empty, F.lit(False)))
    named = F.struct("pos", "id", "__empty")
    g = rows.groupBy("doc_id", "seg").agg(
        F.min("pos").alias("pos"), F.min_by("tag", "pos").alias("tag"), F.max(F.trim("text") != "").alias("full"), F.collect_list(F.when(F.col("id") != "", named)).alias("ids"),
    )
    after = W.partitionBy("doc_id").orderBy("seg").rowsBetween(0, W.unboundedFollowing)
    takes = F.when((F.col("full") & ~F.col("tag").isin("table", "tr", "ul", "ol", "/table", "/tr", "/ul", "/ol")) | F.col("tag").isin(HEADINGS), F.struct("pos", "seg"))
    g = g.withColumn("to", F.first(takes, True).over(after)).select("doc_id", F.col("pos").alias("block_pos"), F.coalesce("to.pos", "pos").alias("to_pos"), F.explode("ids").alias("n"))
    own = F.col("n.pos") == F.col("block_pos")
    rows = g.select("doc_id", "n.id", "n.pos", F.when(F.col("n.__empty"), F.col("to_pos")).otherwise(F.col("n.pos")).alias("target_pos"), F.col("n.__empty").alias("handed"), own.alias("own"))
    w = W.partitionBy("doc_id", "target_pos")
    rows = rows.withColumn("new_id", F.max(F.struct("handed", "pos", "id")).over(w)["id"])
    return rows.groupBy("doc_id", "id").agg(F.min_by(F.struct("target_pos", "new_id"), "pos").alias("m")).select("doc_id", "id", "m.*")


def resolve_anchors(tokens: DataFrame) -> DataFrame:
    """Internal links with the block that carries their target and the name it has in the end (``block_names``); links to ids
    that exist nowhere are marked ``#__id``."""
    links = anchors(tokens).filter("href LIKE '#%'").withColumn("id", F.substring(F.col("href"), F.lit(2), F.length("href")))
    out = links.select("doc_id", "pos", "href", "id").join(block_names(tokens), ["doc_id", "id"], "left")
    new = F.when(F.col("new_id").isNull(), F.concat(F.lit("#__"), "id")).otherwise(F.concat(F.lit("#"), "new_id"))
    return out.select("doc_id", "pos", "href", "target_pos", new.alias("new_href"))


def bold_classes(raw: DataFrame) -> DataFrame:
    """CSS classes of weight 700 that are not set at 18pt or more."""
    css = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1)), " ")
    rule = F.explode(F.regexp_extract_all(css, F.lit(r"\.[a-zA-Z0-9_-]+\{[^}]*\}"), F.lit(0)))
    rows = raw.select("doc_id", rule.alias("rule"))
    size = F.regexp_extract("rule", r"font-size:\s*([0-9]+)pt", 1)
    bold = F.col("rule").rlike(r"font-weight:\s*700") & ~(F.coalesce(F.try_to_number(size, F.lit("999")), F.lit(0)) >= 18)
    return rows.filter(bold).select("doc_id", F.regexp_extract("rule", r"^\.([a-zA-Z0-9_-]+)", 1).alias("class"))


def bold_elements(raw: DataFrame, tokens: DataFrame) -> DataFrame:
    """Elements with a bold class; those in the first row of a table, its head or its body are bold anyway and left out."""
    tag = F.col("tag")
    upto = _tok().rowsBetween(W.unboundedPreceding, 0)
    opened = F.last(F.when(tag.isin("table", "thead", "tbody"), F.col("pos")), True).over(upto)
    last_row = F.last(F.when(tag.isin("tr", "/tr"), F.struct("pos", "tag")), True).over(upto)
    rows = tokens.withColumn("__opened", opened).withColumn("__row", last_row)
    nth = F.sum((tag == "tr").cast("int")).over(W.partitionBy("doc_id", "__opened").orderBy("pos"))
    heading = (F.col("__row.tag") == "tr") & (F.col("__row.pos") > F.col("__opened")) & (nth == 1)
    rows = rows.withColumn("__first", F.coalesce(heading, F.lit(False))).filter(~F.col("__first"))
    classes = F.explode(F.split(M.attribute("attrs", "class"), " "))
    rows = rows.select("doc_id", "pos", "tag", classes.alias("class"))
    return rows.join(bold_classes(raw).distinct(), ["doc_id", "class"])


def extract_metadata(blocks_: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """First "Label: value" text per field and document, in running text or in a cell, one row per document; the opdiv value may
    stand in the next paragraph of the same cell when the one after it is again a label."""
    low = F.lower("text")
    w = W.partitionBy("doc_id", "tbl", "cell").orderBy("seg")
    beside = lambda n: F.when((F.col("tag") == "p") & (F.lead("tag", n).over(w) == "p"), F.lead("text", n).over(w))
    rows = blocks_.filter("text <> '' OR tag <> 'p'").withColumn("n1", beside(1)).withColumn("n2", beside(2))
    aggs = []
    for field, label in V.METADATA_TEXTS.items():
        value = F.trim(F.substring(F.col("text"), F.lit(len(label) + 1), F.length("text")))
        if field == "opdiv":
            nxt = F.when(~X.looks_like_label(F.col("n1")) & ~X.is_placeholder_acronym(F.col("n1")) & X.looks_like_label(F.col("n2")), F.col("n1"))
            value = F.coalesce(F.nullif(value, F.lit("")), nxt, F.lit(""))
        default = (defaults or {}).get(field, "")
        found = F.min_by(value, F.when(low.startswith(label), F.col("seg")))
        aggs.append(F.coalesce(F.nullif(found, F.lit("")), F.lit(default)).alias(field))
    return rows.groupBy("doc_id").agg(*aggs)


def theme_for(number: Column, opdiv: Column) -> Column:
    """Theme by owner or number, lower-cased: the first of ``fixed_values.THEME_RULES`` whose pattern is found."""
    of = {"number": F.lower(number), "owner": F.lower(opdiv)}
    out = F.lit(V.THEME_ELSE)
    for field, pattern, theme in reversed(V.THEME_RULES):
        out = F.when(of[field].rlike(pattern), theme).otherwise(out)
    return out


def classify_document(docs: DataFrame, images: DataFrame, pages_group: str = "nih") -> DataFrame:
    """Theme, cover, opening page and cover image by rule: the stored image that carries the document's number, else one fixed
    by a word of the title, else none. ``images`` holds the stored keys."""
    rows = docs.withColumn("new_theme", theme_for(F.col("number"), F.col("opdiv")))
    text_cover = F.col("new_theme").rlike("acf-|acl-|hrsa-|nih-")
    own = F.concat(F.lit(V.COVER_FOLDER), F.lower("number"), F.lit(".jpg"))
    stored = images.select(F.col("key").alias("__own"), F.lit(True).alias("__stored")).distinct()
    titled = F.lit("")
    for word, key in V.COVER_BY_TITLE.items():
        titled = F.when(F.lower("title").contains(word), V.COVER_FOLDER + key).otherwise(titled)
    rows = rows.withColumn("__own", own).join(stored, "__own", "left")
    rows = rows.withColumn("new_cover_image", F.when(F.col("__stored"), F.col("__own")).otherwise(F.coalesce(titled, F.lit("")))).drop("__own", "__stored")
    return rows.withColumn("new_cover", F.when(text_cover, "text").otherwise("medium")).withColumn(
        "before_you_begin", F.when(F.col("group") == pages_group, "era").otherwise("full")
    )


def build_rows(tree: DataFrame) -> DataFrame:
    """Default ids, ``optional`` and the edit mode of freshly imported subsections."""
    low_i, low_b = F.lower("instructions"), F.lower("body")
    optional = low_i.contains("section is only required if")
    has_var = F.col("body").rlike(PLACEHOLDER)
    mode = F.when(has_var, "variables").when(optional | low_b.contains("insert") | low_i.contains("insert"), "full").otherwise("locked")
    made = F.concat_ws("--", F.col("order").cast("string"), X.slug(F.col("section_name")), X.slug(F.col("name")))
    html_id = F.when((F.col("html_id") == "") & (F.col("name") != ""), made).otherwise(F.col("html_id"))
    return tree.withColumn("optional", optional).withColumn("edit_mode", mode).withColumn("html_id", html_id)


def checklist_children(rows: DataFrame, key: list[str]) -> DataFrame:
    """Mark checkbox rows indented under an earlier one: ``pos``, ``indent`` (null without a checkbox).

    A child run starts at a checkbox row indented deeper than the checkbox row right before it, goes on while rows stay
    deeper than the smallest indent so far, and ends at any other row. ``key`` names one table, a part of one document.
    """
    chunk = ordered.chunk_of("pos")
    r = ordered.scan(rows, key, ["pos"], chunk, __before=ordered.lag(F.col("indent")), __low=ordered.max_before(-F.col("indent")))
    deep = F.coalesce(F.col("indent") > -F.col("__low"), F.lit(False))
    begins = deep & F.coalesce(F.col("__before") < F.col("indent"), F.lit(False))
    r = r.withColumn("__deep", deep).withColumn("__begins", begins)
    begun, broken = ordered.last_upto(F.when(F.col("__begins"), F.col("pos"))), ordered.last_upto(F.when(~F.col("__deep"), F.col("pos")))
    r = ordered.scan(r, key, ["pos"], chunk, __begun=begun, __broken=broken)
    child = F.col("__deep") & F.coalesce(F.col("__begun") > F.col("__broken"), F.col("__begun").isNotNull())
    return r.withColumn("is_child", child).select(*rows.columns, "is_child")


def sublist_rows(cells: DataFrame) -> DataFrame:
    """First cells of table rows: list heading, numbered item, row under a heading, row before a sublist."""
    first = cells.groupBy("doc_id", "tbl", "row").agg(F.min(F.struct("cell", "text")).alias("m")).select("doc_id", "tbl", "row", F.col("m.text").alias("text"))
    low = F.lower("text")
    w = W.partitionBy("doc_id", "tbl").orderBy("row")
    heading = low.startswith("other required forms") | low.isin("attachments", "narratives", "forms")
    numbered = X.is_numbered_item(F.concat(F.trim(F.replace("text", F.lit("◻"), F.lit(""))), F.lit(" ")))
    r = first.withColumn("is_heading", heading).withColumn("is_numbered", numbered)
    under = F.coalesce(F.lag("is_heading").over(w), F.lit(False))
    before = F.coalesce(F.lead("is_heading").over(w) | (F.col("is_numbered") & ~F.lead("is_numbered").over(w)), F.lit(False))
    return r.withColumn("under_heading", under).withColumn("before_sublist", before)
