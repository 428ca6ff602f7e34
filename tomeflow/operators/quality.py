"""Quality reports: links, ids, page breaks, counts per document, readability against goals.

Per-document numbers are summed per section first and only then joined to the section's document, so the join
moves one row per section instead of every body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.functions import links as L
from tomeflow.functions.markup import TAG, attribute
from tomeflow.functions import readability as R
from tomeflow.functions import text as X
from tomeflow.operators import trees
from tomeflow.operators.filters import blank, missing_metadata
from tomeflow.session import cut

PAGE_BREAK = "page-break"

GOALS = {
    "word_count": ("Target", "at_most", 13500.0, None, None),
    "words_per_sentence": ("Target", "at_most", 15.0, None, None),
    "sentences_per_paragraph": ("Target", "at_most", 3.0, None, None),
    "flesch_reading_ease": ("Target", "at_least", 39.0, None, None),
    "flesch_kincaid_grade_level": ("Target range, depending on document type", "at_most_by_category", None, 11.5, 12.5),
    "passive_sentence_percentage": ("Target", "at_most", 8.0, None, None),
}
GOAL_SCHEMA = "metric_id string, label string, operator string, value double, minimum double, maximum double"


def _section_docs(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("id").alias("section_id"), "document_id")


def per_document(per_section: DataFrame, sections: DataFrame, *sums: str) -> DataFrame:
    rows = per_section.join(_section_docs(sections), "section_id")
    return rows.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in sums])


def links(subsections: DataFrame) -> DataFrame:
    """Every link of every body."""
    rows = subsections.filter(F.col("body").contains("](") | F.col("body").rlike("(?i)href\\s*=|<https?://")).select("id", "section_id", "body")
    return rows.select("id", "section_id", F.explode(L.found(F.col("body"))).alias("l")).select("id", "section_id", "l.*")


def external_links(subsections: DataFrame, sections: DataFrame, own_domain: str) -> DataFrame:
    """http(s) links that leave the own domain, with host, section and subsection."""
    s = sections.select(F.col("id").alias("section_id"), "document_id", F.col("name").alias("section_name"))
    rows = links(subsections).filter(L.external(F.col("url"), own_domain)).join(s, "section_id")
    return rows.withColumnRenamed("id", "subsection_id").withColumn("domain", F.lower(F.expr("try_parse_url(url, 'HOST')")))


def document_ids(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    """Distinct ``#id`` anchors of each document: section ids, subsection ids and ids inside bodies.

    Ids are made distinct per section before the join to documents, then per document.
    """
    below = subsections.select("section_id", F.explode(_ids_in(F.col("body"), F.col("html_id"))).alias("ref"))
    return _anchors(below, sections)


def _ids_in(body: Column, html_id: Column) -> Column:
    """Ids of tags in a body and the row's own, if it has one."""
    tags = F.regexp_extract_all(body, F.lit(r"""(?is)<[a-z][a-z0-9]*(\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""), F.lit(1))
    inline = F.transform(F.filter(tags, lambda t: F.lower(t).contains("id")), lambda t: attribute(t, "id"))
    return F.filter(F.concat(F.array(html_id), F.coalesce(inline, F.array().cast("array<string>"))), lambda x: x != "")


def _anchors(below: DataFrame, sections: DataFrame) -> DataFrame:
    """``below`` (section_id, ref) and the sections' own ids as ``#id`` per document."""
    below = below.distinct().join(_section_docs(sections), "section_id")
    top = sections.select("document_id", F.col("html_id").alias("ref"))
    return top.unionByName(below.select("document_id", "ref")).select("document_id", F.concat(F.lit("#"), "ref").alias("ref")).distinct()


def _unmatched(found: DataFrame, refs: DataFrame, sections: DataFrame) -> DataFrame:
    rows = found.filter(L.looks_broken(F.col("url"))).join(_section_docs(sections), "section_id")
    return rows.join(refs.withColumnRenamed("ref", "url"), ["document_id", "url"], "left_anti").withColumnRenamed("id", "subsection_id")


def broken_links(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    """Links that can only be internal leftovers and match no anchor of their document."""
    return _unmatched(links(subsections), document_ids(subsections, sections), sections)


def link_status(found: DataFrame, crawl: DataFrame) -> DataFrame:
    """Attach crawl results to links; a GET result wins where HEAD gave a code that often lies.

    ``crawl`` holds at most one row per (url, method) and is folded to one row per url before the join.
    """
    retry = F.col("head.status").isin(403, 405, 500, 501, 502, 503)
    both = crawl.groupBy("url").agg(
        F.max_by(F.struct("status", "final_url", "error"), F.when(F.col("method") == "HEAD", 1)).alias("head"),
        F.max_by(F.struct("status", "final_url", "error"), F.when((F.col("method") == "GET") & F.col("status").isNotNull(), 1)).alias("get"),
    )
    best = F.when(retry & F.col("get").isNotNull(), F.col("get")).otherwise(F.col("head"))
    one = both.select("url", best.alias("best")).select(
        "url", "best.status", F.when(F.col("best.final_url") != F.col("url"), F.col("best.final_url")).alias("redirect_url"), "best.error"
    )
    return found.join(one, "url", "left")


def link_totals(subsections: DataFrame, sections: DataFrame, own_domain: str) -> DataFrame:
    """External links per document; summing ``links`` gives the overall total."""
    n = links(subsections).filter(L.external(F.col("url"), own_domain)).groupBy("section_id").agg(F.count("*").alias("links"))
    return per_document(n, sections, "links")


def breaks_in(html_class: Column, body: Column) -> Column:
    classes = F.size(F.filter(F.split(html_class, " "), lambda c: c.startswith(PAGE_BREAK)))
    return classes + F.regexp_count(body, F.lit(PAGE_BREAK))


def page_break_counts(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    n = subsections.groupBy("section_id").agg(F.sum(breaks_in(F.col("html_class"), F.col("body"))).alias("page_breaks"))
    return per_document(n, sections, "page_breaks")


def words_in(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"(?U)\S+"))


def callout_words(callouts: DataFrame, sections: DataFrame) -> DataFrame:
    n = callouts.groupBy("section_id").agg(F.sum(words_in(F.col("body"))).alias("words"))
    return per_document(n, sections, "words")


def name_lengths(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    """Character length of section names and of named subsections."""
    a = sections.select("document_id", F.lit("section").alias("kind"), "id", "name")
    b = subsections.filter(F.col("name") != "").join(_section_docs(sections), "section_id").select("document_id", F.lit("subsection").alias("kind"), "id", "name")
    return a.unionByName(b).withColumn("length", F.length("name"))


def name_counts(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    n = subsections.groupBy("section_id").agg(F.count(F.when(F.col("name") != "", 1)).alias("subsections"))
    rows = _section_docs(sections).join(n, "section_id", "left")
    return rows.groupBy("document_id").agg(F.count("*").alias("sections"), F.coalesce(F.sum("subsections"), F.lit(0)).alias("subsections"))


def row_facts(subsections: DataFrame) -> DataFrame:
    """What the summary needs of a subsection, taken from its body once: links, ids, page breaks, and whether there is a body."""
    body = F.col("body")
    return subsections.select(
        "section_id", "id", "order", "name", "tag", L.found(body).alias("links"), _ids_in(body, F.col("html_id")).alias("refs"),
        breaks_in(F.col("html_class"), body).alias("breaks"), F.when(blank("body"), "").otherwise("x").alias("body"),
    )


def quality_summary(docs: DataFrame, sections: DataFrame, subsections: DataFrame, own_domain: str) -> DataFrame:
    """One row per document with its warning counts. External links count only while a document is open.

    Bodies are read once: their facts, and the few columns of the sections, are written and every count starts from there."""
    facts = cut(row_facts(subsections))
    sections = cut(sections.select("id", "document_id", "name", "html_id"))
    ext = F.size(F.filter("links", lambda l: L.external(l["url"], own_domain)))
    per_section = facts.groupBy("section_id").agg(F.sum(ext).alias("external_links"), F.sum("breaks").alias("page_breaks"))
    errors = trees.union_heading_errors(facts, sections).groupBy("section_id").agg(F.count("*").alias("heading_errors"))
    counts = per_document(per_section.join(errors, "section_id", "left"), sections, "external_links", "page_breaks", "heading_errors")
    linked = facts.select("id", "section_id", F.explode("links").alias("l")).select("id", "section_id", "l.*")
    refs = _anchors(facts.select("section_id", F.explode("refs").alias("ref")), sections)
    broken = _unmatched(linked, refs, sections).groupBy("document_id").agg(F.count("*").alias("broken_links"))
    missing = missing_metadata(docs).groupBy(F.col("id").alias("document_id")).agg(F.count("*").alias("missing_metadata"))
    rows = docs.select(F.col("id").alias("document_id"), "status")
    for part in (counts, broken, missing):
        rows = rows.join(part, "document_id", "left")
    rows = rows.fillna(0, ["external_links", "page_breaks", "heading_errors", "broken_links", "missing_metadata"])
    shown = F.when(F.col("status").isin(V.LINK_WARNING_STATUSES), F.col("external_links")).otherwise(0)
    rows = rows.withColumn("external_links", shown)
    warn = (F.col("missing_metadata") + F.col("broken_links") + F.col("heading_errors") + F.col("external_links")) > 0
    return rows.withColumn("has_warnings", warn)


def readability(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Six metrics per document. Counts are taken per row and summed, so a document may span many rows."""
    c = R.counts(F.col(text))
    sums = texts.select(key, *[v.alias(k) for k, v in c.items()]).groupBy(key).agg(*[F.sum(k).alias(k) for k in c])
    m = R.metrics(*[F.col(k) for k in ("words", "sentences", "paragraphs", "syllables", "passive")])
    return sums.select(key, *[v.alias(k) for k, v in m.items()])


def default_goals(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in GOALS.items()], GOAL_SCHEMA)


def check_goals(goals: DataFrame) -> DataFrame:
    """Adds ``problem`` to goal rows that cannot be used."""
    ranged = F.col("operator") == "at_most_by_category"
    problem = (
        F.when(~F.col("metric_id").isin(list(GOALS)), "unsupported metric")
        .when(F.coalesce(F.trim("label"), F.lit("")) == "", "label required")
        .when(~F.coalesce(F.col("operator").isin("at_least", "at_most", "at_most_by_category"), F.lit(False)), "unknown operator")
        .when(ranged & F.col("value").isNotNull(), "a range cannot use value")
        .when(ranged & (F.col("minimum").isNull() | F.col("maximum").isNull()), "range needs minimum and maximum")
        .when(ranged & (F.col("minimum") >= F.col("maximum")), "minimum must be below maximum")
        .when(~ranged & (F.col("minimum").isNotNull() | F.col("maximum").isNotNull()), "only a range uses minimum and maximum")
        .when(~ranged & F.col("value").isNull(), "value required")
    )
    return goals.withColumn("problem", problem)


def readability_goals(metrics: DataFrame, key: str, goals: DataFrame) -> DataFrame:
    """Each metric against each of its goals. ``goals`` is a configuration table of a few rows per metric."""
    long = metrics.unpivot(key, list(GOALS), "metric_id", "metric")
    usable = check_goals(goals).filter(F.col("problem").isNull())
    v, ok, bad = F.col("metric"), F.lit("Within target"), F.lit("Needs improvement")
    in_range = F.when(v <= F.col("minimum"), ok).when(v > F.col("maximum"), bad).otherwise("Check document type")
    verdict = (
        F.when(F.col("operator") == "at_most_by_category", in_range)
        .when((F.col("operator") == "at_most") & (v <= F.col("value")), ok)
        .when((F.col("operator") == "at_least") & (v >= F.col("value")), ok)
        .otherwise(bad)
    )
    return long.join(usable, "metric_id").select(key, "metric_id", "metric", verdict.alias("assessment"))


def image_usage(images: DataFrame, docs: DataFrame) -> DataFrame:
    """Each image key with every unarchived document using it, one row per use (an unused image keeps one row).

    An inner join, whose hot keys Spark can split on either side, and the unused images beside it."""
    d = docs.filter(F.col("archived").isNull()).select(F.col("cover_image").alias("key"), F.col("id").alias("document_id"), "title", "status")
    used = images.select("key").join(d, "key")
    unused = images.select("key").join(d.select("key").distinct(), "key", "left_anti")
    return used.unionByName(unused, allowMissingColumns=True)


def field_value_mentions(tree: DataFrame, docs: DataFrame, field: str) -> DataFrame:
    """Subsections that mention their own document's field value (link targets do not count)."""
    d = docs.filter(F.col(field) != "").select(F.col("id").alias("document_id"), F.lower(field).alias("__v"))
    first = (F.lower("name") == "basic information") & (F.col("order") == 1) & (F.col("section_order") == 1)
    rows = tree.filter(~first).join(d, "document_id")
    return rows.filter(F.lower(X.strip_md_links(F.col("body"))).contains(F.col("__v"))).drop("__v")


def another_superuser(users: DataFrame) -> DataFrame:
    """For each user: is there a superuser besides them? One scalar sub-query, no join."""
    n = users.filter("is_superuser").agg(F.count("*").alias("n")).scalar()
    return users.select("id", (n - F.col("is_superuser").cast("int") > 0).alias("another_superuser"))


def has_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    have = sections.select("document_id").distinct().withColumn("__has", F.lit(True))
    rows = docs.select(F.col("id").alias("document_id")).join(have, "document_id", "left")
    return rows.select("document_id", F.coalesce("__has", F.lit(False)).alias("has_sections"))


def person_choices(docs: DataFrame, users: DataFrame, field: str, legacy: dict[str, str]) -> DataFrame:
    """Names to offer: one list per group, plus a document's stored value where its group's list lacks it.

    Kept as two kinds of rows instead of documents x names, so the output stays linear in both tables.
    """
    names = users.filter(F.col("is_active") & (F.trim("full_name") != "")).select("group", F.trim("full_name").alias("value")).distinct()
    label = F.trim(field)
    for code, text in legacy.items():
        label = F.when(F.trim(field) == code, text).otherwise(label)
    stored = docs.filter(F.col(field) != "").select("group", F.col(field).alias("value"), "id", label.alias("label"))
    extra = stored.join(names, ["group", "value"], "left_anti")
    listed = names.select("group", F.lit(None).cast("string").alias("document_id"), "value", F.col("value").alias("label"))
    return listed.unionByName(extra.select("group", F.col("id").alias("document_id"), "value", "label"))


def lookup(c: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Label of a code; the code itself, or ``default``, where there is none."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[c], c if default is None else default)


def missing_required(required: Column, body: Column) -> Column:
    """Required strings absent from a body, both sides with whitespace collapsed and lower-cased."""
    text = F.lower(X.squeeze(body))
    return F.filter(required, lambda s: ~text.contains(F.lower(X.squeeze(s))))


def hrefless_links(html: DataFrame, key: str, column: str) -> DataFrame:
    """Anchors with visible text and neither href, id nor name."""
    opening = r"""<a((?:\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)?)>"""
    whole = F.regexp_extract_all(column, F.lit(f"(?is){opening}.*?</a>"), F.lit(0))
    rows = html.select(key, F.posexplode(whole).alias("nth", "a"))
    tag, text = F.regexp_extract("a", f"(?is)^{opening}", 1), F.trim(F.regexp_replace("a", TAG, ""))
    named = tag.rlike(r"(?i)\s(href|id|name)\s*=")
    return rows.filter((text != "") & ~named).select(key, "nth", text.alias("link_text"))


def legacy_code_map() -> dict[str, str]:
    return {"old-name": "Old Name"}
