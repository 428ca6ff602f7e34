"""Copies, re-imports, carried-over classes, re-keyed anchors and backfills.

New ids are a hash of (purpose, old id), so children are re-keyed in place: no id map, no join, no shuffle, and the same
ids again when a lost executor's work is recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.functions import text as X
from tomeflow.operators import ordered
from tomeflow.operators.audit import stable_uuid
from tomeflow.session import cut


def clone_documents(docs: DataFrame, successor: bool, on: str, purpose: str = "copy") -> DataFrame:
    """Copies of the given documents: an archived predecessor, or an independent draft marked "(copy)"."""
    d = docs.withColumn("source_id", F.col("id")).withColumn("id", stable_uuid(purpose, F.col("id")))
    if successor:
        return d.withColumn("successor", F.col("source_id")).withColumn("archived", F.to_date(F.lit(on)))
    mark = lambda c: F.when(F.col(c) != "", F.concat(c, F.lit(" (copy)"))).otherwise(F.col(c))
    return d.withColumn("title", F.concat("title", F.lit(" (copy)"))).withColumn("short_name", mark("short_name")).withColumn("status", F.lit("draft"))


def clone_children(rows: DataFrame, parent: str, purpose: str = "copy", chosen: DataFrame | None = None) -> DataFrame:
    """Sections or subsections of copied documents under new ids; ``chosen`` limits them to some parents."""
    if chosen is not None:
        rows = rows.join(chosen.select(F.col("id").alias(parent)), parent, "left_semi")
    return rows.withColumn("source_id", F.col("id")).withColumn("id", stable_uuid(purpose, F.col("id"))).withColumn(parent, stable_uuid(purpose, F.col(parent)))


def clone_for_compare(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """One comparison copy per request (``id``, ``source_id``, ``at``); an earlier copy of the same source is superseded.

    The title is the short name, else the title, else the file name.
    """
    title = F.coalesce(F.nullif("short_name", F.lit("")), F.nullif("title", F.lit("")), F.col("filename"))
    d = docs.select(F.col("id").alias("source_id"), F.concat(F.lit("(Compare) "), title).alias("title"), "group", "opdiv", "filename")
    rows = requests.join(d, "source_id").withColumn("__s", F.unix_seconds("at"))
    nxt = ordered.lead(F.struct("id", "at"))
    rows = ordered.scan(rows, ["source_id"], ["__s", "id"], F.floor(F.col("__s") / 86400), nxt=nxt)
    return rows.select("id", "title", "group", "opdiv", "filename", F.lit("draft").alias("status"), F.col("source_id").alias("from_doc"),
                       F.col("nxt.id").alias("successor"), F.to_date("nxt.at").alias("archived"))


def reimport_outcome(incoming: DataFrame, docs: DataFrame) -> DataFrame:
    """accepted / needs_confirmation / blocked for each incoming document (``id``, ``number``)."""
    now = docs.select("id", F.col("number").alias("current"), "status")
    outcome = (
        F.when(F.col("status").isin(V.REIMPORT_BLOCKED_STATUSES), "blocked")
        .when(F.lower("number") != F.lower("current"), "needs_confirmation").otherwise("accepted")
    )
    return incoming.join(now, "id").select("id", outcome.alias("outcome"))


def replace_children(current: DataFrame, incoming: DataFrame, accepted: DataFrame, parent: str = "document_id") -> DataFrame:
    """Children after the re-import: accepted documents get the incoming rows, the others keep theirs."""
    ok = accepted.select(F.col("id").alias(parent))
    return current.join(ok, parent, "left_anti").unionByName(incoming.join(ok, parent, "left_semi"))


def carry_key() -> Column:
    """``section|name``, or the first line of an unnamed body without markup; null when there is neither."""
    first = F.trim(F.get(F.split(F.trim("body"), "\n"), F.lit(0)))
    plain = F.trim(F.regexp_replace(F.regexp_replace(X.strip_md_links(first), r"[\[\]*_#]|<[^>]*>", ""), "^[ >-]+", ""))
    label = F.when(F.col("name") != "", F.col("name")).otherwise(plain)
    return F.when(label != "", F.concat_ws("|", "section_name", label))


def carry_over_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Page-break classes of old rows go to new rows of the same key in the same document; other classes stay."""
    breaks = F.filter(F.split("html_class", " "), lambda c: c.startswith("page-break"))
    o = old.withColumn("key", carry_key()).withColumn("breaks", breaks).filter(F.col("key").isNotNull() & (F.size("breaks") > 0))
    o = o.groupBy("document_id", "key").agg(F.max_by("breaks", F.struct("section_order", "order")).alias("breaks"))
    own = F.filter(F.split("html_class", " "), lambda c: (c != "") & ~c.startswith("page-break"))
    joined = new.withColumn("key", carry_key()).join(o, ["document_id", "key"], "left")
    carried = F.array_join(F.concat(own, F.col("breaks")), " ")
    return joined.withColumn("html_class", F.when(F.col("breaks").isNotNull(), carried).otherwise(F.col("html_class"))).drop("breaks", "key")


def surviving_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys present in both versions."""
    one = lambda d: d.select("document_id", carry_key().alias("key")).filter("key IS NOT NULL")
    return one(old).intersect(one(new))


REF = r'(?i)href="#([^"]+)"|\(#([^)\s]+)\)'


def rewrite_anchor_refs(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace ``href="#old"`` and ``(#old)`` by new ids in one pass.

    ``rows``: document_id, id, body. ``mapping``: document_id, old_id, new_id, rank (the first rank of an old id wins).
    Only the references travel to the mapping; bodies meet the answer once, by row id.
    """
    whole = F.array_distinct(F.regexp_extract_all("body", F.lit(REF), F.lit(0)))
    old = F.lower(F.regexp_replace("ref", r'^(?i:href="#)|^\(#|"$|\)$', ""))
    refs = rows.filter(F.col("body").contains("#")).select("document_id", "id", F.explode(whole).alias("ref")).select("document_id", "id", old.alias("old_id")).distinct()
    both = mapping.unionByName(mapping.filter(F.col("old_id").contains("&")).withColumn("old_id", F.replace("old_id", F.lit("&"), F.lit("&amp;"))))
    m = both.filter("old_id <> ''").groupBy("document_id", F.lower("old_id").alias("old_id")).agg(F.min_by("new_id", "rank").alias("new_id"))
    found = refs.join(m, ["document_id", "old_id"]).groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("old_id", "new_id"))).alias("ids"))
    pieces, said = F.split("body", REF), F.regexp_extract_all("body", F.lit(REF), F.lit(0))

    def one(t: Column) -> Column:
        name = F.lower(F.regexp_replace(t, r'^(?i:href="#)|^\(#|"$|\)$', ""))
        new = F.try_element_at("ids", name)
        return F.when(new.isNull(), t).when(t.startswith("("), F.concat(F.lit("(#"), new, F.lit(")"))).otherwise(F.concat(F.lit('href="#'), new, F.lit('"')))

    # the body is cut at its references and put together again around the new ones
    whole = F.array_join(F.zip_with(pieces, F.concat(F.transform(said, one), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = rows.join(found, "id", "left")
    return out.withColumn("body", F.when(F.col("ids").isNull(), F.col("body")).otherwise(whole)).drop("ids")


def reparent_instances(docs: DataFrame, unpublished: DataFrame, purpose: str = "unpublish") -> DataFrame:
    """Instances of an unpublished template point to its archived copy; the template is a draft again."""
    gone = unpublished.select("id").distinct()
    parents = gone.select(F.col("id").alias("parent"), stable_uuid(purpose, F.col("id")).alias("__copy"))
    self_ = gone.withColumn("__draft", F.lit(True))
    rows = docs.join(parents, "parent", "left").join(self_, "id", "left")
    return rows.withColumn("parent", F.coalesce("__copy", "parent")).withColumn("status", F.when(F.col("__draft"), "draft").otherwise(F.col("status"))).drop("__copy", "__draft")


def bulk_flag_update(requests: DataFrame, subsections: DataFrame, id_pattern: str) -> DataFrame:
    """Outcome of a batch of (``batch``, ``id``, ``checked``) selections on the comparison type."""
    s = subsections.select("id", "comparison_type")
    rows = requests.join(s, "id", "left")
    failed = ~F.col("id").rlike(id_pattern) | F.col("comparison_type").isNull()
    to = F.when(F.col("checked"), "body").otherwise("none")
    return rows.withColumn("failed", failed).withColumn("changed", ~failed & (F.col("comparison_type") != to)).withColumn("new_type", F.when(~failed, to))


def bulk_flag_summary(outcome: DataFrame) -> DataFrame:
    g = outcome.groupBy("batch").agg(
        F.count("*").alias("selections"), F.count_if("changed").alias("updated"), F.count_if("failed").alias("failed")
    )
    return g.withColumn("status", F.when(F.col("failed") == F.col("selections"), "fail").when(F.col("failed") > 0, "partial").otherwise("success"))


def version_lines(docs: DataFrame) -> DataFrame:
    """(id, last, steps, cycle): where following ``successor`` from each document ends and after how many steps; ``cycle`` where it
    never does (``last`` and ``steps`` are null then). A successor that is not there ends the line before it.

    Pointers double every round, so a line of n versions takes about log2(n) rounds; pointers still running after as many rounds
    as the number of rows can need are on a cycle or lead into one."""
    known = docs.select(F.col("id").alias("next"))
    edges = docs.select("id", F.col("successor").alias("next")).join(known.distinct().hint("merge"), "next", "left_semi")
    rows = cut(docs.select("id").distinct().join(edges.hint("merge"), "id", "left").select("id", F.coalesce("next", "id").alias("at"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNotNull().alias("runs")))
    for _ in range(max(1, rows.count()).bit_length() + 1):
        on = rows.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.col("runs").alias("on"))
        if rows.filter("runs").isEmpty():
            break
        met = rows.join(on.hint("merge"), "at", "left")
        rows = cut(met.select("id", F.when(F.col("runs"), F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.when(F.col("runs"), F.col("more")).otherwise(0)).alias("steps"), (F.col("runs") & F.col("on")).alias("runs")))
    return rows.select("id", F.when(~F.col("runs"), F.col("at")).alias("last"), F.when(~F.col("runs"), F.col("steps")).alias("steps"), F.col("runs").alias("cycle"))


def version_chain(docs: DataFrame) -> DataFrame:
    """(id, ancestor, steps, position): every earlier version of every document, at any distance, oldest first. Documents on a
    cycle or leading into one have no rows here; ``version_lines`` reports them.

    The pairs double in reach every round: those of up to 2^k steps, each carried 2^k steps on. Every table here grows with the
    documents, so joins shuffle; a broadcast each round would send them all through the driver."""
    lines = version_lines(docs)
    sound = docs.join(lines.filter("NOT cycle").select("id").hint("merge"), "id", "left_semi")
    there = sound.select(F.col("id").alias("successor")).distinct()
    edges = sound.select("id", "successor").distinct().join(there.hint("merge"), "successor", "left_semi")
    reach = cut(edges.select(F.col("successor").alias("id"), F.col("id").alias("ancestor"), F.lit(1).cast("long").alias("steps")))
    jump, k = cut(edges.select("id", F.col("successor").alias("to"))), 1
    while not jump.isEmpty():
        onward = jump.select("id", F.col("to").alias("far"))
        more = reach.filter(F.col("steps") <= k).join(onward.hint("merge"), "id").select(F.col("far").alias("id"), "ancestor", (F.col("steps") + k).alias("steps"))
        reach = cut(reach.unionByName(more))
        jump = cut(jump.join(onward.select(F.col("id").alias("to"), "far").hint("merge"), "to").select("id", F.col("far").alias("to")))
        k *= 2
    at = docs.select(F.col("id").alias("ancestor"), "created").distinct()
    return ordered.row_numbers(reach.join(at.hint("merge"), "ancestor"), ["id"], ["created", "ancestor"]).drop("created")


def latest_clone(docs: DataFrame) -> DataFrame:
    rows = docs.filter(F.col("from_doc").isNotNull())
    return rows.groupBy("from_doc").agg(F.max(F.struct("created", "id")).alias("m")).select("from_doc", F.col("m.id").alias("latest"))


GROUP_CODES = ["acf", "acl", "aspr", "cdc", "cms", "hrsa", "ihs"]


def backfill_documents(docs: DataFrame, retired: list[str], renames: dict[str, str]) -> DataFrame:
    """Group from the first code contained in the number; retired people cleared; old codes renamed."""
    group = F.col("group")
    for code in reversed(GROUP_CODES):
        group = F.when(F.lower("number").contains(code), code).otherwise(group)
    coach = F.when(F.col("coach").isin(retired), "").otherwise(F.col("coach"))
    for old, new in renames.items():
        coach = F.when(F.col("coach") == old, new).otherwise(coach)
    return docs.withColumn("group", group).withColumn("coach", coach)


def backfill_sections(sections: DataFrame) -> DataFrame:
    name = F.when(F.col("name") == "", F.concat(F.lit("Untitled Section "), F.coalesce(F.col("order").cast("string"), F.lit("Unknown")))).otherwise(F.col("name"))
    rows = sections.withColumn("name", name)
    made = F.concat(F.coalesce("order", F.lit(0)).cast("string"), F.lit("--"), X.slug(F.col("name")))
    return rows.withColumn("html_id", F.when(F.col("html_id") == "", made).otherwise(F.col("html_id")))


def flag_to_class(flag: Column, html_class: Column) -> Column:
    return F.when(flag, F.concat(html_class, F.lit("page-break-before"))).otherwise(html_class)


def random_ids(df: DataFrame, column: str = "uuid") -> DataFrame:
    """Random ids; write the result before using it twice, because a recompute draws new ones."""
    return df.withColumn(column, F.expr("uuid()"))
