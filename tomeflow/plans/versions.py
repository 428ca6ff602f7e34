"""Queries that copy, re-key, re-import and backfill documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeflow.operators import compare as C
from tomeflow.operators import ordered, trees
from tomeflow.operators import versions as Z
from tomeflow.plans import segment as PS
from tomeflow.plans.compare import KEPT2, NAME2, _sp
from tomeflow.plans.registry import query
from tomeflow.plans.trees import _slug
from tomeflow.session import cut

DOC, TREE = ("r_documents",), ("r_tree",)


def _uuid(purpose: str, c: str) -> str:
    return f"regexp_replace(md5(concat('{purpose}:', {c})), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"


@query("clone_documents", f"""SELECT 'document' AS kind, {_uuid('copy', 'id')} AS id, NULL::varchar AS parent, title || ' (copy)' AS name FROM r_documents
  UNION ALL SELECT 'section', {_uuid('copy', 'id')}, {_uuid('copy', 'document_id')}, name FROM r_sections
  UNION ALL SELECT 'subsection', {_uuid('copy', 'id')}, {_uuid('copy', 'section_id')}, name FROM r_subsections
  UNION ALL SELECT 'archive', {_uuid('archive', 'id')}, id, title FROM r_documents""", ("r_documents", "r_sections", "r_subsections"))
def _(r):
    d = Z.clone_documents(r.documents, False, "2024-06-01").select(F.lit("document").alias("kind"), "id", F.lit(None).cast("string").alias("parent"), F.col("title").alias("name"))
    s = Z.clone_children(r.sections, "document_id").select(F.lit("section").alias("kind"), "id", F.col("document_id").alias("parent"), "name")
    x = Z.clone_children(r.subsections, "section_id").select(F.lit("subsection").alias("kind"), "id", F.col("section_id").alias("parent"), "name")
    a = Z.clone_documents(r.documents, True, "2024-06-01", "archive").select(F.lit("archive").alias("kind"), "id", F.col("successor").alias("parent"), F.col("title").alias("name"))
    return d.unionByName(s).unionByName(x).unionByName(a)


@query("clone_for_compare", """WITH q AS (SELECT cast(e.id AS string) AS id, e.datetime AS ts0, d.id AS from_doc, '(Compare) ' || CASE WHEN short_name <> '' THEN short_name WHEN title <> '' THEN title ELSE filename END AS title
    FROM r_events e JOIN r_documents d ON d.id = e.object_id WHERE e.model = 'document')
  SELECT id, from_doc, title, lead(id) OVER w AS successor, cast(lead(ts0) OVER w AS date) AS archived FROM q WINDOW w AS (PARTITION BY from_doc ORDER BY epoch_us(ts0) // 1000000, id)""", ("r_events", "r_documents"))
def _(r):
    asked = r.events.filter("model = 'document'").select(F.col("id").cast("string").alias("id"), F.col("object_id").alias("source_id"), F.col("datetime").alias("at"))
    return Z.clone_for_compare(asked, r.documents).select("id", "from_doc", "title", "successor", "archived")


_INNUM = "CASE WHEN cast(id AS bigint) % 7 = 0 THEN concat(number, 'x') ELSE upper(number) END"


@query("replace_documents", f"""WITH o AS (SELECT id, CASE WHEN status IN ('published', 'review', 'doge', 'paused') THEN 'blocked' WHEN lower({_INNUM}) <> lower(number) THEN 'needs_confirmation' ELSE 'accepted' END AS outcome FROM r_documents)
  SELECT o.id AS document_id, o.outcome, CASE WHEN o.outcome = 'accepted' THEN {_uuid('reimport', 's.id')} ELSE s.id END AS section_id, s.name FROM o JOIN r_sections s ON s.document_id = o.id""", ("r_documents", "r_sections"))
def _(r):
    incoming = r.documents.select("id", F.expr(_INNUM).alias("number"))
    outcome = Z.reimport_outcome(incoming, r.documents)
    now = r.sections.select("document_id", F.col("id").alias("section_id"), "name")
    new = now.withColumn("section_id", Z.stable_uuid("reimport", F.col("section_id")))
    rows = Z.replace_children(now, new, outcome.filter("outcome = 'accepted'"))
    return rows.join(outcome.withColumnRenamed("id", "document_id"), "document_id")


_CKEY = r"""CASE WHEN name <> '' THEN section_name || '|' || name WHEN pl <> '' THEN section_name || '|' || pl END"""
_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(string_split(trim(body), chr(10))[1]), '\]\([^)]*\)', ']', 'g'), '[\[\]*_#]|<[^>]*>', '', 'g'), '^[ >-]+', ''))"""
_KEYED = f"""k AS (SELECT *, {_CKEY} AS key FROM (SELECT *, {_PLAIN} AS pl FROM r_tree) q),
  nk AS (SELECT *, {_CKEY} AS key FROM (SELECT document_id, section_name, section_order, "order", id, {NAME2} AS name, body, CASE WHEN "order" % 2 = 0 THEN 'custom' ELSE 'page-break wide' END AS html_class, {_PLAIN} AS pl FROM r_tree WHERE {KEPT2}) q)"""


def _new_tree(r):
    cls = F.when(F.col("order") % 2 == 0, "custom").otherwise("page-break wide")
    return r.tree.filter(_sp(KEPT2)).select("document_id", "section_name", "section_order", "order", "id", F.expr(_sp(NAME2)).alias("name"), "body", cls.alias("html_class"))


@query("carry_over_classes", f"""WITH {_KEYED}, b AS (SELECT *, array_to_string([c for c in string_split(html_class, ' ') if starts_with(c, 'page-break')], ' ') AS br FROM k WHERE key IS NOT NULL),
  o AS (SELECT document_id, key, max_by(br, (section_order, "order")) AS br FROM b WHERE br <> '' GROUP BY document_id, key)
  SELECT n.id, CASE WHEN o.br IS NULL THEN n.html_class ELSE trim(array_to_string([c for c in string_split(n.html_class, ' ') if NOT starts_with(c, 'page-break')], ' ') || ' ' || o.br) END AS html_class
  FROM nk n LEFT JOIN o ON o.document_id = n.document_id AND o.key = n.key""", TREE)
def _(r):
    return Z.carry_over_classes(r.tree, _new_tree(r)).select("id", "html_class")


@query("surviving_keys", f"WITH {_KEYED} SELECT document_id, key FROM k WHERE key IS NOT NULL INTERSECT SELECT document_id, key FROM nk WHERE key IS NOT NULL", TREE)
def _(r):
    return Z.surviving_keys(r.tree, _new_tree(r))


@query("rewrite_anchor_refs", rf"""WITH num AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_order, "order") AS number FROM r_tree),
  m AS (SELECT document_id, html_id AS old_id, concat_ws('--', cast(number AS string), {_slug('section_name')}, {_slug('name')}) AS new_id, (section_order, "order") AS rk FROM num WHERE html_id <> ''
    UNION ALL SELECT document_id, html_id, {_slug('name')}, ("order", 0) FROM r_sections WHERE html_id <> ''),
  f AS (SELECT document_id, old_id, min_by(new_id, rk) AS new_id FROM m GROUP BY document_id, old_id),
  x AS (SELECT *, regexp_extract(body, '\(#([^)\s]+)\)', 1) AS ref FROM r_tree)
  SELECT x.id, CASE WHEN f.new_id IS NULL THEN x.body ELSE replace(x.body, '(#' || x.ref || ')', '(#' || f.new_id || ')') END AS body FROM x LEFT JOIN f ON f.document_id = x.document_id AND f.old_id = x.ref AND x.ref <> ''""", TREE)
def _(r):
    t = trees.heading_ids(r.tree.select("document_id", "section_id", "section_order", "section_name", "id", "order", "name", "html_id"))
    below = t.filter("html_id <> ''").select("document_id", F.col("html_id").alias("old_id"), F.col("new_html_id").alias("new_id"), F.struct(F.col("section_order").alias("a"), F.col("order").alias("b")).alias("rank"))
    top = r.sections.filter("html_id <> ''").select("document_id", F.col("html_id").alias("old_id"), trees.X.slug(F.col("name")).alias("new_id"), F.struct(F.col("order").alias("a"), F.lit(0).alias("b")).alias("rank"))
    return Z.rewrite_anchor_refs(r.tree.select("document_id", "id", "body"), below.unionByName(top)).select("id", "body")


@query("reparent_instances", f"""SELECT d.id, CASE WHEN p.id IS NOT NULL THEN {_uuid('unpublish', 'd.parent')} ELSE d.parent END AS parent, CASE WHEN d.status = 'published' THEN 'draft' ELSE d.status END AS status
  FROM r_documents d LEFT JOIN r_documents p ON p.id = d.parent AND p.status = 'published'""", DOC)
def _(r):
    return Z.reparent_instances(r.documents, r.documents.filter("status = 'published'")).select("id", "parent", "status")


_BATCH = "SELECT user_id AS batch, CASE WHEN id % 10 = 3 THEN concat('bad ', object_id) ELSE object_id END AS id, id % 3 = 0 AS checked FROM {0} WHERE model = 'subsection'"


@query("bulk_flag_update", f"""WITH q AS ({_BATCH.format('r_events')}), o AS (SELECT q.*, s.id IS NULL AS failed, s.id IS NOT NULL AND s.comparison_type <> CASE WHEN q.checked THEN 'body' ELSE 'none' END AS changed FROM q LEFT JOIN r_subsections s ON s.id = q.id),
  g AS (SELECT batch, count(*) AS selections, count(*) FILTER (changed) AS updated, count(*) FILTER (failed) AS failed FROM o GROUP BY batch)
  SELECT *, CASE WHEN failed = selections THEN 'fail' WHEN failed > 0 THEN 'partial' ELSE 'success' END AS status FROM g""", ("r_events", "r_subsections"))
def _(r):
    asked = r.spark.sql(_BATCH.format("{ev}"), ev=r.events)
    return Z.bulk_flag_summary(Z.bulk_flag_update(asked, r.subsections, r"^\d+-\d+$"))


# lines of up to 40 versions, and a few cycles of four
_LINE = "CASE WHEN k % 211 = 0 THEN cast(k - 3 AS string) WHEN k % 40 <> 0 THEN cast(k + 1 AS string) END"


@query("version_chain", f"""WITH RECURSIVE d AS (SELECT id, created, {_LINE} AS successor FROM (SELECT *, cast(id AS bigint) AS k FROM r_documents) q),
  reach(id, ancestor, steps) AS (SELECT d.successor, d.id, cast(1 AS bigint) FROM d JOIN d s ON s.id = d.successor UNION SELECT d.successor, r.ancestor, r.steps + 1 FROM reach r JOIN d ON d.id = r.id JOIN d s ON s.id = d.successor WHERE r.steps < 200),
  bad AS (SELECT DISTINCT ancestor AS id FROM reach WHERE steps = 200),
  ok AS (SELECT r.*, row_number() OVER (PARTITION BY r.id ORDER BY d.created, r.ancestor) AS position FROM reach r JOIN d ON d.id = r.ancestor WHERE r.ancestor NOT IN (SELECT id FROM bad) AND r.id NOT IN (SELECT id FROM bad))
  SELECT o.*, false AS cycle, l.latest FROM ok o LEFT JOIN (SELECT from_doc, max_by(id, (created, id)) AS latest FROM r_documents WHERE from_doc IS NOT NULL GROUP BY from_doc) l ON l.from_doc = o.id
  UNION ALL SELECT id, NULL, NULL, NULL, true, NULL FROM bad""", DOC)
def _(r):
    docs = r.documents.withColumn("successor", F.expr(_LINE.replace("k ", "cast(id AS bigint) ")))
    chain = Z.version_chain(docs).withColumn("cycle", F.lit(False)).join(Z.latest_clone(docs).withColumnRenamed("from_doc", "id"), "id", "left")
    return chain.unionByName(Z.version_lines(docs).filter("cycle").select("id", "cycle"), allowMissingColumns=True)


_CODES = "CASE " + " ".join(f"WHEN contains(lower(number), '{c}') THEN '{c}'" for c in Z.GROUP_CODES) + ' ELSE "group" END'


@query("backfill_columns", f"""SELECT 'document' AS kind, id, {_CODES} AS a, CASE coach WHEN 'first-coach' THEN '' WHEN 'old-name' THEN 'new-name' ELSE coach END AS b FROM r_documents
  UNION ALL SELECT 'section', id, nm, CASE WHEN html_id = '' THEN cast("order" AS string) || '--' || {_slug('nm')} ELSE html_id END FROM (SELECT *, CASE WHEN name = '' THEN 'Untitled Section ' || cast("order" AS string) ELSE name END AS nm FROM r_sections) q
  UNION ALL SELECT 'subsection', id, CASE WHEN hidden THEN html_class || 'page-break-before' ELSE html_class END, CASE WHEN optional THEN 'sole_source' ELSE 'full' END FROM r_subsections""", ("r_documents", "r_sections", "r_subsections"))
def _(r):
    d = Z.backfill_documents(r.documents, ["first-coach"], {"old-name": "new-name"}).select(F.lit("document").alias("kind"), "id", F.col("group").alias("a"), F.col("coach").alias("b"))
    s = Z.backfill_sections(r.sections).select(F.lit("section").alias("kind"), "id", F.col("name").alias("a"), F.col("html_id").alias("b"))
    x = r.subsections.select(F.lit("subsection").alias("kind"), "id", Z.flag_to_class(F.col("hidden"), F.col("html_class")).alias("a"), F.when(F.col("optional"), "sole_source").otherwise("full").alias("b"))
    return d.unionByName(s).unionByName(x)


@query("assign_uuids", f"""SELECT 'document' AS kind, id, {_uuid('document', 'id')} AS uuid FROM r_documents UNION ALL SELECT 'section', id, {_uuid('section', 'id')} FROM r_sections
  UNION ALL SELECT 'subsection', id, {_uuid('subsection', 'id')} FROM r_subsections""", ("r_documents", "r_sections", "r_subsections"))
def _(r):
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", Z.stable_uuid(kind, F.col("id")).alias("uuid"))
    return one(r.documents, "document").unionByName(one(r.sections, "section")).unionByName(one(r.subsections, "subsection"))


_EDITED = "CASE WHEN unit % 5 = 1 THEN text || ' edited' WHEN unit % 11 = 2 THEN '' ELSE text END"
# the longest run from its definition: for every match the longest run that ends there, then back from the last of the longest
DIFF = f"""{PS.UNIT}, o0 AS (SELECT doc_id, unit AS pos, tag, text FROM u), n0 AS (SELECT doc_id, unit + CASE WHEN unit % 9 = 4 THEN 3 ELSE 0 END AS p0, tag, {_EDITED} AS text, unit FROM u WHERE unit % 7 <> 3),
  o AS (SELECT doc_id, tag, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS row, row_number() OVER (PARTITION BY doc_id, tag, text ORDER BY pos) AS nth FROM o0),
  n AS (SELECT doc_id, tag, text, row_number() OVER (PARTITION BY doc_id ORDER BY p0, unit) AS row, row_number() OVER (PARTITION BY doc_id, tag, text ORDER BY p0, unit) AS nth FROM n0),
  m AS (SELECT doc_id, list(o.row ORDER BY n.row) AS os, list(n.row ORDER BY n.row) AS ns FROM n JOIN o USING (doc_id, tag, text, nth) GROUP BY doc_id),
  lis(doc_id, os, ns, i, ls) AS (SELECT doc_id, os, ns, cast(0 AS bigint), cast([] AS bigint[]) FROM m
    UNION ALL SELECT doc_id, os, ns, i + 1, list_append(ls, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN os[j] < os[i + 1] THEN ls[j] ELSE 0 END)), 0)) FROM lis WHERE i < len(os)),
  back(doc_id, os, ns, ls, i) AS (SELECT doc_id, os, ns, ls, list_max(list_filter(range(1, len(ls) + 1), lambda j: ls[j] = list_max(ls))) FROM lis WHERE i = len(os) AND i > 0
    UNION ALL SELECT doc_id, os, ns, ls, list_max(list_filter(range(1, i), lambda j: ls[j] = ls[i] - 1)) FROM back WHERE ls[i] > 1),
  kept AS (SELECT doc_id, os[i] AS old_row, ns[i] AS new_row FROM back),
  a AS (SELECT o.*, k.old_row IS NOT NULL AS same, count(k.old_row) OVER w AS gap, row - coalesce(max(k.old_row) OVER w, 0) AS place FROM o LEFT JOIN kept k ON k.doc_id = o.doc_id AND k.old_row = o.row WINDOW w AS (PARTITION BY o.doc_id ORDER BY row)),
  b AS (SELECT n.*, k.new_row IS NOT NULL AS same, count(k.new_row) OVER w AS gap, row - coalesce(max(k.new_row) OVER w, 0) AS place FROM n LEFT JOIN kept k ON k.doc_id = n.doc_id AND k.new_row = n.row WINDOW w AS (PARTITION BY n.doc_id ORDER BY row)),
  diff AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.gap, b.gap) AS gap, cast(coalesce(a.place, b.place) AS int) AS place, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' WHEN a.same THEN 'equal' ELSE 'replace' END AS op,
    a.tag AS old_tag, a.text AS old_text, b.tag AS new_tag, b.text AS new_text FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.gap = b.gap AND a.place = b.place)"""


def _diff(r):
    blocks = cut(PS.units(r).select("doc_id", "unit", "tag", "text"))
    old = blocks.select("doc_id", F.col("unit").alias("pos"), "tag", "text")
    new = blocks.filter("unit % 7 <> 3").selectExpr("doc_id", "unit + CASE WHEN unit % 9 = 4 THEN 3 ELSE 0 END AS p0", "tag", f"{_EDITED} AS text", "unit")
    new = ordered.scan(new, ["doc_id"], ["p0", "unit"], ordered.chunk_of("p0"), pos=ordered.row_number())
    return C.block_diff(old, new.select("doc_id", "pos", "tag", "text"))


@query("block_diff", f"WITH RECURSIVE {DIFF} SELECT * FROM diff", ("r_raw_html",))
def _(r):
    return _diff(r)


@query("diff_sides", f"WITH RECURSIVE {DIFF} SELECT doc_id, 'old' AS side, string_agg(old_text, chr(10) ORDER BY gap, place) AS view FROM diff WHERE old_text IS NOT NULL GROUP BY doc_id UNION ALL SELECT doc_id, 'new', string_agg(new_text, chr(10) ORDER BY gap, place) FROM diff WHERE new_text IS NOT NULL GROUP BY doc_id", ("r_raw_html",))
def _(r):
    return C.diff_sides(_diff(r))
