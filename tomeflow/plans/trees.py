"""Queries over the document tree: filters, heading checks, order and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.operators import filters as O
from tomeflow.operators import trees as T
from tomeflow.plans.registry import query
from tomeflow.plans.role_text import STAFF_GROUP

DOC_COLS = ["id", "title", "number", "group", "status"]
_DOC = 'id, title, number, "group", status'


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("list_documents", f"""SELECT {_DOC} FROM r_documents WHERE archived IS NULL
  AND status NOT IN ({_in(V.CLOSED_STATUSES)}) AND "group" = '{STAFF_GROUP}' ORDER BY updated DESC, id""", ("r_documents",))
def _(r):
    return O.list_documents(r.documents, user_group=STAFF_GROUP, staff_group=STAFF_GROUP).select(*DOC_COLS)


@query("search_documents", f"""SELECT {_DOC} FROM r_documents WHERE archived IS NULL AND
  (contains(lower(short_name), 'rural care program r') OR contains(lower(title), 'rural care program r')
   OR contains(lower(opdiv), 'rural care program r') OR contains(lower(number), 'rural care program r'))""", ("r_documents",))
def _(r):
    return O.search_documents(r.documents, " Rural Care program R").select(*DOC_COLS)


@query("current_versions", f"SELECT {_DOC} FROM r_documents WHERE archived IS NULL AND successor IS NULL AND \"group\" = 'machinery'", ("r_documents",))
def _(r):
    return O.current_versions(r.documents, user_group="machinery", staff_group=STAFF_GROUP).select(*DOC_COLS)


@query("access_matrix", f"""SELECT e.user_id, e.object_id AS document_id,
  CASE WHEN d.archived IS NOT NULL THEN u."group" = '{STAFF_GROUP}' ELSE u."group" = '{STAFF_GROUP}' OR u."group" = d."group" END AS allowed
  FROM (SELECT DISTINCT user_id, object_id FROM r_events WHERE model = 'document') e
  JOIN r_users u ON u.id = e.user_id JOIN r_documents d ON d.id = e.object_id""", ("r_events", "r_users", "r_documents"))
def _(r):
    asked = r.events.filter("model = 'document'").select("user_id", F.col("object_id").alias("document_id")).distinct()
    return O.check_access(asked, r.users, r.documents, STAFF_GROUP).select("user_id", "document_id", "allowed")


@query("manageable_users", """SELECT p.manager, p.target, CASE WHEN m.is_superuser THEN true
    ELSE m.is_opdiv_admin AND p.manager <> p.target AND NOT t.is_superuser AND m."group" = t."group" END AS allowed
  FROM (SELECT DISTINCT cast(l_suppkey AS string) AS manager, cast(l_suppkey + l_linenumber - 1 AS string) AS target FROM lineitem) p
  JOIN r_users m ON m.id = p.manager JOIN r_users t ON t.id = p.target""", ("r_users",))
def _(r):
    pairs = r.table("lineitem").selectExpr(
        "cast(l_suppkey AS string) AS manager", "cast(l_suppkey + l_linenumber - 1 AS string) AS target"
    ).distinct()
    return O.check_manageable(pairs, r.users)


@query("normalize_users", f"""SELECT id, lower(email) AS email, "group", nullif(external_id, '') AS external_id, is_superuser,
  is_superuser AS is_staff, is_opdiv_admin AND NOT is_superuser AS is_opdiv_admin,
  CASE WHEN is_superuser AND "group" <> '{STAFF_GROUP}' THEN 'superuser outside staff group' END AS problem FROM r_users""", ("r_users",))
def _(r):
    return O.normalize_users(r.users, STAFF_GROUP)


_ACTIONS = ", ".join(f"('{s}', {i}, '{a}')" for s, acts in V.STATUS_ACTIONS.items() for i, a in enumerate(acts))


@query("allowed_actions", f"""SELECT d.id, d.status, v.position, v.action FROM r_documents d
  JOIN (VALUES {_ACTIONS}) v(status, position, action) ON v.status = d.status""", ("r_documents",))
def _(r):
    return O.allowed_actions(r.documents)


# a section belongs to a template or to an instance; some to both or to neither
_TEMPLATE = "CASE WHEN cast(id AS bigint) % 3 <> 0 OR cast(id AS bigint) % 29 = 3 THEN document_id END"
_INSTANCE = "CASE WHEN cast(id AS bigint) % 3 = 0 AND cast(id AS bigint) % 31 <> 5 OR cast(id AS bigint) % 37 = 2 THEN document_id END"
_V_SQL = r"""
SELECT 'documents' AS "table", id, 'title or number required' AS rule FROM r_documents WHERE trim(title) = '' AND trim(number) = ''
UNION ALL SELECT 'documents', id, 'title too long' FROM r_documents WHERE length(title) > 250
UNION ALL SELECT 'documents', id, 'theme not permitted for group' FROM r_documents WHERE "group" = 'furniture' AND theme <> 'portrait-acf-white'
UNION ALL SELECT 'sections', id, 'blank name' FROM r_sections WHERE name = ''
UNION ALL SELECT 'sections', id, 'blank id' FROM r_sections WHERE html_id = ''
UNION ALL SELECT 'sections', id, 'exactly one parent' FROM (SELECT id, {_TEMPLATE} AS a, {_INSTANCE} AS b FROM r_sections) q WHERE (a IS NULL) = (b IS NULL)
UNION ALL SELECT 'subsections', id, 'name without heading level' FROM r_subsections WHERE name <> '' AND tag = ''
UNION ALL SELECT 'subsections', id, 'heading level without name' FROM r_subsections WHERE name = '' AND tag <> ''
UNION ALL SELECT 'subsections', id, 'neither name nor content' FROM r_subsections WHERE name = '' AND tag = '' AND body = ''
UNION ALL SELECT 'subsections', id, 'no variable in content' FROM r_subsections WHERE edit_mode = 'variables' AND NOT regexp_matches(body, '\{[^{}]+\}')
"""


@query("validate_rows", _V_SQL.replace("{_TEMPLATE}", _TEMPLATE).replace("{_INSTANCE}", _INSTANCE), ("r_documents", "r_sections", "r_subsections"))
def _(r):
    docs = O.validate_documents(r.documents, {"furniture": {"theme": ["portrait-acf-white"]}})
    owned = r.sections.withColumn("template_id", F.expr(_TEMPLATE)).withColumn("instance_id", F.expr(_INSTANCE))
    return docs.unionByName(O.validate_sections(owned, ("template_id", "instance_id"))).unionByName(O.validate_subsections(r.subsections))


_FLAG = " AND ".join(f"NOT contains(lower(name), '{w}')" for w in V.NO_SECTION_PAGE_WORDS)


@query("section_page_flag", f"SELECT id, name, ({_FLAG}) AS section_page FROM r_sections", ("r_sections",))
def _(r):
    return r.sections.select("id", "name", O.section_page_flag(F.col("name")).alias("section_page"))


_CRUMB = "CASE " + " ".join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in V.BREADCRUMBS.items()) + f" ELSE '{V.BREADCRUMB_DEFAULT}' END"


@query("breadcrumbs", f"SELECT id, name, {_CRUMB} AS breadcrumb FROM r_sections WHERE regexp_matches(lower(name), '^(step|contacts|learn)')", ("r_sections",))
def _(r):
    return O.breadcrumbs(r.sections).select("id", "name", "breadcrumb")


@query("side_nav", """SELECT DISTINCT document_id, 0 AS "order", 'summary-box-key-information' AS html_id, 'Summary' AS name FROM r_sections
  UNION ALL SELECT document_id, "order", html_id, name FROM r_sections""", ("r_sections",))
def _(r):
    return O.side_nav(r.sections)


_OPENS = " OR ".join(f"starts_with(trim(body), '{t}')" for t in V.FLOATING_CALLOUTS)


@query("floating_callouts", f"""SELECT id, name FROM r_subsections WHERE callout_box AND
  CASE WHEN name <> '' THEN trim(name) IN ({_in(V.FLOATING_CALLOUTS)}) ELSE {_OPENS} END""", ("r_subsections",))
def _(r):
    return O.floating_callouts(r.subsections).select("id", "name")


@query("missing_metadata", r"""SELECT id, field FROM (
  SELECT id, 'author' AS field, author AS v FROM r_documents UNION ALL SELECT id, 'subject', subject FROM r_documents
  UNION ALL SELECT id, 'keywords', keywords FROM r_documents) q WHERE trim(v) = '' OR regexp_matches(trim(v), '^\{[^{}]+\}$')""", ("r_documents",))
def _(r):
    return O.missing_metadata(r.documents)


@query("not_started", "SELECT id, name FROM r_subsections WHERE edit_mode <> 'locked' AND status = 'default'", ("r_subsections",))
def _(r):
    return O.not_started(r.subsections).select("id", "name")


@query("visible_subsections", 'SELECT id, name, "order" FROM r_subsections WHERE NOT hidden', ("r_subsections",))
def _(r):
    return O.visible_subsections(r.subsections).select("id", "name", "order")


@query("archive_documents", """SELECT q.id, CASE WHEN d.archived IS NULL AND d.status = 'draft' THEN DATE '2024-06-01' ELSE d.archived END AS archived,
  CASE WHEN d.id IS NULL THEN 'not found' WHEN d.archived IS NULL AND d.status = 'draft' THEN 'archived'
       WHEN d.archived IS NOT NULL THEN 'already archived' ELSE 'not a draft' END AS outcome
  FROM (SELECT DISTINCT object_id AS id FROM r_events WHERE event_type = 3 AND model = 'document') q
  LEFT JOIN r_documents d ON d.id = q.id""", ("r_documents", "r_events"))
def _(r):
    asked = r.events.filter("event_type = 3 AND model = 'document'").select(F.col("object_id").alias("id"))
    return O.archive_documents(r.documents, asked, "2024-06-01")


@query("doc_title_size", """SELECT id, CASE WHEN length(title) > 225 THEN 'very-very-small' WHEN length(title) > 165 THEN 'very-small'
  WHEN length(title) > 110 THEN 'smaller' ELSE 'normal' END AS title_size FROM r_documents""", ("r_documents",))
def _(r):
    return r.documents.select("id", O.doc_title_size(F.col("title")).alias("title_size"))


@query("tree_join", """SELECT t.document_id, d.title, t.section_id, t.section_order, t.section_name, t.id, t."order", t.name
  FROM r_tree t JOIN r_documents d ON d.id = t.document_id""", ("r_tree", "r_documents"))
def _(r):
    rows = T.tree_join(r.documents, r.sections, r.subsections)
    return rows.select("document_id", "title", "section_id", "section_order", "section_name", "id", "order", "name")


_NB = "OVER (PARTITION BY section_id ORDER BY \"order\")"


@query("neighbours", f"""SELECT 'subsection' AS kind, id, lag(id) {_NB} AS previous_id, lead(id) {_NB} AS next_id FROM r_subsections
  UNION ALL SELECT 'section', id, lag(id) OVER (PARTITION BY document_id ORDER BY "order"), lead(id) OVER (PARTITION BY document_id ORDER BY "order") FROM r_sections""", ("r_subsections", "r_sections"))
def _(r):
    rows = T.neighbours(r.subsections.select("id", "section_id", "order")).select(F.lit("subsection").alias("kind"), "id", "previous_id", "next_id")
    tops = T.neighbours(r.sections.select("id", "document_id", "order"), "document_id").select(F.lit("section").alias("kind"), "id", "previous_id", "next_id")
    return rows.unionByName(tops)


@query("next_tagged", """SELECT s.id,
  (SELECT min_by(n.id, n."order") FROM r_subsections n WHERE n.section_id = s.section_id AND n."order" > s."order" AND n.tag <> '') AS next_tagged_id,
  (SELECT max_by(n.id, n."order") FROM r_subsections n WHERE n.section_id = s.section_id AND n."order" < s."order" AND n.tag <> '') AS previous_tagged_id
  FROM r_subsections s""", ("r_subsections",))
def _(r):
    return T.next_tagged(r.subsections.select("id", "section_id", "order", "tag")).select("id", "next_tagged_id", "previous_tagged_id")


_REPEATED = """SELECT n.section_id, n.id, n.name,
  CASE WHEN s.tag = n.tag THEN concat('Repeated heading level: two ', n.tag, ' headings in a row.')
       ELSE concat('Incorrectly nested heading level: ', s.tag, ' immediately followed by a larger ', n.tag, '.') END AS error
  FROM r_subsections s JOIN r_subsections n ON n.section_id = s.section_id AND n."order" = s."order" + 1
  WHERE trim(s.body) = '' AND s.name <> '' AND n.name <> '' AND s.tag >= n.tag"""
_SKIPPED = """SELECT s.section_id, s.id, s.name, concat('Incorrectly nested heading level: h2 (', h.name, ') followed by an ', s.tag, '.') AS error
  FROM r_subsections s JOIN r_sections h ON h.id = s.section_id WHERE s."order" = 1 AND s.tag >= 'h4'
  UNION ALL
  SELECT s.section_id, n.id, n.name, concat('Incorrectly nested heading level: ', s.tag, ' followed by an ', n.tag, '.')
  FROM r_subsections s JOIN r_subsections n ON n.section_id = s.section_id AND n."order" > s."order" AND n.tag <> ''
   AND NOT EXISTS (SELECT 1 FROM r_subsections m WHERE m.section_id = s.section_id AND m."order" > s."order" AND m."order" < n."order" AND m.tag <> '')
  WHERE s.name <> '' AND n.name <> '' AND cast(substr(n.tag, 2, 1) AS int) - cast(substr(s.tag, 2, 1) AS int) > 1"""


@query("repeated_headings", _REPEATED, ("r_subsections",))
def _(r):
    return T.repeated_headings(r.subsections)


@query("skipped_headings", _SKIPPED, ("r_subsections", "r_sections"))
def _(r):
    return T.skipped_headings(r.subsections, r.sections)


@query("union_heading_errors", f"{_REPEATED} UNION ALL {_SKIPPED}", ("r_subsections", "r_sections"))
def _(r):
    return T.union_heading_errors(r.subsections, r.sections)


@query("heading_error_flags", f"""WITH e AS ({_REPEATED} UNION ALL {_SKIPPED}),
  f AS (SELECT id, max_by(error, (CASE WHEN starts_with(error, 'Repeated') THEN '1' ELSE '0' END) || error) AS heading_error FROM e GROUP BY id)
  SELECT s.id, s.name, f.heading_error FROM r_subsections s LEFT JOIN f ON f.id = s.id""", ("r_subsections", "r_sections"))
def _(r):
    errors = T.union_heading_errors(r.subsections, r.sections)
    return T.heading_error_flags(r.subsections.select("id", "name"), errors)


@query("next_order", """SELECT d.id AS document_id, coalesce(max(s."order"), 0) + 1 AS next_order
  FROM r_documents d LEFT JOIN r_sections s ON s.document_id = d.id GROUP BY d.id""", ("r_documents", "r_sections"))
def _(r):
    return T.next_order(r.sections, r.documents)


def _slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("heading_ids", f"""SELECT id, number, concat_ws('--', cast(number AS string), {_slug('section_name')}, {_slug('name')}) AS new_html_id
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_order, "order") AS number FROM r_tree) q""", ("r_tree",))
def _(r):
    rows = r.tree.select("document_id", "section_id", "section_order", "section_name", "id", "order", "name")
    return T.heading_ids(rows).select("id", "number", "new_html_id")


@query("insert_order_space", """SELECT id, section_id, CASE WHEN "order" >= 2 THEN "order" + 1 ELSE "order" END AS "order" FROM r_subsections""", ("r_subsections",))
def _(r):
    return T.insert_order_space(r.subsections.select("id", "section_id", "order"), F.lit(2))


@query("first_subsection", """SELECT document_id, min_by(id, (section_order, "order")) AS id, min(step2) AS step_2_section FROM (
  SELECT t.*, (SELECT coalesce(min_by(x.id, x."order") FILTER (contains(lower(x.name), 'step 2')), min_by(x.id, x."order") FILTER (x."order" = 2))
               FROM r_sections x WHERE x.document_id = t.document_id) AS step2 FROM r_tree t) q GROUP BY document_id""", ("r_tree",))
def _(r):
    first = T.first_subsection(r.tree.select("document_id", "section_order", "order", "id"))
    step2 = T.step_2_section(r.sections).withColumnRenamed("section_id", "step_2_section")
    return first.join(step2, "document_id", "left")


@query("group_by_header", f"""SELECT id, name, group_no, heading FROM (
  SELECT *, max(CASE WHEN NOT (body = '' AND instructions = '' AND lower(trim(name)) = lower(trim(heading))) THEN 1 END)
      OVER (PARTITION BY section_id, group_no ORDER BY "order") AS kept FROM (
  SELECT *, first_value(name) OVER (PARTITION BY section_id, group_no ORDER BY "order") AS heading FROM (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY section_id ORDER BY "order") AS group_no FROM (
  SELECT *, "order" = 1 OR lower(trim(name)) IN ({_in(V.GROUP_HEADERS)}) OR tag IN ('h2', 'h3') AS starts FROM r_subsections) a) b) c) d
  WHERE kept = 1""".replace("AS group_no FROM", "::bigint AS group_no FROM"), ("r_subsections",))
def _(r):
    rows = r.subsections.select("id", "section_id", "order", "name", "tag", "body", "instructions")
    return T.group_by_header(rows).select("id", "name", "group_no", "heading")


@query("toc_items", """SELECT document_id, items, CASE WHEN items <= 23 THEN 'normal' ELSE 'small' END AS size FROM (
  SELECT s.document_id, count(DISTINCT s.id) + count(CASE WHEN x.tag = 'h3' AND s.has_section_page AND NOT contains(lower(s.name), 'contacts') THEN 1 END) + 1 AS items
  FROM r_sections s LEFT JOIN r_subsections x ON x.section_id = s.id GROUP BY s.document_id) q""", ("r_sections", "r_subsections"))
def _(r):
    return T.toc_items(r.sections, r.subsections)


@query("page_break_rules", """SELECT id, CASE WHEN (lower(name) IN ('eligibility', 'program description') AND contains(lower(section_name), 'step 1'))
   OR (lower(name) = 'application checklist' AND contains(lower(section_name), 'step 5')) THEN 'page-break-before' ELSE html_class END AS html_class FROM r_tree""", ("r_tree",))
def _(r):
    return T.page_break_rules(r.tree).select("id", "html_class")


@query("insert_public_info", """WITH step3 AS (SELECT document_id, min_by(id, "order") AS section_id FROM r_sections s
    WHERE lower(name) IN ('step 3: prepare your application', 'step 3: write your application')
      AND EXISTS (SELECT 1 FROM r_subsections x WHERE x.section_id = s.id) GROUP BY document_id),
  place AS (SELECT p.document_id, p.section_id, coalesce(max(CASE WHEN lower(x.name) IN ('other required forms', 'standard forms', 'application components') THEN x."order" END), max(x."order")) AS after
    FROM step3 p JOIN r_subsections x ON x.section_id = p.section_id GROUP BY p.document_id, p.section_id HAVING NOT bool_or(x.name = 'Public information'))
  SELECT t.document_id, t.section_id, t.id, t.name, CASE WHEN t."order" > p.after THEN t."order" + 1 ELSE t."order" END AS "order"
  FROM r_tree t LEFT JOIN place p ON p.section_id = t.section_id
  UNION ALL SELECT document_id, section_id, concat(section_id, '-public'), 'Public information', after + 1 FROM place""", ("r_tree",))
def _(r):
    out = T.insert_public_info(r.tree, "Public information", "h3", "See the public notice.")
    return out.select("document_id", "section_id", "id", "name", "order")
