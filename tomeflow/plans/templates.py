"""Queries over templates, variables and conditional questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.operators import templates as T
from tomeflow.plans.registry import query
from tomeflow.plans.trees import _slug

SUB, TREE = ("r_subsections",), ("r_tree",)
_KEY = _slug("label").replace("'-'", "'_'").replace("^-+|-+$", "^_+|_+$")

VARS = rf"""found AS (SELECT id, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS position FROM (SELECT id, regexp_extract_all(body, '\{{([^{{}}]*[^\s{{}}][^{{}}]*)\}}', 1) AS ms FROM r_subsections) q),
  typed AS (SELECT id, cast(position AS int) AS position, CASE WHEN regexp_matches(trim(m), '(?i)^list\s*:') THEN 'list' ELSE 'string' END AS type,
     CASE WHEN regexp_matches(trim(m), '(?i)^list\s*:') THEN trim(regexp_replace(trim(m), '^[^:]*:', '')) ELSE trim(m) END AS label FROM found WHERE m[1] NOT IN (':', '.', '#')),
  vars AS (SELECT id, position, type, label, {_KEY} || CASE WHEN row_number() OVER (PARTITION BY id, {_KEY} ORDER BY position) = 1 THEN ''
     ELSE '_' || cast(row_number() OVER (PARTITION BY id, {_KEY} ORDER BY position) AS string) END AS key FROM typed)"""

# Conditional questions: one per region row.
_Q_KEY, _Q_LABEL, _Q_PAGE = "lower(replace(r_name, ' ', '_'))", "concat('Does it reach ', r_name, '?')", "cast(r_regionkey % 2 + 1 AS int)"
_Q_SUBS = "CASE r_regionkey % 5 WHEN 0 THEN 'Cost sharing|Eligibility' WHEN 1 THEN 'maintenance of Effort ' WHEN 2 THEN 'Summary|cost sharing' WHEN 3 THEN 'Other submissions' ELSE 'Basic information|Key facts' END"
QNAMES = f"""qn AS (SELECT lower(trim(n)) AS norm_name, min_by(key, pos) AS question_key, min_by(label, pos) AS question_label, min_by(page, pos) AS page
   FROM (SELECT r_regionkey AS pos, {_Q_KEY} AS key, {_Q_LABEL} AS label, {_Q_PAGE} AS page, unnest(string_split({_Q_SUBS}, '|')) AS n FROM region) q GROUP BY lower(trim(n)))"""


def questions(r):
    return r.table("region").select(
        F.col("r_regionkey").alias("position"), F.expr(_Q_KEY).alias("key"), F.expr(_Q_LABEL).alias("label"), F.expr(_Q_PAGE).alias("page"),
        F.split(F.expr(_Q_SUBS), r"\|").alias("subsections"),
    )


@query("extract_variables", f"WITH {VARS} SELECT id, position, key, type, label FROM vars", SUB)
def _(r):
    return T.extract_variables(r.subsections)


@query("dedup_variable_keys", f"WITH {VARS} SELECT id, string_agg(key, ',' ORDER BY position) AS keys, count(*) AS n FROM vars GROUP BY id", SUB)
def _(r):
    v = T.variables_of(r.subsections)
    return v.select("id", F.array_join(F.transform("variables", lambda x: x["key"]), ",").alias("keys"), F.size("variables").cast("bigint").alias("n"))


_VALUE = "concat('Agency ', cast(length(id) AS string))"


@query("substitute_variables", f"SELECT id, replace(body, '{{Agency name}}', {_VALUE}) AS text FROM r_subsections WHERE contains(body, '{{')", SUB)
def _(r):
    values = F.transform(
        "variables", lambda v: v.withField("value", F.when(v["label"] == "Agency name", F.expr(_VALUE)).when(v["type"] == "list", "codes"))
    )
    rows = r.subsections.select("id", "body").join(T.variables_of(r.subsections), "id").withColumn("variables", values)
    return rows.select("id", T.substitute(F.col("body"), F.col("variables")).alias("text"))


@query("conditional_token", """SELECT id, CASE WHEN contains(instructions, '(YES)') THEN true WHEN contains(instructions, '(NO)') THEN false END AS answer FROM r_subsections""", SUB)
def _(r):
    return r.subsections.select("id", T.conditional_answer(F.col("instructions")).alias("answer"))


@query("question_matches", f"""WITH {QNAMES} SELECT s.id, s.name, q.question_key, q.page FROM r_subsections s JOIN qn q ON q.norm_name = lower(trim(s.name))""", SUB)
def _(r):
    return T.question_matches(r.subsections, questions(r)).select("id", "name", "question_key", "page")


@query("template_notes", f"""WITH {QNAMES}, {VARS}, l AS (SELECT id, string_agg(label, ', ' ORDER BY position) AS labels FROM vars GROUP BY id)
  SELECT s.id, CASE WHEN q.norm_name IS NULL OR NOT (contains(s.instructions, '(YES)') OR contains(s.instructions, '(NO)')) THEN ''
      ELSE 'Note: Writers will be asked “' || q.question_label || '”, and will see this section if they answer: ' || CASE WHEN contains(s.instructions, '(YES)') THEN 'Yes' ELSE 'No' END || '.' END AS note,
    coalesce(l.labels, '') AS labels FROM r_subsections s LEFT JOIN qn q ON q.norm_name = lower(trim(s.name)) LEFT JOIN l ON l.id = s.id""", SUB)
def _(r):
    return T.template_notes(r.subsections, questions(r))


_ANSWER = "CASE WHEN cast(id AS bigint) % {0} = 0 THEN {1} END"
_INST = f"""inst AS (SELECT id, parent, cast(id AS bigint) % 3 = 0 AS a0, CASE WHEN cast(id AS bigint) % 4 <> 0 THEN cast(id AS bigint) % 4 = 1 END AS a1 FROM r_documents WHERE parent IS NOT NULL)"""


@query("instantiate_template", f"""WITH {QNAMES}, {_INST} SELECT i.id AS instance_id, t.section_id, t.id, t.name FROM r_tree t JOIN inst i ON i.parent = t.document_id LEFT JOIN qn q ON q.norm_name = lower(trim(t.name))
  WHERE NOT (contains(t.instructions, '(YES)') OR contains(t.instructions, '(NO)'))
     OR (q.norm_name IS NOT NULL AND coalesce((CASE q.question_key WHEN 'africa' THEN i.a0 WHEN 'america' THEN i.a1 END) = contains(t.instructions, '(YES)'), false))""", ("r_tree", "r_documents"))
def _(r):
    inst = r.documents.filter("parent IS NOT NULL").select(
        "id", "parent",
        F.expr("map_filter(map('africa', cast(id AS bigint) % 3 = 0, 'america', CASE WHEN cast(id AS bigint) % 4 <> 0 THEN cast(id AS bigint) % 4 = 1 END), (k, v) -> v IS NOT NULL)").alias("answers"),
    )
    rows = r.tree.select("document_id", "section_id", "id", "name", "instructions")
    return T.instantiate(inst, rows, questions(r)).select("instance_id", "section_id", "id", "name")


@query("prefill_variables", f"""WITH {VARS}, lab AS (SELECT v.id, v.key, CASE v.position % 7 WHEN 0 THEN v.label || ' agency' WHEN 4 THEN v.label || ' (NOFO title)' WHEN 5 THEN 'the nofo number of ' || v.label WHEN 1 THEN v.label || ' and Tagline' WHEN 2 THEN v.label || ' tagline of agency' WHEN 3 THEN v.label || ' activity code' ELSE v.label || ' Federal Assistance Listing, agency' END AS label, t.document_id
     FROM vars v JOIN r_tree t ON t.id = v.id)
  SELECT l.id, l.key, l.label, CASE WHEN contains(lower(l.label), 'tagline') AND d.tagline <> '' THEN d.tagline
     WHEN contains(lower(l.label), 'federal assistance listing') THEN concat('93.', d.id) WHEN contains(lower(l.label), 'activity code') THEN concat('U', d.id)
     WHEN contains(lower(l.label), 'nofo number') AND d.number <> '' THEN d.number WHEN contains(lower(l.label), 'nofo title') AND d.title <> '' THEN d.title
     WHEN contains(lower(l.label), 'agency') AND d.agency <> '' THEN d.agency END AS value FROM lab l JOIN r_documents d ON d.id = l.document_id""", ("r_tree", "r_documents"))
def _(r):
    label = F.when(F.col("position") % 7 == 5, F.concat(F.lit("the nofo number of "), "label")).otherwise(F.concat("label", F.expr("CASE position % 7 WHEN 0 THEN ' agency' WHEN 4 THEN ' (NOFO title)' WHEN 1 THEN ' and Tagline' WHEN 2 THEN ' tagline of agency' WHEN 3 THEN ' activity code' ELSE ' Federal Assistance Listing, agency' END")))
    rows = T.extract_variables(r.subsections).select("id", "key", label.alias("label")).join(r.tree.select("id", "document_id"), "id")
    coded = r.documents.withColumn("activity_code", F.concat(F.lit("U"), "id")).withColumn("federal_assistance_listing", F.concat(F.lit("93."), "id"))
    docs = coded.select(F.col("id").alias("document_id"), *V.INSTANCE_LABELS)
    return rows.join(docs, "document_id").select("id", "key", "label", T.prefill(F.col("label"), F.lit(None).cast("string")).alias("value"))


@query("set_variable_values", """SELECT id, concat('[{"key":"region","type":"string","label":"', name, '","value":"new ', tag, '"},{"key":"codes","type":"list","label":"Codes","value":"kept"}]') AS variables
  FROM r_subsections WHERE name <> ''""", SUB)
def _(r):
    stored = F.format_string('[{"key":"region","type":"string","label":"%s","value":"old"},{"key":"codes","type":"list","label":"Codes","value":"kept"}]', "name")
    values = F.create_map(F.lit("region"), F.concat(F.lit("new "), "tag"), F.lit("unknown"), F.lit("x"))
    return r.subsections.filter("name <> ''").select("id", T.set_values(stored, values).alias("variables"))


@query("merge_answers", """SELECT id, concat_ws(',', CASE WHEN k % 4 <> 0 THEN concat('a=', CASE WHEN k % 4 = 1 THEN 'Yes' ELSE 'No' END) END,
   CASE WHEN k % 5 <> 0 THEN concat('b=', CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END) END) AS answers FROM (SELECT id, cast(id AS bigint) AS k FROM r_documents) q""", ("r_documents",))
def _(r):
    k = F.col("id").cast("bigint")
    drop_null = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    current = drop_null(F.create_map(F.lit("a"), k % 3 == 0, F.lit("b"), F.when(k % 5 != 0, k % 2 == 0)))
    given = F.create_map(F.lit("a"), F.when(k % 4 != 0, k % 4 == 1), F.lit("b"), F.lit(None).cast("boolean"))
    merged = T.merge_answers(current, F.array(F.lit("a")), given)
    shown = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], T.yes_no(e["value"])))
    return r.documents.select("id", F.array_join(shown, ",").alias("answers"))
