"""Queries that compare two versions of the tree.

The new version is derived from the old one by fixed remainders: rows dropped, renamed, edited, respaced and moved.
Both come from one shuffle by section, and are compared as they leave it.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tomeflow import fixed_values as V
from tomeflow.operators import compare as C
from tomeflow.plans.registry import query

TREE = ("r_tree", "r_sections")

NAME2 = """CASE WHEN "order" % 7 = 3 AND name <> '' THEN concat(name, ' revised') WHEN "order" % 7 = 6 AND name <> '' THEN 'Budget' ELSE name END"""
BODY2 = """CASE WHEN "order" % 4 = 1 THEN concat(body, ' Changed.') WHEN "order" % 4 = 2 THEN replace(body, ' ', '  ') ELSE body END"""
KEY2 = """ "order" * 10 + CASE WHEN "order" % 5 = 2 THEN 25 ELSE 0 END"""
KEPT2 = """ "order" % 6 <> 5"""


def _sp(text: str) -> str:
    return text.replace('"order"', "`order`")


def old_rows(r):
    return r.subsections.select(
        "section_id", "id", F.col("order").alias("pos"), "name", "order", "tag", "html_id", "body", "comparison_type",
        F.filter(F.split("required", r"\|"), lambda s: s != "").alias("required"),
    )


def new_rows(r):
    rows = r.subsections.filter(_sp(KEPT2)).selectExpr(
        "section_id", "concat('n', id) AS id", f"{_sp(NAME2)} AS name", "`order`", "tag", "html_id", f"{_sp(BODY2)} AS body", f"{_sp(KEY2)} AS nkey"
    )
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("section_id").orderBy("nkey"))).drop("nkey")  # seven at most


def pairs(r):
    s = r.sections.select(F.col("document_id").alias("pair"), "name", "order", "id")
    return C.pair_sections(s, s)


PAIRED = f"""o AS (SELECT section_id, id, "order" AS pos, name, "order", tag, html_id, body, comparison_type, required FROM r_subsections),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY nkey) AS pos FROM (SELECT section_id AS grp, 'n' || id AS id, {NAME2} AS name, "order", tag, html_id, {BODY2} AS body, {KEY2} AS nkey
        FROM r_subsections WHERE {KEPT2}) q),
  pr AS (SELECT s.document_id AS pair, s.name AS section_name, s.id AS grp, s."order" AS section_order,
     (SELECT min_by(x.id, x."order") FROM r_sections x WHERE x.document_id = s.document_id AND x.name = s.name) AS old_section FROM r_sections s),
  og AS (SELECT pr.grp, o.* FROM pr JOIN o ON o.section_id = pr.old_section),
  cnt AS (SELECT grp, count(*) FILTER (side = 0) AS m, count(*) FILTER (side = 1) AS k FROM (SELECT grp, 0 AS side FROM og UNION ALL SELECT grp, 1 FROM n) q GROUP BY grp),
  cand AS (SELECT n.grp, n.pos AS i, og.pos AS j, n.name AS nn, og.name AS oname FROM n JOIN og ON og.grp = n.grp),
  -- nearest lockstep neighbours that are both named, backwards and forwards
  side AS (SELECT c.grp, c.i, c.j, min(CASE WHEN x.pos < c.i THEN c.i - x.pos END) AS bk, min(CASE WHEN x.pos > c.i THEN x.pos - c.i END) AS fw
     FROM cand c JOIN n x ON x.grp = c.grp AND x.name <> '' JOIN og y ON y.grp = c.grp AND y.name <> '' AND y.pos - c.j = x.pos - c.i GROUP BY c.grp, c.i, c.j),
  ok AS (SELECT c.grp, c.i, c.j FROM cand c JOIN cnt ON cnt.grp = c.grp LEFT JOIN side s ON s.grp = c.grp AND s.i = c.i AND s.j = c.j
     WHERE CASE WHEN c.nn <> '' AND c.oname <> '' THEN c.nn = c.oname ELSE
       CASE WHEN s.bk IS NULL THEN c.i = c.j ELSE (SELECT any_value(x.name) FROM n x WHERE x.grp = c.grp AND x.pos = c.i - s.bk) = (SELECT any_value(y.name) FROM og y WHERE y.grp = c.grp AND y.pos = c.j - s.bk) END
       AND CASE WHEN s.fw IS NULL THEN cnt.k - c.i = cnt.m - c.j ELSE (SELECT any_value(x.name) FROM n x WHERE x.grp = c.grp AND x.pos = c.i + s.fw) = (SELECT any_value(y.name) FROM og y WHERE y.grp = c.grp AND y.pos = c.j + s.fw) END END),
  walk(grp, i, ptr, hit) AS (SELECT grp, 0::bigint, 0::bigint, NULL::bigint FROM cnt
     UNION ALL SELECT w.grp, w.i + 1, coalesce(h.j, w.ptr), h.j FROM walk w JOIN cnt ON cnt.grp = w.grp
       LEFT JOIN (SELECT w2.grp, w2.i AS wi, min(k.j)::bigint AS j FROM walk w2 JOIN ok k ON k.grp = w2.grp AND k.i = w2.i + 1 AND k.j > w2.ptr GROUP BY w2.grp, w2.i) h ON h.grp = w.grp AND h.wi = w.i
       WHERE w.i < cnt.k),
  placed AS (SELECT w.grp, w.i AS k1, 1 AS k2, 0::bigint AS k3, w.hit AS opos, w.i AS npos FROM walk w WHERE w.i > 0
     UNION ALL SELECT og.grp, coalesce((SELECT min(w.i) FROM walk w WHERE w.grp = og.grp AND w.hit > og.pos), {C.AT_END}), 0, og.pos, og.pos, NULL FROM og
       WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.grp = og.grp AND w.hit = og.pos)),
  cmp0 AS (SELECT p.*, o.name AS o_name, o."order" AS o_order, o.body AS o_body, o.comparison_type, o.required, n.name AS n_name, n."order" AS n_order, n.body AS n_body,
     CASE WHEN p.opos IS NULL THEN 'ADD' WHEN p.npos IS NULL THEN 'DELETE' WHEN trim(regexp_replace(o.body, '\\s+', ' ', 'g')) = trim(regexp_replace(n.body, '\\s+', ' ', 'g')) THEN 'MATCH' ELSE 'UPDATE' END AS status
     FROM placed p LEFT JOIN og o ON o.grp = p.grp AND o.pos = p.opos LEFT JOIN n ON n.grp = p.grp AND n.pos = p.npos),
  cmp AS (SELECT c.grp, pr.pair, pr.section_name, pr.section_order, row_number() OVER (PARTITION BY c.grp ORDER BY k1, k2, k3) AS seq, status,
     CASE WHEN opos IS NULL THEN '' ELSE coalesce(nullif(o_name, ''), '(#' || o_order || ')') END AS old_name,
     CASE WHEN npos IS NULL THEN '' WHEN status = 'MATCH' THEN coalesce(nullif(o_name, ''), '(#' || o_order || ')') ELSE coalesce(nullif(n_name, ''), '(#' || n_order || ')') END AS new_name,
     coalesce(o_body, '') AS old_value, CASE WHEN status = 'MATCH' THEN o_body ELSE coalesce(n_body, '') END AS new_value, coalesce(comparison_type, 'body') AS comparison_type, coalesce(required, '') AS required
     FROM cmp0 c JOIN pr ON pr.grp = c.grp)"""

_GRAMS = "[substr({0}, i, 3) for i in range(1, greatest(length({0}) - 1, 2)) if regexp_matches(substr({0}, i, 3), '^[A-Za-z0-9]{{3}}$')]"
MERGED = f"""{PAIRED}, look AS (SELECT *, lead(status) OVER w AS ns, lead(old_name) OVER w AS non, lead(old_value) OVER w AS nov, lead(comparison_type) OVER w AS nct, lead(required) OVER w AS nreq,
     lag(status) OVER w AS ps, lag(new_name) OVER w AS pnn, lag(new_value) OVER w AS pnv FROM cmp WINDOW w AS (PARTITION BY grp ORDER BY seq)),
  flagged AS (SELECT *, status = 'ADD' AND ns = 'DELETE' AND (trim(new_value) = trim(nov) OR list_has_any({_GRAMS.format('new_name')}, {_GRAMS.format('non')})) AS j,
     status = 'DELETE' AND ps = 'ADD' AND (trim(pnv) = trim(old_value) OR list_has_any({_GRAMS.format('pnn')}, {_GRAMS.format('old_name')})) AS gone FROM look),
  merged AS (SELECT grp, pair, section_name, section_order, seq, CASE WHEN j THEN 'UPDATE' ELSE status END AS status, CASE WHEN j THEN non ELSE old_name END AS old_name, new_name,
     CASE WHEN j THEN trim(nov) ELSE old_value END AS old_value, CASE WHEN j THEN trim(new_value) ELSE new_value END AS new_value, CASE WHEN j THEN nct ELSE comparison_type END AS comparison_type,
     CASE WHEN j THEN nreq ELSE required END AS required, coalesce(j AND non <> new_name, false) AS renamed FROM flagged WHERE NOT coalesce(gone, false))"""
TYPED = f"""{MERGED}, ms AS (SELECT *, len([s for s in string_split(required, '|') if s <> '' AND NOT contains(lower(trim(regexp_replace(new_value, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))))]) AS missing
     FROM merged WHERE comparison_type <> 'none'),
  typed AS (SELECT * REPLACE (CASE WHEN status = 'UPDATE' AND NOT renamed AND (comparison_type = 'name' OR (comparison_type = 'diff_strings' AND missing = 0)) THEN 'MATCH' ELSE status END AS status) FROM ms)"""
_OUT = "pair, section_order, seq, status, old_name, new_name, old_value, new_value"
OUT = ["pair", "section_order", "seq", "status", "old_name", "new_name", "old_value", "new_value"]


@query("match_subsections", f"WITH RECURSIVE {PAIRED} SELECT p.pair, p.grp, p.section_name, p.old_section FROM pr p", TREE)
def _(r):
    return pairs(r).select("pair", "grp", "section_name", "old_section")


@query("compare_sections", f"WITH RECURSIVE {PAIRED} SELECT {_OUT} FROM cmp", TREE)
def _(r):
    return C.compare_sections(pairs(r), old_rows(r), new_rows(r)).select(*OUT)


@query("merge_renames", f"WITH RECURSIVE {MERGED} SELECT {_OUT}, renamed FROM merged", TREE)
def _(r):
    return C.compare_and_merge(pairs(r), old_rows(r), new_rows(r)).select(*OUT, "renamed")


@query("apply_comparison_types", f"WITH RECURSIVE {TYPED} SELECT {_OUT}, comparison_type FROM typed", TREE)
def _(r):
    return C.compare_versions(pairs(r), old_rows(r), new_rows(r)).select(*OUT, "comparison_type")


@query("compare_versions", f"WITH RECURSIVE {TYPED} SELECT {_OUT}, renamed FROM typed WHERE status NOT IN ('MATCH')", TREE)
def _(r):
    return C.compare_versions(pairs(r), old_rows(r), new_rows(r), ["MATCH"]).select(*OUT, "renamed")


@query("filter_diff_status", f"WITH RECURSIVE {TYPED} SELECT pair, section_name, status, count(*) AS n FROM typed WHERE status NOT IN ('MATCH', 'ADD') GROUP BY ALL", TREE)
def _(r):
    rows = C.compare_versions(pairs(r), old_rows(r), new_rows(r), ["MATCH", "ADD"])
    return rows.groupBy("pair", "section_name", "status").agg(F.count("*").alias("n"))


CHANGED = f"""{TYPED}, nn AS (SELECT document_id AS pair, count(*) AS n FROM r_tree WHERE comparison_type <> 'none' GROUP BY document_id),
  fs AS (SELECT pair, min_by(grp, (section_order, grp)) AS first_grp FROM typed GROUP BY pair),
  rk AS (SELECT t.*, row_number() OVER (PARTITION BY t.grp ORDER BY t.seq) AS rn, t.grp = fs.first_grp AND coalesce(nn.n, 0) > 1 AS opens,
     lower(trim(coalesce(nullif(t.old_name, ''), t.new_name))) = 'basic information' AS basic FROM typed t JOIN fs ON fs.pair = t.pair LEFT JOIN nn ON nn.pair = t.pair),
  d1 AS (SELECT * FROM rk WHERE NOT (opens AND rn = 1 AND basic)),
  d2 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS rn2 FROM d1),
  d3 AS (SELECT * FROM d2 WHERE NOT (opens AND rn2 = 1 AND contains(lower(old_value), 'have questions?'))),
  sh AS (SELECT *, bool_and(comparison_type = 'body' AND status = 'ADD') OVER (PARTITION BY grp) AS adds FROM d3),
  shown AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY section_order, grp, seq) AS number FROM sh WHERE NOT adds AND status <> 'MATCH')"""


def _old_sections(r):
    return r.sections.select(F.col("document_id").alias("pair"), "id")


def _changed(r):
    old = old_rows(r)
    return C.changed_rows(C.compare_versions(pairs(r), old, new_rows(r)), old, _old_sections(r))


@query("changed_by_section", f"WITH RECURSIVE {CHANGED} SELECT pair, section_name, count(*) AS changes FROM shown GROUP BY pair, section_name", (*TREE,))
def _(r):
    return _changed(r).groupBy("pair", "section_name").agg(F.count("*").alias("changes"))


@query("number_changes", f"WITH RECURSIVE {CHANGED} SELECT pair, number, status, old_name, new_name FROM shown", TREE)
def _(r):
    return C.number_changes(_changed(r)).select("pair", "number", "status", "old_name", "new_name")


_NEW_TITLE = "concat('(COMPARE) ', title)"
_META = ", ".join(f"('{c}')" for c in V.COMPARED_FIELDS)
_OLDV = "CASE f.field " + " ".join(f"WHEN '{c}' THEN coalesce(d.{c}, '')" for c in V.COMPARED_FIELDS) + " END"
_NEWV = (
    "CASE f.field WHEN 'title' THEN CASE WHEN k % 3 = 0 THEN replace(d.title, '(COMPARE) ', '') ELSE '' END WHEN 'tagline' THEN 'Fresh' "
    "WHEN 'subagency' THEN upper(coalesce(d.subagency, '')) "
    + " ".join(f"WHEN '{c}' THEN coalesce(d.{c}, '')" for c in V.COMPARED_FIELDS if c not in ("title", "tagline", "subagency")) + " END"
)


@query("compare_metadata", f"""WITH v AS (SELECT d.id AS old_doc, 'n' || d.id AS new_doc, f.field, {_OLDV} AS old_value, {_NEWV} AS new_value
   FROM (SELECT *, cast(id AS bigint) AS k FROM r_documents) d, (VALUES {_META}) f(field))
  SELECT *, CASE WHEN old_value = new_value THEN 'MATCH' WHEN old_value = '' THEN 'ADD' WHEN new_value = '' THEN 'DELETE' ELSE 'UPDATE' END AS status FROM v""", ("r_documents",))
def _(r):
    new = r.documents.withColumn("title", F.expr(f"CASE WHEN cast(id AS bigint) % 3 = 0 THEN {_NEW_TITLE} ELSE '' END"))
    new = new.withColumn("tagline", F.lit("Fresh")).withColumn("subagency", F.upper("subagency")).withColumn("id", F.concat(F.lit("n"), "id"))
    both = r.documents.select(F.col("id").alias("old_doc"), F.concat(F.lit("n"), "id").alias("new_doc"))
    return C.compare_metadata(both, r.documents, new)


@query("has_diff", f"""SELECT id, trim(regexp_replace(body, '\\s+', ' ', 'g')) <> trim(regexp_replace({BODY2}, '\\s+', ' ', 'g')) AS has_diff FROM r_subsections""", ("r_subsections",))
def _(r):
    rows = r.subsections.selectExpr("id", "body", f"{_sp(BODY2)} AS new_body")
    return C.has_diff(rows, F.col("body"), F.col("new_body")).select("id", "has_diff")
