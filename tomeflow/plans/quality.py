"""Queries over links, ids, page breaks, readability and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.functions.text import ACCENTED, PLAIN
from tomeflow.operators import filters as O
from tomeflow.operators import quality as Q
from tomeflow.plans import trees as PT
from tomeflow.plans.registry import query

OWN = "site7.example.org"
SUBS = ("r_subsections", "r_sections")

LINKS = r"""raw_links AS (SELECT id, section_id, unnest(regexp_extract_all(body, '!?\[[^\]]*\]\([^)\s]*\)|<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS m FROM r_subsections),
  all_links AS (SELECT l.id AS subsection_id, l.section_id, s.document_id, s.name AS section_name,
    CASE WHEN m[1] = '[' THEN regexp_extract(m, '\]\(([^)\s]*)\)', 1) ELSE regexp_extract(m, 'href="([^"]*)"', 1) END AS url,
    CASE WHEN m[1] = '[' THEN regexp_extract(m, '^\[([^\]]*)\]', 1) ELSE regexp_extract(m, '>([^<]*)</a>', 1) END AS link_text
    FROM raw_links l JOIN r_sections s ON s.id = l.section_id WHERE m[1] <> '!')"""
IDS = r"""ids AS (SELECT document_id, '#' || html_id AS ref FROM r_sections
    UNION SELECT s.document_id, '#' || x.html_id FROM r_subsections x JOIN r_sections s ON s.id = x.section_id WHERE x.html_id <> ''
    UNION SELECT s.document_id, '#' || i FROM (SELECT section_id, unnest(regexp_extract_all(body, '\sid="([^"]+)"', 1)) AS i FROM r_subsections) x JOIN r_sections s ON s.id = x.section_id)"""
BROKEN = f"""{LINKS}, {IDS}, broken AS (SELECT * FROM all_links l
    WHERE (starts_with(url, '/') OR starts_with(url, '#') OR starts_with(url, 'https://docs.google.com') OR starts_with(url, 'bookmark') OR starts_with(url, 'file://') OR url = 'about:blank')
      AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.document_id = l.document_id AND i.ref = l.url))"""
EXTERNAL = f"starts_with(url, 'http') AND NOT contains(url, '{OWN}')"


@query("external_links", f"""WITH {LINKS} SELECT document_id, section_name, subsection_id, url, link_text,
  regexp_extract(url, '^https?://([^/]+)', 1) AS domain FROM all_links WHERE {EXTERNAL}""", SUBS)
def _(r):
    return Q.external_links(r.subsections, r.sections, OWN).select("document_id", "section_name", "subsection_id", "url", "link_text", "domain")


@query("document_ids", f"WITH {IDS} SELECT document_id, ref FROM ids", SUBS)
def _(r):
    return Q.document_ids(r.subsections, r.sections)


@query("broken_links", f"WITH {BROKEN} SELECT document_id, subsection_id, url, link_text FROM broken", SUBS)
def _(r):
    return Q.broken_links(r.subsections, r.sections).select("document_id", "subsection_id", "url", "link_text")


_CRAWL = """SELECT DISTINCT url, 'HEAD' AS method, CASE length(url) % 5 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 200 WHEN 3 THEN 503 END AS status,
    CASE WHEN length(url) % 7 = 0 THEN concat(url, '/moved') ELSE url END AS final_url, CASE WHEN length(url) % 5 = 4 THEN 'Error: timeout' END AS error FROM {0}
  UNION ALL SELECT DISTINCT url, 'GET', CASE WHEN length(url) % 2 = 0 THEN 200 END, url, CAST(NULL AS string) FROM {0}"""


@query("link_status", f"""WITH {LINKS}, ext AS (SELECT * FROM all_links WHERE {EXTERNAL}), crawl AS ({_CRAWL.format('ext')}),
  best AS (SELECT h.url, CASE WHEN h.status IN (403, 405, 500, 501, 502, 503) AND g.status IS NOT NULL THEN g.status ELSE h.status END AS status,
     CASE WHEN h.status IN (403, 405, 500, 501, 502, 503) AND g.status IS NOT NULL THEN g.final_url ELSE h.final_url END AS final_url,
     CASE WHEN h.status IN (403, 405, 500, 501, 502, 503) AND g.status IS NOT NULL THEN g.error ELSE h.error END AS error
   FROM crawl h JOIN crawl g ON g.url = h.url AND g.method = 'GET' WHERE h.method = 'HEAD')
  SELECT e.subsection_id, e.url, b.status, CASE WHEN b.final_url <> e.url THEN b.final_url END AS redirect_url, b.error FROM ext e LEFT JOIN best b ON b.url = e.url""", SUBS)
def _(r):
    found = Q.external_links(r.subsections, r.sections, OWN).select("subsection_id", "url")
    crawl = r.spark.sql(_CRAWL.format("{found}"), found=found)
    return Q.link_status(found, crawl)


@query("link_totals", f"WITH {LINKS} SELECT document_id, count(*) AS links FROM all_links WHERE {EXTERNAL} GROUP BY document_id", SUBS)
def _(r):
    return Q.link_totals(r.subsections, r.sections, OWN)


_BREAKS = "len([c for c in string_split(html_class, ' ') if starts_with(c, 'page-break')]) + len(regexp_extract_all(body, 'page-break'))"


@query("page_break_counts", f"SELECT document_id, cast(sum({_BREAKS}) AS bigint) AS page_breaks FROM r_tree GROUP BY document_id", ("r_tree",))
def _(r):
    return Q.page_break_counts(r.subsections, r.sections)


@query("callout_words", r"""SELECT document_id, cast(sum(len(regexp_extract_all(body, '\S+'))) AS bigint) AS words FROM r_tree
  WHERE callout_box GROUP BY document_id""", ("r_tree",))
def _(r):
    return Q.callout_words(r.subsections.filter("callout_box"), r.sections)


@query("name_lengths", """SELECT document_id, 'section' AS kind, id, name, length(name) AS length FROM r_sections
  UNION ALL SELECT document_id, 'subsection', id, name, length(name) FROM r_tree WHERE name <> ''""", ("r_tree",))
def _(r):
    return Q.name_lengths(r.subsections, r.sections).withColumn("length", F.col("length").cast("bigint"))


@query("quality_summary", f"""WITH {BROKEN}, e AS ({PT._REPEATED} UNION ALL {PT._SKIPPED}),
  he AS (SELECT s.document_id, count(*) AS n FROM e JOIN r_sections s ON s.id = e.section_id GROUP BY s.document_id),
  br AS (SELECT document_id, count(*) AS n FROM broken GROUP BY document_id),
  ex AS (SELECT document_id, count(*) AS n FROM all_links WHERE {EXTERNAL} GROUP BY document_id),
  pb AS (SELECT s.document_id, cast(sum({_BREAKS.replace('html_class', 'x.html_class').replace('body', 'x.body')}) AS bigint) AS n FROM r_subsections x JOIN r_sections s ON s.id = x.section_id GROUP BY s.document_id),
  mm AS (SELECT id, count(*) AS n FROM (SELECT id, author AS v FROM r_documents UNION ALL SELECT id, subject FROM r_documents UNION ALL SELECT id, keywords FROM r_documents) q
         WHERE trim(v) = '' OR regexp_matches(trim(v), '^\\{{[^{{}}]+\\}}$') GROUP BY id),
  q AS (SELECT d.id AS document_id, d.status, coalesce(mm.n, 0) AS missing_metadata, coalesce(br.n, 0) AS broken_links, coalesce(he.n, 0) AS heading_errors,
     CASE WHEN d.status IN ('draft', 'active', 'ready-for-qa', 'paused') THEN coalesce(ex.n, 0) ELSE 0 END AS external_links, coalesce(pb.n, 0) AS page_breaks
   FROM r_documents d LEFT JOIN mm ON mm.id = d.id LEFT JOIN br ON br.document_id = d.id LEFT JOIN he ON he.document_id = d.id
   LEFT JOIN ex ON ex.document_id = d.id LEFT JOIN pb ON pb.document_id = d.id)
  SELECT *, missing_metadata + broken_links + heading_errors + external_links > 0 AS has_warnings FROM q""", (*SUBS, "r_documents"))
def _(r):
    return Q.quality_summary(r.documents, r.sections, r.subsections, OWN)


_READ = rf"""WITH low AS (SELECT doc_id, text, translate(lower(text), '{ACCENTED}', '{PLAIN}') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[\p{{L}}\p{{N}}'']+') AS words FROM low),
  n AS (SELECT doc_id, len(words) AS nw, greatest(len(regexp_extract_all(text, '[.!?]+(?:\s|\z)')), 1) AS ns, greatest(len(regexp_extract_all(text, '\S[^\n]*')), 1) AS np,
     len(regexp_extract_all(t, '[aeiouy]+')) + len([x for x in words if NOT regexp_matches(x, '[aeiouy]')]) AS sy,
     len(regexp_extract_all(t, '(?:\A|[^\p{{L}}\p{{N}}])(?:is|are|was|were|be|been|being)\s+[a-z]+(?:ed|en)(?:\z|[.!?]|[^\p{{L}}\p{{N}}.!?][^.!?]*)')) AS pa FROM w),
  m AS (SELECT doc_id, cast(nw AS double) AS word_count, round(nw / ns, 4) AS words_per_sentence, round(ns / np, 4) AS sentences_per_paragraph,
     round(206.835::double - 1.015::double * (nw / ns) - 84.6::double * (sy / greatest(nw, 1)), 4) AS flesch_reading_ease,
     round(0.39::double * (nw / ns) + 11.8::double * (sy / greatest(nw, 1)) - 15.59::double, 4) AS flesch_kincaid_grade_level,
     round(100.0::double * pa / ns, 4) AS passive_sentence_percentage FROM n)"""


@query("readability", f"{_READ} SELECT * FROM m")
def _(r):
    return Q.readability(r.table("documents"), "doc_id", "text")


@query("readability_goals", f"""{_READ}, long AS (UNPIVOT m ON word_count, words_per_sentence, sentences_per_paragraph, flesch_reading_ease, flesch_kincaid_grade_level,
    passive_sentence_percentage INTO NAME metric_id VALUE metric)
  SELECT doc_id, metric_id, metric, CASE metric_id WHEN 'word_count' THEN CASE WHEN metric <= 13500 THEN 'Within target' ELSE 'Needs improvement' END
    WHEN 'words_per_sentence' THEN CASE WHEN metric <= 15 THEN 'Within target' ELSE 'Needs improvement' END
    WHEN 'sentences_per_paragraph' THEN CASE WHEN metric <= 3 THEN 'Within target' ELSE 'Needs improvement' END
    WHEN 'flesch_reading_ease' THEN CASE WHEN metric >= 39 THEN 'Within target' ELSE 'Needs improvement' END
    WHEN 'passive_sentence_percentage' THEN CASE WHEN metric <= 8 THEN 'Within target' ELSE 'Needs improvement' END
    ELSE CASE WHEN metric <= 11.5 THEN 'Within target' WHEN metric > 12.5 THEN 'Needs improvement' ELSE 'Check document type' END END AS assessment FROM long""")
def _(r):
    m = Q.readability(r.table("documents"), "doc_id", "text")
    return Q.readability_goals(m, "doc_id", Q.default_goals(r.spark))


_COVER = "concat('media/img', cast(cast(id AS bigint) % 60 * 15 AS string), '.png')"


@query("image_usage", f"""SELECT i.key, d.id AS document_id, d.title, d.status FROM r_images i
  LEFT JOIN r_documents d ON {_COVER.replace('id AS', 'd.id AS')} = i.key AND d.archived IS NULL""", ("r_images", "r_documents"))
def _(r):
    return Q.image_usage(r.images, r.documents.withColumn("cover_image", F.expr(_COVER)))


@query("field_value_mentions", r"""SELECT t.id, t.document_id FROM r_tree t JOIN r_documents d ON d.id = t.document_id
  WHERE d.tagline <> '' AND NOT (lower(t.name) = 'basic information' AND t."order" = 1 AND t.section_order = 1)
    AND contains(lower(regexp_replace(t.body, '\]\([^)]*\)', ']', 'g')), lower(d.tagline))""", ("r_tree", "r_documents"))
def _(r):
    return Q.field_value_mentions(r.tree, r.documents, "tagline").select("id", "document_id")


@query("exists_checks", """SELECT d.id AS document_id, d.updated_by AS user_id, EXISTS (SELECT 1 FROM r_sections s WHERE s.document_id = d.id) AS has_sections,
  CASE WHEN u.id IS NULL THEN NULL ELSE (SELECT count(*) FROM r_users x WHERE x.is_superuser) - CASE WHEN u.is_superuser THEN 1 ELSE 0 END > 0 END AS another_superuser
  FROM r_documents d LEFT JOIN r_users u ON u.id = d.updated_by""", ("r_documents", "r_sections", "r_users"))
def _(r):
    has = Q.has_sections(r.documents, r.sections)
    other = Q.another_superuser(r.users).withColumnRenamed("id", "user_id")
    who = r.documents.select(F.col("id").alias("document_id"), F.col("updated_by").alias("user_id"))
    return who.join(has, "document_id").join(other, "user_id", "left")


@query("person_choices", """WITH names AS (SELECT DISTINCT "group", trim(full_name) AS value FROM r_users WHERE is_active AND trim(full_name) <> '')
  SELECT "group", NULL::varchar AS document_id, value, value AS label FROM names
  UNION ALL SELECT d."group", d.id, d.coach, CASE WHEN trim(d.coach) = 'old-name' THEN 'Old Name' ELSE trim(d.coach) END FROM r_documents d
  WHERE d.coach <> '' AND NOT EXISTS (SELECT 1 FROM names n WHERE n."group" = d."group" AND n.value = d.coach)""", ("r_users", "r_documents"))
def _(r):
    return Q.person_choices(r.documents, r.users, "coach", Q.legacy_code_map())


_STATUS = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STATUS_LABELS.items()) + " ELSE status END"
_GROUP = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.GROUP_LABELS.items()) + " ELSE code END"


_MODE = "CASE cast(id AS bigint) % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'variables' WHEN 2 THEN 'locked' END"
_ROW = "CASE cast(id AS bigint) % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'done' ELSE 'other' END"


@query("label_lookup", f"""SELECT id, {_STATUS} AS status_label, {_GROUP} AS group_label, CASE coach WHEN 'old-name' THEN 'Old Name' ELSE coach END AS coach_label,
   CASE mode WHEN 'variables' THEN 'Certain text' WHEN 'locked' THEN 'Locked' ELSE '' END AS edit_mode_label, CASE row_status WHEN 'default' THEN 'Not started' WHEN 'done' THEN 'Done' ELSE '' END AS row_status_label
  FROM (SELECT *, lower(split_part(number, '-', 1)) AS code, {_MODE} AS mode, {_ROW} AS row_status FROM r_documents) q""", ("r_documents",))
def _(r):
    code = F.lower(F.split_part("number", F.lit("-"), F.lit(1)))
    return r.documents.select(
        "id", Q.lookup(F.col("status"), V.STATUS_LABELS).alias("status_label"), Q.lookup(code, V.GROUP_LABELS).alias("group_label"),
        Q.lookup(F.col("coach"), Q.legacy_code_map()).alias("coach_label"), Q.lookup(F.expr(_MODE), V.EDIT_MODE_LABELS, F.lit("")).alias("edit_mode_label"),
        Q.lookup(F.expr(_ROW), V.SUBSECTION_STATUS_LABELS, F.lit("")).alias("row_status_label"),
    )


@query("required_strings", r"""SELECT id, s AS missing FROM (SELECT id, body, unnest(string_split(required, '|')) AS s FROM r_subsections WHERE required <> '') q
  WHERE NOT contains(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), lower(trim(regexp_replace(s, '\s+', ' ', 'g'))))""", ("r_subsections",))
def _(r):
    needed = F.split("required", r"\|")
    rows = r.subsections.filter(F.col("required") != "")
    return rows.select("id", F.explode(Q.missing_required(needed, F.col("body"))).alias("missing"))


@query("hrefless_links", r"""SELECT doc_id, cast(nth - 1 AS int) AS nth, trim(regexp_extract(a, '>([^<]*)<', 1)) AS link_text FROM (
   SELECT doc_id, unnest(ms) AS a, generate_subscripts(ms, 1) AS nth FROM (SELECT doc_id, regexp_extract_all(html, '<a(?:\s[^>]*)?>[^<]*</a>') AS ms FROM r_raw_html) x) q
  WHERE trim(regexp_extract(a, '>([^<]*)<', 1)) <> '' AND NOT regexp_matches(regexp_extract(a, '^<a([^>]*)>', 1), '(?i)\s(href|id|name)\s*=')""", ("r_raw_html",))
def _(r):
    return Q.hrefless_links(r.raw_html, "doc_id", "html")
