"""Queries that cut raw pages into blocks, sections and subsections, and clean them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.operators import segment as S
from tomeflow.plans.registry import query
from tomeflow.plans.trees import _FLAG, _slug
from tomeflow.session import cut

RAW = ("r_raw_html",)


def _decoded(text: str) -> str:
    """Named character references replaced, the escaped ampersand last."""
    for name, char in V.ENTITIES.items():
        text = "replace({0}, '&{1};', '{2}')".format(text, name, char.replace("'", "''"))
    return f"replace({text}, '&amp;', '&')"


_ST = ", ".join(f"'{t}'" for t in S.STARTS)
_SC = ", ".join(f"'{t}'" for t in S.STARTS + S.CLOSES)
_HD = ", ".join(f"'{t}'" for t in S.HEADINGS)
_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

_TAG = "<(/?[a-zA-Z][a-zA-Z0-9]*)([^>]*)>([^<]*)"
TOK = rf"""hid AS (SELECT doc_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<![a-zA-Z][^>]*>', '', 'g') AS h FROM r_raw_html),
  mm AS (SELECT doc_id, unnest(ms) AS m, cast(generate_subscripts(ms, 1) - 1 AS int) AS pos FROM (SELECT doc_id, regexp_extract_all(h, '{_TAG}') AS ms FROM hid) q),
  tok AS (SELECT doc_id, pos, lower(regexp_extract(m, '{_TAG}', 1)) AS tag, regexp_extract(m, '{_TAG}', 2) AS attrs, {_decoded(f"regexp_extract(m, '{_TAG}', 3)")} AS text FROM mm
    UNION ALL SELECT doc_id, -1, '', '', {_decoded("regexp_extract(h, '^[^<]*')")} FROM hid WHERE regexp_matches(h, '^[^<]*[^<\s]'))"""
# the tree of tables from its definition: a stack of open tables, pushed and popped tag by tag
SEG = f"""{TOK}, tt AS (SELECT doc_id, pos, tag, row_number() OVER w AS k, sum(CASE WHEN tag = 'table' THEN 1 ELSE 0 END) OVER w AS nth FROM tok WHERE tag IN ('table', '/table') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  stk(doc_id, k, open) AS (SELECT DISTINCT doc_id, cast(0 AS bigint), cast([] AS bigint[]) FROM tok
    UNION ALL SELECT t.doc_id, t.k, CASE WHEN t.tag = 'table' THEN list_append(s.open, cast(t.nth AS bigint)) ELSE s.open[1:len(s.open) - 1] END FROM stk s JOIN tt t ON t.doc_id = s.doc_id AND t.k = s.k + 1),
  kt AS (SELECT *, count(*) FILTER (tag IN ('table', '/table')) OVER w AS k, sum(CASE WHEN tag IN ({_SC}) THEN 1 ELSE 0 END) OVER w AS seg FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  tree AS (SELECT t.*, cast(len(s.open) AS bigint) AS depth_t, CASE WHEN len(s.open) > 0 THEN s.open[len(s.open)] ELSE 0 END AS tbl FROM kt t JOIN stk s ON s.doc_id = t.doc_id AND s.k = t.k),
  run AS (SELECT *, count(*) FILTER (tag = 'tr') OVER w AS tr, count(*) FILTER (tag IN ('td', 'th')) OVER w AS cell FROM tree WINDOW w AS (PARTITION BY doc_id, tbl ORDER BY pos)),
  seg0 AS (SELECT doc_id, seg, min(pos) AS pos, min_by(tag, pos) AS tag, min_by(attrs, pos) AS attrs, min_by(depth_t, pos) AS depth_t, min_by(tbl, pos) AS tbl, min_by(tr, pos) AS tr, min_by(cell, pos) AS cell,
     {_SQ.format("string_agg(CASE WHEN tag = 'title' THEN '' ELSE text END, '' ORDER BY pos)")} AS text FROM run GROUP BY doc_id, seg),
  seg AS (SELECT * REPLACE (CASE WHEN tag LIKE '/%' OR seg = 0 THEN 'p' ELSE tag END AS tag, CASE WHEN tag LIKE '/%' OR seg = 0 THEN '' ELSE attrs END AS attrs) FROM seg0 WHERE (seg > 0 AND tag IN ({_ST})) OR ((seg = 0 OR tag LIKE '/%') AND text <> ''))"""
UNIT = f"""{SEG}, un0 AS (SELECT *, sum(CASE WHEN depth_t = 0 OR (tag = 'table' AND depth_t = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg) AS unit FROM seg),
  un AS (SELECT * FROM (SELECT doc_id, cast(unit AS bigint) AS unit, min_by(tag, seg) AS tag, min_by(attrs, seg) AS attrs, count(*) FILTER (tag = 'tr') AS nrows, count(*) FILTER (tag IN ('td', 'th')) AS ncells,
      bool_or(tag = 'img') AS has_img, coalesce(string_agg(text, ' ' ORDER BY seg) FILTER (text <> ''), '') AS text,
      coalesce(string_agg(text, ' ' ORDER BY seg) FILTER (text <> '' AND tag NOT IN ({_HD})), '') AS inner_text,
      min_by(text, seg) FILTER (tag IN ({_HD})) AS head_text, min_by(tag, seg) FILTER (tag IN ({_HD})) AS head_tag FROM un0 GROUP BY doc_id, unit) q
    WHERE text <> '' OR has_img OR tag IN ('hr', 'br')),
  u AS (SELECT *, tag = 'table' AND nrows = 1 AND ncells = 1 AS is_callout FROM un)"""
SECT = f"""{UNIT}, lv AS (SELECT *, CASE WHEN bool_or(tag = 'h1') OVER (PARTITION BY doc_id) THEN 'h1' ELSE 'h2' END AS level FROM u),
  sec AS (SELECT * FROM (SELECT *, tag = level AS is_section, cast(sum(CASE WHEN tag = level THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY unit) AS bigint) AS section FROM lv) q WHERE section > 0)"""
_KEY = "CASE lower({0}) WHEN 'key facts' THEN 'Key facts' WHEN 'key dates' THEN 'Key dates' END"
SUBS = f"""{SECT}, kc AS (SELECT *, CASE WHEN tag IN ({_HD}, 'p') AND lead(is_callout) OVER (PARTITION BY doc_id, section ORDER BY unit) THEN {_KEY.format('text')} END AS key_title FROM sec WHERE NOT is_section),
  hd AS (SELECT *, (tag IN ('h3', 'h4', 'h5', 'h6') OR (tag = 'h2' AND level = 'h1') OR key_title IS NOT NULL) AS is_head FROM kc),
  op2 AS (SELECT *, is_head OR is_callout OR row_number() OVER w = 1 OR coalesce(lag(is_callout) OVER w, false) AS opens FROM hd WINDOW w AS (PARTITION BY doc_id, section ORDER BY unit)),
  od AS (SELECT *, cast(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY unit) AS bigint) AS ord FROM op2),
  fst AS (SELECT doc_id, section, ord, min_by(o, unit) AS f, coalesce(string_agg(CASE WHEN is_head THEN NULL WHEN is_callout THEN inner_text ELSE text END, chr(10) ORDER BY unit), '') AS body
     FROM (SELECT *, {{'is_head': is_head, 'is_callout': is_callout, 'tag': tag, 'text': text, 'head_text': head_text, 'head_tag': head_tag, 'key_title': key_title, 'attrs': attrs, 'level': level}} AS o FROM od) q GROUP BY doc_id, section, ord),
  subs AS (SELECT doc_id, section, ord AS "order", coalesce(CASE WHEN f.is_head THEN coalesce(f.key_title, f.text) WHEN f.is_callout THEN coalesce({_KEY.format('f.head_text')}, f.head_text) END, '') AS name,
     coalesce(CASE WHEN f.key_title IS NOT NULL OR (f.is_callout AND {_KEY.format('f.head_text')} IS NOT NULL) THEN 'h4'
       WHEN f.level = 'h1' THEN 'h' || (cast(substr(CASE WHEN f.is_head THEN f.tag WHEN f.is_callout THEN f.head_tag END, 2, 1) AS int) + 1) ELSE CASE WHEN f.is_head THEN f.tag WHEN f.is_callout THEN f.head_tag END END, '') AS tag,
     CASE WHEN f.is_head THEN regexp_extract(f.attrs, '\\bid="([^"]*)"', 1) ELSE '' END AS html_id, f.is_callout AS callout_box, body FROM fst)"""


def tokens(r):
    return S.html_tokens(r.raw_html)


def units(r):
    return S.units(S.blocks(tokens(r)))


def subsections(r):
    return S.assign_subsections(S.assign_sections(units(r)))


@query("html_blocks", f"""WITH RECURSIVE {SEG} SELECT doc_id, pos, tag, attrs, text, cast(sum(CASE WHEN tag LIKE '/%' THEN -1 WHEN tag IN ('', 'br', 'hr', 'img', 'meta', 'input', 'link') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS bigint) AS depth, depth_t, tbl, tr, cell FROM run""", RAW)
def _(r):
    return S.in_tables(S.with_depth(tokens(r)))


@query("drop_empty_blocks", f"WITH RECURSIVE {UNIT} SELECT doc_id, unit, tag, text, is_callout FROM u", RAW)
def _(r):
    return units(r).select("doc_id", "unit", "tag", "text", "is_callout")


@query("clean_headings", f"WITH RECURSIVE {UNIT} SELECT doc_id, unit, tag, text FROM u WHERE tag IN ({_HD})", RAW)
def _(r):
    return units(r).filter(F.col("tag").isin(S.HEADINGS)).select("doc_id", "unit", "tag", "text")


@query("heading_level", f"""WITH RECURSIVE {UNIT}, g AS (SELECT doc_id, min(unit) FILTER (tag = 'h1' AND text <> '') AS u1, min(unit) FILTER (tag = 'h2' AND text <> '') AS u2,
    min_by(text, unit) FILTER (tag = 'h1' AND text <> '') AS t1, min_by(text, unit) FILTER (tag = 'h2' AND text <> '') AS t2 FROM u GROUP BY doc_id)
  SELECT doc_id, CASE WHEN u1 IS NULL THEN 'h2' ELSE 'h1' END AS level, CASE WHEN u2 < u1 THEN 'Heading 2 "' || t2 || '" comes before the first Heading 1 "' || t1 || '".' END AS error FROM g""", RAW)
def _(r):
    return S.heading_level(units(r))


@query("assign_sections", f"""WITH RECURSIVE {SECT} SELECT doc_id, section AS "order", text AS name, regexp_extract(attrs, '\\bid="([^"]*)"', 1) AS html_id, ({_FLAG.replace('name', 'text')}) AS has_section_page FROM sec WHERE is_section""", RAW)
def _(r):
    return S.sections(S.assign_sections(units(r)))


@query("callout_tables", f"WITH RECURSIVE {UNIT} SELECT doc_id, unit, nrows, ncells, is_callout FROM u WHERE tag = 'table'", RAW)
def _(r):
    return units(r).filter("tag = 'table'").select("doc_id", "unit", F.col("rows").alias("nrows"), F.col("cells").alias("ncells"), "is_callout")


@query("key_callouts", f"WITH RECURSIVE {SUBS} SELECT doc_id, unit, key_title FROM kc WHERE key_title IS NOT NULL", RAW)
def _(r):
    s = S.assign_sections(units(r))
    return S.key_callouts(s.filter("NOT is_section")).filter("key_title IS NOT NULL").select("doc_id", "unit", "key_title")


@query("assign_subsections", f"WITH RECURSIVE {SUBS} SELECT * FROM subs", RAW)
def _(r):
    return subsections(r).withColumnRenamed("section", "section")


@query("merge_label_value", f"""WITH RECURSIVE {UNIT}, sc AS (SELECT *, max(unit) FILTER (tag = 'h3' AND lower(text) = 'funding details') OVER w AS f3, max(unit) FILTER (tag IN ('h1', 'h2', 'h3')) OVER w AS h3,
     max(unit) FILTER (tag = 'h4' AND lower(text) = 'funding details') OVER w AS f4, max(unit) FILTER (tag IN ('h1', 'h2', 'h3', 'h4')) OVER w AS h4 FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
  lb AS (SELECT *, tag = 'p' AND (coalesce(f3 = h3, false) OR coalesce(f4 = h4, false)) AS ins FROM sc),
  jn AS (SELECT *, ins AND text LIKE '%:' AND coalesce(lead(ins) OVER w AND NOT (lead(text) OVER w LIKE '%:'), false) AS joins, lead(text) OVER w AS nt FROM lb WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
  fin AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY unit), false) AS gone FROM jn)
  SELECT doc_id, unit, CASE WHEN joins THEN text || ' ' || nt ELSE text END AS text FROM fin WHERE NOT gone""", RAW)
def _(r):
    return S.merge_label_value(units(r)).select("doc_id", "unit", "text")


@query("drop_known_section", rf"""WITH RECURSIVE {UNIT}, b AS (SELECT a.doc_id, a.unit AS start, cast(substr(a.tag, 2, 1) AS int) AS lvl,
     (SELECT min(x.unit) FROM u x WHERE x.doc_id = a.doc_id AND x.unit > a.unit AND ((x.tag IN ({_HD}) AND x.tag <= a.tag) OR (x.tag = 'p' AND regexp_matches(x.text, '^\s*[^:\n]{{1,80}}:\s*\S*')))) AS stop
   FROM u a WHERE a.tag IN ({_HD}) AND lower(regexp_replace(a.text, '^[ :.\-]+|[ :.\-]+$', '', 'g')) = 'before you begin')
  SELECT doc_id, unit, text FROM u WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = u.doc_id AND u.unit >= b.start AND (b.stop IS NULL OR u.unit < b.stop))""", RAW)
def _(r):
    return S.drop_known_section(units(r)).select("doc_id", "unit", "text")


_INS = r"regexp_matches(lower(text), '^(instructions for (new )?\w+ (writers|(\w+ )?team)|.+-specific instructions)')"


@query("split_instructions", f"WITH RECURSIVE {UNIT} SELECT doc_id, unit, text FROM u WHERE is_callout AND {_INS}", RAW)
def _(r):
    return S.split_instructions(units(r))[1].select("doc_id", "unit", "text")


_TITLE = r"trim(regexp_replace(lower(text), '^instructions for new program team', ''))"
_NORM = r"lower(trim(regexp_replace(trim({0}), '\s*\(.*\)\s*$', '')))"


@query("attach_instructions", f"""WITH RECURSIVE {SUBS}, ins AS (SELECT doc_id, unit, text AS instructions, {_NORM.format(_TITLE)} AS norm FROM u WHERE is_callout AND {_INS}),
  met AS (SELECT i.doc_id, i.unit, s.section, s."order", i.instructions, row_number() OVER (PARTITION BY i.doc_id, i.unit ORDER BY s.section, s."order") AS rn FROM ins i JOIN subs s ON s.doc_id = i.doc_id
     AND ((s.name <> '' AND {_NORM.format('s.name')} = i.norm) OR (s.name = '' AND i.norm <> '' AND starts_with(lower(trim(s.body)), i.norm))))
  SELECT doc_id, section, "order", min_by(instructions, unit) AS instructions FROM met WHERE rn = 1 GROUP BY doc_id, section, "order" """, RAW)
def _(r):
    found = cut(S.instructed(units(r)))  # pages are cut into units once, for both sides
    ins = S.split_instructions(found)[1].select("doc_id", "unit", F.col("text").alias("instructions"), F.expr(_TITLE.replace("\\", "\\\\")).alias("title"))
    return S.attach_instructions(S.assign_subsections(S.assign_sections(found)), ins)


@query("detect_endnotes", f"""WITH RECURSIVE {SEG}, x AS (SELECT *, CASE WHEN lead(tag) OVER w = 'li' THEN lead(attrs) OVER w END AS li FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg)),
  g AS (SELECT doc_id, bool_or(tag IN ('h1', 'h2') AND text = 'Endnotes') AS has, max(pos) FILTER (tag = 'hr') AS hp, max_by(attrs, pos) FILTER (tag = 'hr') AS ha,
     max(pos) FILTER (tag = 'ol') AS op, max_by(coalesce(li, ''), pos) FILTER (tag = 'ol') AS oa FROM x GROUP BY doc_id),
  k AS (SELECT *, CASE WHEN hp IS NOT NULL AND NOT contains(ha, 'style=') THEN 'rule' WHEN regexp_matches(oa, '\\bid="(footnote|endnote)') THEN 'list' END AS kind FROM g WHERE NOT has)
  SELECT doc_id, kind, CASE WHEN kind = 'rule' THEN hp ELSE op END AS pos FROM k WHERE kind IS NOT NULL""", RAW)
def _(r):
    return S.detect_endnotes(tokens(r))


@query("table_captions", f"""WITH RECURSIVE {UNIT} SELECT doc_id, unit, before AS caption FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY unit) AS before FROM u) q WHERE tag = 'table' AND starts_with(lower(before), 'table: ')""", RAW)
def _(r):
    return S.table_captions(units(r))


CELLS = f"""{SEG}, cg AS (SELECT doc_id, tbl, cell, min_by(tag, seg) AS tag, min_by(attrs, seg) AS attrs, min(tr) AS tr, trim(string_agg(text, ' ' ORDER BY seg)) AS text FROM seg WHERE tbl > 0 AND cell > 0 AND tag NOT IN ('tr', 'table') GROUP BY doc_id, tbl, cell),
  cells AS (SELECT *, cast(dense_rank() OVER (PARTITION BY doc_id, tbl ORDER BY tr) AS int) AS "row" FROM cg)"""


def cells(r):
    return S.table_cells(S.blocks(tokens(r)))


@query("table_header_fix", f"""WITH RECURSIVE {CELLS}, fx AS (SELECT doc_id, tbl, cell, "row", text, CASE WHEN bool_or(regexp_matches(attrs, 'rowspan="(0|[2-9]|[0-9][0-9]+)"')) OVER w THEN tag WHEN "row" = 1 THEN 'th' WHEN bool_and(tag = 'th') OVER w AND max("row") OVER w > 1 THEN 'td' ELSE tag END AS new_tag
  FROM cells WINDOW w AS (PARTITION BY doc_id, tbl)), c AS (SELECT *, count(*) FILTER (new_tag = 'th') OVER (PARTITION BY doc_id, tbl, "row") AS n FROM fx)
  SELECT doc_id, tbl, cell, "row", text, new_tag, CASE WHEN new_tag <> 'th' THEN NULL WHEN n = 4 THEN 'w-25' WHEN n = 5 THEN 'w-20' WHEN n <> 3 THEN '' WHEN lower(text) = 'component' THEN 'w-45'
    WHEN starts_with(lower(text), 'how to upload') OR starts_with(lower(text), 'how to submit') THEN 'w-40' WHEN contains(lower(text), 'page limit') THEN 'w-15' ELSE 'w-33' END AS width FROM c""", RAW)
def _(r):
    return S.header_widths(S.table_header_fix(cells(r))).select("doc_id", "tbl", "cell", "row", "text", "new_tag", "width")


@query("table_shape", rf"""WITH RECURSIVE {CELLS}, w AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM cells), br AS (SELECT doc_id, tbl, "row", count(*) AS cols, sum(CASE WHEN tag = 'th' THEN 0 ELSE n END) AS words, sum(n) AS aw,
    bool_or(tag = 'th' AND text = 'Recommended For') AS rec, bool_or(tag = 'th' AND text = 'Criterion') AS cri FROM w GROUP BY ALL),
  g AS (SELECT doc_id, tbl, max(cols) FILTER ("row" = 1) AS columns, count(*) AS rows, cast(sum(words) AS bigint) AS words, count(*) FILTER (aw = 0) AS empty_rows, bool_or(rec) AS rec, bool_or(cri) AS cri FROM br GROUP BY ALL)
  SELECT doc_id, tbl, columns, rows, words, empty_rows, CASE WHEN rec THEN 'large' WHEN cri THEN 'criterion' WHEN words = 0 AND columns < 4 THEN 'small' WHEN words > 120 OR columns >= 3 THEN 'large' ELSE 'small' END AS size FROM g""", RAW)
def _(r):
    return S.table_shape(cells(r))


@query("missing_alt_text", rf"""WITH {TOK} SELECT doc_id, pos, regexp_extract(attrs, '\bsrc="([^"]*)"', 1) AS src, replace({_decoded("regexp_extract(attrs, '\\balt=" + '"([^"]*)"' + "', 1)")}, chr(10) || chr(10), chr(10)) AS alt, NOT regexp_matches(attrs, '(?i)\balt\s*=') AS missing FROM tok WHERE tag = 'img'""", RAW)
def _(r):
    return S.missing_alt_text(S.html_tokens(r.raw_html, spread=False))


@query("inline_image_paths", rf"""WITH {TOK}, i AS (SELECT t.doc_id, pos, regexp_extract(attrs, '\bsrc="([^"]*)"', 1) AS src, d.number FROM tok t JOIN r_documents d ON d.id = t.doc_id WHERE t.tag = 'img' AND d.number <> '')
  SELECT doc_id, pos, src, '/static/img/inline/' || lower(number) || '/' || regexp_extract(src, '([^/]*)$', 1) AS new_src FROM i WHERE NOT starts_with(src, 'data:')""", ("r_raw_html", "r_documents"))
def _(r):
    return S.inline_image_paths(S.html_tokens(r.raw_html, spread=False), r.documents.withColumnRenamed("id", "doc_id"))


@query("unwrap_tracking_urls", rf"""WITH {TOK}, a AS (SELECT doc_id, pos, regexp_extract(attrs, '\bhref="([^"]*)"', 1) AS href FROM tok WHERE tag = 'a')
  SELECT doc_id, pos, CASE WHEN starts_with(href, 'https://www.google.com/url?') AND contains(href, 'q=') THEN url_decode(regexp_extract(href, '[?&]q=([^&]*)', 1)) ELSE href END AS url FROM a""", RAW)
def _(r):
    return S.anchors(S.html_tokens(r.raw_html, spread=False)).select("doc_id", "pos", S.unwrap_tracking(F.col("href")).alias("url"))


@query("merge_adjacent_links", rf"""WITH {TOK}, o AS (SELECT doc_id, pos, attrs, regexp_extract(attrs, '\bhref="([^"]*)"', 1) AS href, regexp_extract(attrs, '\bid="([^"]*)"', 1) AS id FROM tok WHERE tag = 'a'),
  e AS (SELECT o.*, min(t.pos) AS stop FROM o LEFT JOIN tok t ON t.doc_id = o.doc_id AND t.tag = '/a' AND t.pos > o.pos AND NOT EXISTS (SELECT 1 FROM o n WHERE n.doc_id = o.doc_id AND n.pos > o.pos AND n.pos < t.pos) GROUP BY ALL),
  s AS (SELECT e.*, coalesce(b.tag = 'span' AND trim(b.text) = '' AND a.tag = '/span' AND trim(c.text) = '', false) AS wrapped, c.text AS t0, a.text AS t1, a.tag AS g1, d.tag AS g2, d.text AS t2, f.tag AS g3 FROM e
    LEFT JOIN tok b ON b.doc_id = e.doc_id AND b.pos = e.pos - 1 LEFT JOIN tok c ON c.doc_id = e.doc_id AND c.pos = stop LEFT JOIN tok a ON a.doc_id = e.doc_id AND a.pos = stop + 1
    LEFT JOIN tok d ON d.doc_id = e.doc_id AND d.pos = stop + 2 LEFT JOIN tok f ON f.doc_id = e.doc_id AND f.pos = stop + 3),
  el AS (SELECT doc_id, pos, href, id, CASE WHEN wrapped THEN pos - 1 ELSE pos END AS first, CASE WHEN wrapped THEN stop + 1 ELSE stop END AS last, CASE WHEN wrapped THEN t1 ELSE t0 END AS after,
    CASE WHEN wrapped THEN CASE WHEN g3 = '/' || g2 THEN t2 END ELSE CASE WHEN g2 = '/' || g1 THEN t1 END END AS then_,
    coalesce((SELECT string_agg(t.text, '' ORDER BY t.pos) FROM tok t WHERE t.doc_id = s.doc_id AND t.pos >= s.pos AND t.pos < s.stop), '') AS text FROM s),
  f AS (SELECT *, coalesce(trim(lag(after) OVER w) = '' AND lag(last) OVER w + 1 = first AND href = lag(href) OVER w AND (href <> '' OR (id <> '' AND id = lag(id) OVER w)), false) AS joins, lag(after) OVER w AS gap FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f)
  SELECT doc_id, min(pos) AS pos, min(href) AS href, min_by(id, pos) AS id, count(*) AS links, string_agg((CASE WHEN joins AND gap <> '' THEN ' ' ELSE '' END) || text, '' ORDER BY pos) AS text,
    max_by(coalesce(after <> '' AND trim(after) = '' AND regexp_matches(then_, '^[.,;!?]'), false), pos) AS drops_space FROM r WHERE href <> '' OR id <> '' GROUP BY doc_id, run""", RAW)
def _(r):
    return S.merge_adjacent_links(tokens(r))


_BOXES = "'table', 'tr', 'ul', 'ol', '/table', '/tr', '/ul', '/ol'"


@query("resolve_anchors", rf"""WITH RECURSIVE {SEG}, b AS (SELECT r.*, regexp_extract(attrs, '\b(?:id|name)="([^"]*)"', 1) AS id, coalesce(tag = 'a' AND trim(text) = '' AND lead(tag) OVER (PARTITION BY doc_id ORDER BY pos) = '/a' AND regexp_extract(attrs, '\bhref="([^"]*)"', 1) = '', false) AS e FROM run r),
  bl AS (SELECT doc_id, seg, min(pos) AS p, min_by(tag, pos) AS tag, bool_or(trim(text) <> '') AS filled FROM run GROUP BY doc_id, seg),
  n AS (SELECT b.doc_id, b.id, b.pos, b.e, CASE WHEN b.e THEN coalesce((SELECT min(x.p) FROM bl x WHERE x.doc_id = b.doc_id AND x.seg >= b.seg AND (x.tag IN ({_HD}) OR (x.filled AND x.tag NOT IN ({_BOXES})))), (SELECT x.p FROM bl x WHERE x.doc_id = b.doc_id AND x.seg = b.seg)) ELSE b.pos END AS target_pos FROM b WHERE b.id <> ''),
  m AS (SELECT *, last_value(id) OVER (PARTITION BY doc_id, target_pos ORDER BY e, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS new_id FROM n),
  ids AS (SELECT doc_id, id, min_by(target_pos, pos) AS target_pos, min_by(new_id, pos) AS new_id FROM m GROUP BY doc_id, id),
  l AS (SELECT doc_id, pos, regexp_extract(attrs, '\bhref="([^"]*)"', 1) AS href FROM tok WHERE tag = 'a')
  SELECT l.doc_id, l.pos, l.href, i.target_pos, CASE WHEN i.id IS NULL THEN '#__' || substr(l.href, 2) ELSE '#' || i.new_id END AS new_href
  FROM l LEFT JOIN ids i ON i.doc_id = l.doc_id AND i.id = substr(l.href, 2) WHERE l.href LIKE '#%'""", RAW)
def _(r):
    return S.resolve_anchors(tokens(r))


@query("bold_classes", rf"""WITH {TOK}, css AS (SELECT doc_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1), ' '), '\.[a-zA-Z0-9_-]+\{{[^}}]*\}}')) AS rule FROM r_raw_html),
  bc AS (SELECT DISTINCT doc_id, regexp_extract(rule, '^\.([a-zA-Z0-9_-]+)', 1) AS class FROM css WHERE regexp_matches(rule, 'font-weight:\s*700') AND NOT coalesce(try_cast(regexp_extract(rule, 'font-size:\s*([0-9]+)pt', 1) AS int) >= 18, false)),
  o AS (SELECT *, max(CASE WHEN tag IN ('table', 'thead', 'tbody') THEN pos END) OVER w AS op, max(CASE WHEN tag = 'tr' THEN pos END) OVER w AS r1, max(CASE WHEN tag = '/tr' THEN pos END) OVER w AS r0 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  n AS (SELECT *, sum(CASE WHEN tag = 'tr' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, op ORDER BY pos) AS nth FROM o)
  SELECT t.doc_id, t.pos, t.tag, b.class FROM (SELECT doc_id, pos, tag, unnest(string_split(regexp_extract(attrs, '\bclass="([^"]*)"', 1), ' ')) AS class FROM n
    WHERE NOT coalesce(r1 > coalesce(r0, -1) AND r1 > op AND nth = 1, false)) t JOIN bc b ON b.doc_id = t.doc_id AND b.class = t.class""", RAW)
def _(r):
    return S.bold_elements(r.raw_html, tokens(r)).select("doc_id", "pos", "tag", "class")


def _meta(field: str, label: str) -> str:
    rest = f"trim(substr(text, {len(label) + 1}))"
    if field == "opdiv":
        isl = r"regexp_matches({0}, '^\s*[^:\n]{{1,80}}:\s*\S*')".replace("{{", "{").replace("}}", "}")
        rest = f"CASE WHEN {rest} <> '' THEN {rest} WHEN NOT {isl.replace('{0}', 'n1')} AND upper(n1) NOT IN ('N/A', 'NA', 'NONE', 'TBD', 'UNKNOWN') AND {isl.replace('{0}', 'n2')} THEN n1 ELSE '' END"
    return f"coalesce(min_by({rest}, seg) FILTER (starts_with(lower(text), '{label}')), '') AS {field}"


@query("extract_metadata", f"""WITH RECURSIVE {SEG}, x AS (SELECT *, CASE WHEN tag = 'p' AND lead(tag) OVER w = 'p' THEN lead(text) OVER w END AS n1, CASE WHEN tag = 'p' AND lead(tag, 2) OVER w = 'p' THEN lead(text, 2) OVER w END AS n2 FROM seg WHERE text <> '' OR tag <> 'p' WINDOW w AS (PARTITION BY doc_id, tbl, cell ORDER BY seg))
  SELECT doc_id, {', '.join(_meta(f, l) for f, l in V.METADATA_TEXTS.items())} FROM x GROUP BY doc_id""", RAW)
def _(r):
    return S.extract_metadata(S.blocks(tokens(r)))


_THEME = r"""CASE WHEN contains(o, 'national institutes of health') OR regexp_matches(o, '\bnih\b') THEN 'portrait-nih-white' WHEN contains(o, 'health resources and services administration') OR regexp_matches(o, '\bhrsa\b') THEN 'portrait-hrsa-white'
  WHEN contains(n, 'cdc-') THEN 'portrait-cdc-blue' WHEN contains(n, 'acf-') THEN 'portrait-acf-white' WHEN contains(n, 'acl-') THEN 'portrait-acl-white' WHEN contains(n, 'cms-') THEN 'portrait-cms-white' WHEN contains(n, 'ihs-') THEN 'portrait-ihs-white'
  WHEN regexp_matches(n, '(?:^|-)hrsa-') THEN 'portrait-hrsa-white' WHEN contains(n, 'rfa-') THEN 'portrait-cdc-blue' ELSE 'portrait-nih-white' END"""


_TITLED = "CASE WHEN cast(id AS bigint) % 5 = 1 THEN concat(title, ' PEPFAR') ELSE title END"
_COVERS = "concat('img/cover-img/', lower(number), '.jpg')"


@query("classify_document", f"""SELECT id, theme, coalesce((SELECT max(i.key) FROM covers i WHERE i.key = own), CASE WHEN contains(lower(title), 'pepfar') THEN 'img/cover-img/cdc-pepfar.jpg' ELSE '' END) AS cover_image, CASE WHEN regexp_matches(theme, 'acf-|acl-|hrsa-|nih-') THEN 'text' ELSE 'medium' END AS cover, CASE WHEN "group" = 'household' THEN 'era' ELSE 'full' END AS before_you_begin
  FROM (SELECT id, "group", title, own, {_THEME} AS theme FROM (SELECT id, "group", {_TITLED} AS title, {_COVERS} AS own, lower(number) AS n, lower(opdiv) AS o FROM r_documents) a) b""".replace("covers i", "(SELECT {_COVERS} AS key FROM r_documents WHERE cast(id AS bigint) % 3 = 0) i".replace("{_COVERS}", _COVERS)), ("r_documents",))
def _(r):
    docs = r.documents.withColumn("title", F.expr(_TITLED))
    covers = r.documents.filter("cast(id AS bigint) % 3 = 0").select(F.expr(_COVERS).alias("key"))
    out = S.classify_document(docs, covers, "household")
    return out.select("id", F.col("new_theme").alias("theme"), F.col("new_cover").alias("cover"), "before_you_begin", F.col("new_cover_image").alias("cover_image"))


@query("build_rows", rf"""SELECT id, contains(lower(instructions), 'section is only required if') AS optional,
  CASE WHEN regexp_matches(body, '\{{[^{{}}]*[^\s{{}}][^{{}}]*\}}') THEN 'variables' WHEN contains(lower(instructions), 'section is only required if') OR contains(lower(body), 'insert') OR contains(lower(instructions), 'insert') THEN 'full' ELSE 'locked' END AS edit_mode,
  CASE WHEN html_id = '' AND name <> '' THEN concat_ws('--', cast("order" AS string), {_slug('section_name')}, {_slug('name')}) ELSE html_id END AS html_id FROM r_tree""", ("r_tree",))
def _(r):
    return S.build_rows(r.tree).select("id", "optional", "edit_mode", "html_id")


_INDENT = "CASE WHEN turn % 5 <> 4 THEN cast(length(text) % 4 AS int) * 360 END"


@query("checklist_children", f"""WITH x AS (SELECT conv_id, turn AS pos, {_INDENT} AS indent FROM conversations), b AS (SELECT *, min(indent) OVER (PARTITION BY conv_id ORDER BY pos) AS base, lag(indent) OVER (PARTITION BY conv_id ORDER BY pos) AS pi FROM x),
  d AS (SELECT *, coalesce(indent > base, false) AS deep, coalesce(pi < indent, false) AS starts FROM b), i AS (SELECT *, sum(CASE WHEN deep THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS isl FROM d)
  SELECT conv_id, pos, deep AND bool_or(deep AND starts) OVER (PARTITION BY conv_id, isl ORDER BY pos) AS is_child FROM i""")
def _(r):
    rows = r.table("conversations").selectExpr("conv_id", "turn AS pos", f"{_INDENT} AS indent")
    return S.checklist_children(rows, ["conv_id"]).select("conv_id", "pos", "is_child")


@query("sublist_rows", rf"""WITH RECURSIVE {CELLS}, f AS (SELECT doc_id, tbl, "row", min_by(text, cell) AS text FROM cells GROUP BY ALL),
  h AS (SELECT *, starts_with(lower(text), 'other required forms') OR lower(text) IN ('attachments', 'narratives', 'forms') AS hd, regexp_matches(trim(replace(text, '◻', '')) || ' ', '^\d+(\s?(-|—|to|through)\s?\d+)?\.\s') AS nm FROM f)
  SELECT doc_id, tbl, "row", text, hd AS is_heading, nm AS is_numbered, coalesce(lag(hd) OVER w, false) AS under_heading, coalesce(lead(hd) OVER w OR (nm AND NOT lead(nm) OVER w), false) AS before_sublist FROM h WINDOW w AS (PARTITION BY doc_id, tbl ORDER BY "row")""", RAW)
def _(r):
    return S.sublist_rows(cells(r))
