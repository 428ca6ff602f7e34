"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeflow import fixed_values as V
from tomeflow.functions import text as X
from tomeflow.operators import search as S
from tomeflow.plans.registry import query
from tomeflow.plans.trees import _slug

SUB, DOC, TREE = ("r_subsections",), ("r_documents",), ("r_tree",)
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("clean_string", f"SELECT conv_id, turn, {_SQUEEZE.format('text')} AS clean FROM conversations")
def _(r):
    return r.table("conversations").select("conv_id", "turn", X.squeeze(F.col("text")).alias("clean"))


@query("sanitize_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '\p{C}', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def _(r):
    return S.sanitize_text(r.table("documents").select("doc_id", "text"), "text", "clean").select("doc_id", "clean")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query("is_metadata_label", rf"""SELECT doc_id, regexp_matches(trim(regexp_replace(line, '\s+', ' ', 'g')), '^\s*[^:\n]{{1,80}}:\s*\S*') AS is_label,
   upper(trim(line)) IN ('N/A', 'NA', 'NONE', 'TBD', 'UNKNOWN') AS is_placeholder, line FROM ({_LINES}) q""")
def _(r):
    lines = r.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    c = F.col("line")
    return lines.select("doc_id", X.looks_like_label(c).alias("is_label"), X.is_placeholder_acronym(c).alias("is_placeholder"), "line")


@query("slug", f"SELECT id, {_slug('section_name')} AS section_slug, {_slug('name')} AS slug FROM r_tree", TREE)
def _(r):
    return r.tree.select("id", X.slug(F.col("section_name")).alias("section_slug"), X.slug(F.col("name")).alias("slug"))


@query("strip_md_links", r"SELECT id, regexp_replace(body, '\]\([^)]*\)', ']', 'g') AS text FROM r_subsections", SUB)
def _(r):
    return r.subsections.select("id", X.strip_md_links(F.col("body")).alias("text"))


def _snippets(source: str, term: str) -> str:
    """Snippets by positions: cut the text at each match, add up lengths, group by gaps."""
    n = len(term)
    return f"""parts AS (SELECT *, unnest(string_split(lower(body), '{term}')) AS part, generate_subscripts(string_split(lower(body), '{term}'), 1) AS k FROM {source}),
  ends AS (SELECT *, cast(sum(length(part) + {n}) OVER (PARTITION BY pid ORDER BY k) AS bigint) AS e, count(*) OVER (PARTITION BY pid) AS cnt FROM parts),
  hits AS (SELECT *, e - {n} AS s, e - {n} - lag(e) OVER (PARTITION BY pid ORDER BY k) AS gap FROM ends WHERE k < cnt),
  grp AS (SELECT *, sum(CASE WHEN gap < 200 THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY k) AS g FROM hits),
  snips AS (SELECT pid, any_value(body) AS body, cast(g AS bigint) AS g, greatest(min(s) - 100, 0) AS a, least(max(e) + 100, length(any_value(body))) AS b FROM grp GROUP BY pid, g),
  snippet AS (SELECT pid, g, (CASE WHEN a > 0 THEN '…' ELSE '' END) || regexp_replace(substr(body, a + 1, b - a), '({term})', '<strong><mark class="bg-yellow">\\1</mark></strong>', 'gi')
     || (CASE WHEN b < length(body) THEN '…' ELSE '' END) AS text FROM snips)"""


@query("match_context", f"""WITH src AS (SELECT doc_id AS pid, text AS body FROM documents WHERE contains(lower(text), 'there')), {_snippets('src', 'there')}
  SELECT pid AS doc_id, g AS nth, text AS snippet FROM snippet""")
def _(r):
    docs = r.table("documents").filter(F.lower("text").contains("there"))
    rows = docs.select("doc_id", F.posexplode(X.match_context(F.col("text"), "there")).alias("i", "snippet"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("nth"), "snippet")


@query("find_text", f"""WITH src AS (SELECT id AS pid, id, regexp_replace(body, '\\]\\([^)]*\\)', ']', 'g') AS body, name FROM r_tree
     WHERE NOT (lower(name) = 'basic information' AND "order" = 1 AND section_order = 1)), {_snippets('src', 'program')},
   b AS (SELECT pid, string_agg('<div>' || text || '</div>', '' ORDER BY g) AS body_matches FROM snippet GROUP BY pid)
  SELECT s.id, b.body_matches, CASE WHEN contains(lower(s.name), 'program') THEN '<span>' || regexp_replace(s.name, '(program)', '<strong><mark class="bg-yellow">\\1</mark></strong>', 'gi') || '</span>' END AS name_matches
  FROM src s LEFT JOIN b ON b.pid = s.pid WHERE b.pid IS NOT NULL OR contains(lower(s.name), 'program')""", TREE)
def _(r):
    return S.find_text(r.tree, "program", include_name=True).select("id", "body_matches", "name_matches")


@query("replace_text", r"""WITH new AS (SELECT id, body, name,
    replace(regexp_replace(regexp_replace(body, '(\]\([^)]*)page', '\1' || chr(1), 'g'), 'page', 'leaf', 'gi'), chr(1), 'page') AS new_body,
    regexp_replace(name, 'page', 'leaf', 'gi') AS new_name FROM r_tree WHERE section_order % 2 = 1)
  SELECT id, new_body, new_name FROM new WHERE new_body <> body OR new_name <> name""", TREE)
def _(r):
    chosen = r.tree.filter("section_order % 2 = 1").select("id")
    return S.replace_in_subsections(r.subsections, chosen, "Page", "leaf", include_name=True).select("id", "new_body", "new_name")


@query("page_break_edit", rf"""WITH src AS (SELECT id AS pid, html_class, regexp_replace(body, '\]\([^)]*\)', ']', 'g') AS body FROM r_subsections), {_snippets('src', 'page-break')},
  con AS (SELECT pid, string_agg('<p>' || text || '</p>', '' ORDER BY g) AS found FROM snippet GROUP BY pid)
  SELECT id, array_to_string([c for c in string_split(s.html_class, ' ') if c <> '' AND NOT starts_with(c, 'page-break')], ' ') AS html_class, replace(s.body, 'page-break', '') AS body,
   CASE WHEN NOT regexp_matches(s.html_class, '(^| )page-break') AND con.found IS NULL THEN '<p><em>Page break found in CSS classes or other locations</em></p>'
     ELSE (CASE WHEN regexp_matches(s.html_class, '(^| )page-break') THEN '<strong><mark class="bg-yellow">Page break at top of section found.</mark></strong>' ELSE '' END) || coalesce(con.found, '') END AS context
  FROM r_subsections s LEFT JOIN con ON con.pid = s.id""", SUB)
def _(r):
    classes, body = X.remove_page_breaks(F.col("html_class"), F.col("body"))
    context = X.page_break_context(F.col("body"), F.col("html_class"))
    return r.subsections.select("id", classes.alias("html_class"), body.alias("body"), context.alias("context"))


@query("mark_modified", r"""SELECT id, new_body FROM (SELECT id, body, regexp_replace(regexp_replace(body, 'Announcement version:\s*(?:New|Initial)', 'Announcement version: Modified', 'gi'),
    'Announcement type:\s*(?:New|Initial)', 'Announcement type: Modified', 'gi') AS new_body FROM r_subsections) q WHERE new_body <> body""", SUB)
def _(r):
    return S.mark_modified(r.subsections).select("id", "new_body")


@query("split_step_name", """SELECT id, CASE WHEN lower(name) LIKE 'step%' AND contains(name, ':') THEN split_part(split_part(name, ':', 1), ' ', 2) END AS number,
  CASE WHEN lower(name) LIKE 'step%' AND contains(name, ':') THEN split_part(name, ':', 2) ELSE name END AS title FROM r_sections""", ("r_sections",))
def _(r):
    number, title = X.step_parts(F.col("name"))
    return r.sections.select("id", number.alias("number"), title.alias("title"))


_ITEM = "concat(cast({0} AS string), CASE {0} % 5 WHEN 0 THEN '. ' WHEN 1 THEN '-15. ' WHEN 2 THEN ' through 99. ' WHEN 3 THEN '.' ELSE '—50. ' END, p_name)"


@query("numbered_item", rf"""SELECT p_partkey, regexp_matches({_ITEM.format('p_partkey')}, '^\d+(\s?(-|—|to|through)\s?\d+)?\.\s') AS numbered FROM part""")
def _(r):
    return r.table("part").select("p_partkey", X.is_numbered_item(F.expr(_ITEM.format("p_partkey"))).alias("numbered"))


_NOTE = "CASE p_partkey % 4 WHEN 0 THEN '↑' WHEN 1 THEN concat('[', cast(p_size AS string), ']') WHEN 2 THEN p_name ELSE concat(' [', cast(p_size AS string), '] ') END"
_HREF = "CASE p_partkey % 5 WHEN 0 THEN '#ref1' WHEN 1 THEN '#ftnt_ref2' WHEN 2 THEN '#footnote-3' WHEN 3 THEN '#endnote-ref-4' ELSE '/x' END"


@query("footnote_links", rf"""SELECT p_partkey, is_ref, kind, CASE WHEN starts_with(h, '#ftnt_') THEN 'ftnt' ELSE 'ftnt_ref' END || regexp_extract(trim(t), '^.(.*).$', 1) AS new_id,
  CASE WHEN starts_with(h, '#ftnt_') THEN h ELSE '#ftnt' || regexp_extract(trim(t), '^.(.*).$', 1) END AS new_href FROM (
  SELECT p_partkey, t, h, trim(t) = '↑' OR regexp_matches(trim(t), '^\[\d+\]$') AS is_ref,
    CASE WHEN starts_with(h, '#ref') OR starts_with(h, '#ftnt') THEN 'html' WHEN starts_with(h, '#footnote') OR starts_with(h, '#endnote') THEN 'docx' END AS kind
  FROM (SELECT p_partkey, {_NOTE} AS t, {_HREF} AS h FROM part) a) b""")
def _(r):
    rows = r.table("part").selectExpr("p_partkey", f"{_NOTE} AS t", f"{_HREF} AS h")
    t, h = F.col("t"), F.col("h")
    new_id, new_href = X.footnote_id_href(t, h)
    return rows.select("p_partkey", X.is_footnote_ref(t).alias("is_ref"), X.footnote_kind(h).alias("kind"), new_id.alias("new_id"), new_href.alias("new_href"))


_LONG = "concat(CASE WHEN p_partkey % 2 = 0 THEN cast(p_partkey AS string) ELSE 'x' END, '--', repeat(replace(p_name, ' ', '-'), 4))"


@query("truncate_ids", rf"""SELECT p_partkey, CASE WHEN regexp_matches(i, '^\d+--') THEN substr(i, 1, 40) ELSE i END AS id,
   concat('<p><a class="k" href="#', CASE WHEN regexp_matches(i, '^\d+--') THEN substr(i, 1, 40) ELSE i END, '">go</a></p>') AS html FROM (SELECT p_partkey, {_LONG} AS i FROM part) q""")
def _(r):
    rows = r.table("part").selectExpr("p_partkey", f"{_LONG} AS i")
    html = F.concat(F.lit('<p><a class="k" href="#'), "i", F.lit('">go</a></p>'))
    return rows.select("p_partkey", X.truncate_id(F.col("i")).alias("id"), X.truncate_anchor_links(html).alias("html"))


@query("split_labels", """SELECT id, array_to_string([trim(x) for x in string_split(required, '|')], '/') AS parts, trim(string_split(required, '|')[1]) AS first_part FROM r_subsections""", SUB)
def _(r):
    parts = X.split_labels(F.col("required"))
    return r.subsections.select("id", F.array_join(parts, "/").alias("parts"), F.get(parts, F.lit(0)).alias("first_part"))


@query("strip_markup", r"""SELECT doc_id, regexp_replace(html, '</?(br\s*/?|ins|del)>', '', 'gi') AS plain,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\s{2,}|\n+', ' ', 'g'), '\s([<>"])', '\1', 'g'), '="\s', '="', 'g'), '([<>])\s', '\1', 'g') AS tight FROM r_raw_html""", ("r_raw_html",))
def _(r):
    c = F.col("html")
    return r.raw_html.select("doc_id", X.strip_break_marks(c).alias("plain"), X.strip_whitespace(c).alias("tight"))


@query("display_names", r"""SELECT id, CASE WHEN name <> '' THEN name ELSE concat('(#', cast("order" AS string), ')') END AS name_or_order,
  CASE WHEN name <> '' THEN name WHEN regexp_matches(w, '[.,;:!?]') THEN regexp_extract(w, '^(.*?)([.,;:!?]|$)', 1) ELSE w || '...' END AS name_or_placeholder FROM (
  SELECT *, array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '_(.*?)_', '\1', 'g'), '\s+', ' ', 'g')), ' ')[1:3], ' ') AS w FROM r_subsections) q""", SUB)
def _(r):
    order = F.concat(F.lit("(#"), "order", F.lit(")"))
    return r.subsections.select(
        "id", F.coalesce(F.nullif("name", F.lit("")), order).alias("name_or_order"),
        X.name_or_placeholder(F.col("name"), F.col("body")).alias("name_or_placeholder"),
    )


@query("date_display", """SELECT id, CASE WHEN cast(created AS date) <> DATE '2023-12-05' THEN strftime(created, '%b %-d') ELSE strftime(created, '%b %-d, %-I:%M %p') END AS created,
  CASE WHEN short_name <> '' THEN short_name ELSE title END AS shown_name FROM r_documents""", DOC)
def _(r):
    today = F.to_date(F.lit("2023-12-05"))
    shown = F.coalesce(F.nullif("short_name", F.lit("")), "title")
    return r.documents.select("id", X.date_display(F.col("created"), today).alias("created"), shown.alias("shown_name"))


@query("size_display", """SELECT key, CASE WHEN size < 1024 THEN concat(cast(size AS string), ' B') WHEN size < 1048576 THEN printf('%.1f KB', size / 1024)
  ELSE printf('%.1f MB', size / 1048576) END AS shown FROM r_images""", ("r_images",))
def _(r):
    return r.images.select("key", X.size_display(F.col("size")).alias("shown"))


@query("theme_parts", "SELECT id, split_part(theme, '-', 1) AS orientation, split_part(theme, '-', 2) AS owner, split_part(theme, '-', 3) AS colour FROM r_documents", DOC)
def _(r):
    a, b, c = X.theme_parts(F.col("theme"))
    return r.documents.select("id", a.alias("orientation"), b.alias("owner"), c.alias("colour"))


@query("safe_filename", r"""SELECT id, trim(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9!\-_.*''()]', '-', 'g'), '-+', '-', 'g'), '-') AS safe, regexp_replace(filename, '\.[^./]*$', '') AS stem
  FROM (SELECT id, filename, concat(' ', title, ' (', filename, ')@') AS name FROM r_documents) q""", DOC)
def _(r):
    name = F.concat(F.lit(" "), "title", F.lit(" ("), "filename", F.lit(")@"))
    return r.documents.select("id", X.safe_filename(name).alias("safe"), X.without_suffix(F.col("filename")).alias("stem"))


@query("cover_path", """SELECT id, CASE WHEN cover_image = '' THEN 'img/cover.jpg' WHEN starts_with(cover_image, 'http') THEN cover_image
  WHEN starts_with(cover_image, '/') THEN replace(replace(cover_image, '/static/', ''), '/img/', 'img/')
  WHEN NOT contains(cover_image, '/') THEN 'img/cover-img/' || cover_image ELSE cover_image END AS cover FROM r_documents""", DOC)
def _(r):
    return r.documents.select("id", X.cover_path(F.col("cover_image")).alias("cover"))


def _norm(c: str) -> str:
    return f"CASE WHEN trim({c}) = '' OR regexp_matches(trim({c}), '^\\{{[^{{}}]+\\}}$') THEN '' ELSE {c} END AS {c}"


@query("pdf_metadata_norm", f"SELECT id, {_norm('author')}, {_norm('subject')}, {_norm('keywords')} FROM r_documents", DOC)
def _(r):
    return r.documents.select("id", *[X.metadata_value(F.col(c)).alias(c) for c in ("author", "subject", "keywords")])


@query("normalize_chars", """SELECT doc_id, replace(replace(replace(replace(replace(html, '&nbsp;', ' '), chr(160), ' '), chr(9744), chr(9723)), chr(168), chr(9723)), chr(127), chr(9723)) AS html
  FROM (SELECT doc_id, replace(replace(html, ' ', '&nbsp;'), '#', chr(9744)) AS html FROM r_raw_html) q""", ("r_raw_html",))
def _(r):
    dirty = F.replace(F.replace("html", F.lit(" "), F.lit("&nbsp;")), F.lit("#"), F.lit("☐"))
    return r.raw_html.select("doc_id", X.normalize_chars(dirty).alias("html"))


_DEAD = "replace(html, '/The', 'https://www.cdc.gov/grants/dictionary/index.html')"


@query("rewrite_dead_links", "SELECT doc_id, replace(html, '/The', 'https://www.cdc.gov/grants/dictionary-of-terms/') AS html FROM r_raw_html", ("r_raw_html",))
def _(r):
    return r.raw_html.select("doc_id", X.rewrite_links(F.expr(_DEAD), V.DEAD_LINKS).alias("html"))


@query("emphasize_term", r"""SELECT doc_id, replace(replace(regexp_replace(html, '(de minimis)', '<em>\1</em>', 'gi'), '<em><em>', '<em>'), '</em></em>', '</em>') AS html FROM r_raw_html""", ("r_raw_html",))
def _(r):
    return r.raw_html.select("doc_id", X.emphasize(F.col("html"), "de minimis").alias("html"))
