"""Projections that give the given tables the roles of a document corpus.

Each text is plain SQL that Spark and DuckDB read alike, so both sides start from the same rows. Everything is
derived from columns of the tables; the only values made up here are labels chosen by a key's remainder.
"""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(key: str, choices: list[str]) -> str:
    """SQL choosing the n-th expression by ``key`` modulo the number of choices."""
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE ({key}) % {len(choices)} {arms} END"


def text(expr: str) -> str:
    return f"cast({expr} as string)"


STATUS_LIST = ["draft", "active", "ready-for-qa", "review", "doge", "published", "paused", "cancelled"]
STAFF_GROUP = "building"

DOCUMENTS = f"""
  {text("c_custkey")} AS id,
  'document' AS doc_kind,
  CASE WHEN c_custkey % 13 = 0 THEN ''
       WHEN c_custkey % 7 = 0 THEN concat('(COMPARE) ', repeat('Community health access ', cast(c_custkey % 9 as int)), c_name)
       ELSE concat(repeat('Rural care program ', cast(c_custkey % 15 as int)), c_name) END AS title,
  CASE WHEN c_custkey % 4 = 0 THEN concat('N', {text("c_custkey % 100")}) ELSE '' END AS short_name,
  CASE WHEN c_custkey % 17 = 0 THEN ''
       ELSE concat({pick("c_custkey", ["'CDC-RFA-'", "'HRSA-25-'", "'acf-'", "'NIH-'", "'X-'", "'acl 2024 '"])}, {text("c_custkey")}) END AS number,
  lower(c_mktsegment) AS "group",
  n_name AS opdiv,
  r_name AS agency,
  CASE WHEN c_custkey % 3 = 0 THEN concat('Office ', {text("n_regionkey")}) ELSE '' END AS subagency,
  CASE WHEN c_custkey % 5 = 0 THEN 'Branch 5' END AS subagency2,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('January ', {text("c_custkey % 28 + 1")}, ', 2025') END AS application_deadline,
  {pick("c_custkey", ["'three Years'", "''", "'the grant office'", "'cost   and'", "''"])} AS tagline,
  {pick("c_custkey", ["''", "'{Author}'", "c_name", "'  '", "c_name"])} AS author,
  {pick("c_custkey", ["''", "n_name", "'{Subject line}'", "n_name"])} AS subject,
  {pick("c_custkey", ["'health, rural'", "'{a}{b}'", "''"])} AS keywords,
  {pick("c_custkey", ["'portrait-cdc-blue'", "'portrait-hrsa-white'", "'landscape-cdc-white'", "'portrait-acf-white'"])} AS theme,
  {pick("c_custkey", ["''", "'/static/img/cover.jpg'", "'cover-two.png'", "'https://img.example.org/c.png'", "'img/cover/a.jpg'"])} AS cover_image,
  {pick("c_custkey", [lit(s) for s in STATUS_LIST])} AS status,
  CASE WHEN c_custkey % 11 = 0 THEN DATE '2024-03-01' END AS archived,
  CASE WHEN c_custkey % 9 = 4 THEN {text("c_custkey + 1")} END AS successor,
  CASE WHEN c_custkey % 10 = 3 THEN {text("c_custkey - 1")} END AS from_doc,
  CASE WHEN c_custkey % 5 = 2 THEN {text("c_custkey - 2")} END AS parent,
  CASE WHEN c_custkey % 12 = 5 THEN DATE '2024-02-10' END AS modifications,
  concat('file ', {text("c_custkey")}, '.v1.docx') AS filename,
  {pick("c_custkey", ["'first-coach'", "'old-name'", "''", "c_name"])} AS coach,
  TIMESTAMP '2023-11-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 5000) AS created,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (c_custkey * 37 % 40000) AS updated,
  {text("c_custkey % 120")} AS updated_by
"""

SECTION_NAMES = [
    "Step 1: Review the Opportunity", "Step 2: Get Ready to Apply", "Step 3: Prepare Your Application",
    "Step 4: Learn About Review and Award", "Step 5: Submit Your Application", "Step 6: Learn What Happens After Award",
    "Contacts and Support", "Appendix A: Forms", "Glossary", "Learn more", "Modifications", "",
]

SECTIONS = f"""
  {text("o_orderkey")} AS id,
  {text("o_custkey")} AS document_id,
  o_orderkey AS seq_key,
  {pick("o_orderkey", [lit(s) for s in SECTION_NAMES])} AS name,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat({text("o_orderkey % 9")}, '--part') END AS html_id,
  CASE WHEN o_orderkey % 6 = 0 THEN 'page-break wide' ELSE '' END AS html_class,
  (o_orderkey % 7 <> 0) AS has_section_page
"""

SUBSECTION_NAMES = [
    "Eligibility", "Program description", "Application checklist", "Basic information", "Funding details", "Key facts",
    "", "Cost sharing", "Other submissions", "Have questions?", "Summary", "Maintenance of effort", "",
]

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]

_FRAGMENTS = [
    "''",
    "'Applicants describe their proposed work. We review each application. '",
    f"concat('Read the [program guide](https://www.site', {text('l_suppkey % 50')}, '.example.org/page/', {text('l_partkey % 7')}, ') first. ')",
    f"concat('See [this part](#', {text('l_orderkey % 9')}, '--part) and [contacts](/contacts) for help. ')",
    "'Enter {Agency name} with {List: Item codes} and {Agency name}. '",
    "'<a href=\"#h.old\">old place</a> then page-break-before here. '",
    "concat('Announcement version: New', chr(10), 'Announcement type: Initial ')",
    "'The de minimis rate applies. Insert more text here. '",
    "'Questions? Write to us by email. '",
    f"concat('![chart](/media/img', {text('l_suppkey % 20')}, '.png) <a href=\"https://host', {text('l_partkey % 13')}, '.example.com/a?b=1\">host</a> ')",
    "'Grant GRANT grant: total  cost   and   match. '",
]
_TAILS = [
    "''",
    "'Keep records for three years. '",
    f"concat('<span id=\"', {text('l_partkey % 9')}, '--part\">x</span> ')",
    "'Contact the grant office at [mail](mailto:a@example.org). '",
    "''",
    "'It was reviewed by the team. '",
    f"concat('[folder](file://share/', {text('l_suppkey')}, ') page-break-after ')",
]

SUBSECTIONS = f"""
  {text("l_orderkey")} AS section_id,
  {pick("l_partkey", [lit(s) for s in SUBSECTION_NAMES])} AS name,
  CASE WHEN {pick("l_partkey", [lit(s) for s in SUBSECTION_NAMES])} = '' THEN ''
       ELSE concat('h', {text("3 + cast(l_quantity as int) % 5")}) END AS tag,
  CASE WHEN l_partkey % 3 = 0 THEN concat({text("l_partkey % 9")}, '--part') ELSE '' END AS html_id,
  {pick("l_suppkey", ["''", "'page-break-before'", "'custom-class'", "'page-break-after wide'", "''"])} AS html_class,
  (l_partkey % 8 = 0) AS callout_box,
  CASE WHEN (l_partkey + l_suppkey) % 4 = 0 THEN ''
       ELSE trim(concat({pick("l_partkey", _FRAGMENTS)}, {pick("l_suppkey", _TAILS)})) END AS body,
  {pick("l_suppkey", ["'full'", "'variables'", "'locked'"])} AS edit_mode,
  {pick("l_partkey", ["'default'", "'viewed'", "'done'"])} AS status,
  (l_suppkey % 4 = 1) AS optional,
  (l_suppkey % 9 = 2) AS hidden,
  {pick("l_suppkey", ["''", "'Include this part (YES)'", "'Leave this part (NO)'", "'This section is only required if asked (yes)'", "'Insert details'"])} AS instructions,
  {pick("l_suppkey", ["'body'", "'name'", "'diff_strings'", "'body'", "'none'"])} AS comparison_type,
  {pick("l_suppkey", ["''", "'Read  the|first.'", "'keep records|total cost'", "'grant'"])} AS required
"""

EVENTS = f"""
  event_id AS id,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS event_type,
  {pick("event_id", ["'document'", "'section'", "'subsection'", "'document'"])} AS model,
  {pick("event_id", [
      text("user_id * 10 + event_id % 10"),
      text("user_id * 100 + event_id % 100"),
      f"concat({text('user_id * 100 + event_id % 97')}, '-', {text('event_id % 6 + 1')})",
      text("user_id * 10 + event_id % 10"),
  ])} AS object_id,
  concat('Item ', {text("user_id % 40")}, CASE WHEN event_id % 3 = 0 THEN ' (document)' ELSE '' END) AS object_repr,
  CASE WHEN event_id % 4 = 2
       THEN concat('[{{"model": "app.subsection", "pk": ', {text("event_id")}, ', "fields": {{"section": "', {text("user_id * 100 + event_id % 97")}, '", "html_id": "h', {text("event_id % 12")}, '"}}}}]')
       ELSE concat('[{{"model": "app.item", "pk": ', {text("event_id")}, ', "fields": {{"html_id": ""}}}}]') END AS object_json_repr,
  {pick("event_id", [
      "'null'",
      "concat('{\"updated\": [\"a\", \"', " + text("event_id") + ", '\"]}')",
      "concat('{\"status\": [\"draft\", \"', CASE WHEN event_id % 2 = 0 THEN 'published' ELSE 'active' END, '\"], \"updated\": [\"a\", \"b\"]}')",
      "concat('{\"body\": [\"Old text', CASE WHEN event_id % 5 = 0 THEN '' ELSE ' here' END, '\", \"Old   text\"], \"updated\": [\"a\", \"b\"]}')",
      "concat('{\"action\": \"', " + pick("event_id", ["'doc_import'", "'doc_print'", "'doc_reimport'"]) + ", '\", \"updated\": [\"b\"], \"print_mode\": [\"', CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'test' END, '\"]}')",
      "''",
      "'{\"application_deadline\": [\"x\", \"y\"]}'",
      "'{}'",
      "'not json'",
      "'{\"hidden\": [\"False\", \"True\"], \"optional\": [\"False\", \"True\"]}'",
      "concat('{\"modifications\": [\"None\", \"2024-01-', " + text("10 + event_id % 9") + ", '\"]}')",
  ])} AS changed_fields,
  {text("user_id")} AS user_id,
  ts AS datetime
"""

USERS = f"""
  {text("s_suppkey")} AS id,
  concat('Person.', {text("s_suppkey")}, '@', n_name, '.Example.GOV') AS email,
  CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS full_name,
  {pick("s_suppkey", [lit(g) for g in ["building", "automobile", "machinery", "household", "furniture"]])} AS "group",
  (s_suppkey % 9 = 0) AS is_superuser,
  (s_suppkey % 4 = 1 OR s_suppkey % 18 = 0) AS is_opdiv_admin,
  (s_suppkey % 5 = 0) AS is_composer_admin,
  (s_suppkey % 7 <> 0) AS is_active,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('ext-', {text("s_suppkey")}) END AS external_id
"""

IMAGES = f"""
  concat('media/', {pick("p_partkey", ["'img'", "'Cover '", "'notes'"])}, {text("p_partkey")}, {pick("p_partkey", ["'.png'", "'.JPG'", "'.txt'", "'.jpeg'", "'.pdf'"])}) AS key,
  cast(p_size as bigint) * p_partkey * 97 AS size,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (p_partkey * 7919 % 100000) AS last_modified
"""

# Extra markup placed at the end of each page so that tables, callouts, anchors, images and notes occur too.
_ROW = "<tr><td>{}</td><td>{}</td></tr>"
_EXTRAS = [
    "'<h3 id=\"_Toc1\">Funding   details</h3><p>Type:</p><p>Grant</p><p>Total:</p><p>Match:</p><p>None</p><h3>Other</h3><p>Last:</p>'",
    "'<h2>Key facts</h2><p> </p><table><tr><td><p>Ask us</p></td></tr></table><p>after callout</p>'",
    "'<h2></h2><p><a id=\"_bm1\"></a>First  note</p><p>See <a href=\"#_bm1\">one</a><a href=\"#_bm1\"> more</a> and <a href=\"#gone\">gone</a> <a>loose</a></p>'",
    "'<h2>Before you begin</h2><p>skip me</p><h3>sub skip</h3><h2>Eligibility (all)</h2><p>Agency: Health Office</p>'",
    "'<p>Table: Budget by year</p><table><tr><td>Year</td><td>Cost</td></tr><tr><td>2024</td><td></td></tr><tr><td></td><td></td></tr></table>'",
    "'<table><tr><th>Criterion</th><th>Points</th><th>Note</th></tr><tr><th>Need</th><th>10</th><th>x</th></tr></table><p></p><p><img src=\"media/a/b.png\"></p>'",
    "'<img src=\"pics/c.jpg\" alt=\"\"><img src=\"data:image/png;base64,AA\" alt=\"one  two\"><hr><ol><li id=\"footnote-1\">note</li></ol>'",
    "'<table><tr><td><p>Instructions for new program team</p><p>Eligibility</p><p>(YES)</p></td></tr></table><h2>Eligibility</h2><p>Opdiv: Health</p><p>Number: HRSA-25-001</p>'",
    "'<p><a href=\"https://www.google.com/url?q=https://a.example.org/x%3Fy%3D1&sa=D\">t</a> the De Minimis rate <em>de minimis</em></p><h3><a id=\"_h2\"></a>Cost  sharing</h3><hr style=\"x\">'",
    "'<style>.c1{font-weight:700;font-size:11pt}.c2{font-weight:700;font-size:20pt}</style><p class=\"c1\">bold</p><p class=\"c2\">big</p><h2>Endnotes</h2><p>Key dates</p><table><tr><th>x</th></tr></table>'",
    "'<table><tr><td>Outer<table><tr><th>In <b>one</b></th><th>In two</th></tr><tr><td>3<table><tr><td>deep</td></tr></table></td><td>4</td></tr></table>after</td><td>Opportunity name: In a cell</td></tr><tr><td><p>Opdiv:</p><p>Health</p><p>Agency: Office</p></td></tr></table></table><p>end</p>'",
    "'<h1><strong>Endnotes</strong></h1><hr><p><a id=\"_n1\"></a><a id=\"_n2\"></a></p><h3 id=\"own\"><a id=\"_n3\"></a>Fees</h3><p><span><a href=\"#_n1\"><em>x</em></a></span> <a href=\"#_n1\">y</a> <b>, z</b> <a href=\"#own\">o</a><a id=\"t\">u</a><a id=\"t\">v</a></p><table><tr><th>Component</th><th>How to upload</th><th>Page limit</th></tr></table>'",
    "'<table><tr><td>Forms</td><td>Page</td></tr><tr><td>1. SF-424</td><td>2</td></tr><tr><td>2 through 3. Plan</td><td>1</td></tr><tr><td>Budget</td><td>9</td></tr></table>'",
]

RAW_HTML = f"""
  {text("page_id")} AS doc_id,
  concat({text("page_id")}, {pick("page_id", ["'.html'", "'.HTM'", "'.html'", "'.html'", "'.docx'", "'.pdf'"])}) AS filename,
  CASE WHEN page_id % 29 = 7 THEN concat('Only text, page ', {text("page_id")}) WHEN page_id % 29 = 11 THEN concat('Text before &amp; ', html)
       ELSE replace(html, '</article>', concat({pick("page_id", _EXTRAS)}, '</article>')) END AS html
"""
