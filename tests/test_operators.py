"""Small hand-made cases per operator, brute-force checks of the two sequential ones, and plan checks."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tomeflow.functions import links, markup
from tomeflow.functions import text as X
from tomeflow.operators import audit
from tomeflow.operators import compare as C
from tomeflow.operators import ordered, quality, search, segment, templates, trees
from tomeflow.session import checkpoint_dir
from tomeflow.sources import readers, sinks
from tomeflow.streaming import audit as streams

SUB = "id string, section_id string, `order` int, name string, tag string, body string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("size", [7, 4096])
def test_scan_equals_brute_force(spark, size):
    """One key holds a third of all rows, one key is null, and a key's first place may be null; must equal a Python loop."""
    rnd = random.Random(7)
    data = []
    for key, n in [("hot", 60), (None, 20)] + [(f"k{i}", rnd.randint(1, 9)) for i in range(24)]:
        first = rnd.choice([None, 1])
        data += [(key, pos if pos > 1 else first, rnd.choice([None, rnd.randint(0, 50)])) for pos in range(1, n + 1)]
    df = spark.createDataFrame(data, "k string, pos int, v int")
    v = F.col("v")
    got = ordered.scan(
        df, ["k"], ["pos"], ordered.chunk_of("pos", size), a=ordered.lag(v), b=ordered.lead(v), c=ordered.last_before(v), d=ordered.last_upto(v),
        e=ordered.first_after(v), f=ordered.running_sum(v), g=ordered.max_before(v), h=ordered.first_upto(v), n=ordered.row_number(),
    )
    want, first_of = [], {d[0]: d[1] for d in reversed(data)}
    for key in {d[0] for d in data}:
        vs = [d[2] for d in data if d[0] == key]
        for i, x in enumerate(vs):
            full = lambda xs: [y for y in xs if y is not None]
            before, after = full(vs[:i]), full(vs[i + 1 :])
            upto = full(vs[: i + 1])
            want.append((key, i + 1 if i else first_of[key], vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None, before[-1] if before else None,
                         upto[-1] if upto else None, after[0] if after else None, sum(upto), max(before) if before else None, upto[0] if upto else None, i + 1))
    have = [tuple(r[c] for c in ("k", "pos", "a", "b", "c", "d", "e", "f", "g", "h", "n")) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def greedy(old, new):
    """The alignment rule as a plain loop over names."""
    out, start = [], 0
    for i, _ in enumerate(new):
        hit = next((j for j in range(start, len(old)) if C.rows_match(old, new, i, j)), None)
        if hit is None:
            out.append((None, i))
            continue
        out += [(j, None) for j in range(start, hit)] + [(hit, i)]
        start = hit + 1
    return out + [(j, None) for j in range(start, len(old))]


def test_alignment_equals_loop(spark):
    rnd = random.Random(3)
    old, new, want = [], [], {}
    for g in range(60):
        names = ["A", "B", "C", "D", "E", "F"] + (["", "A"] if g % 2 else [])
        o = rnd.sample(names, rnd.randint(0, len(names)))
        n = rnd.sample(names, rnd.randint(1, len(names)))
        old += [(f"g{g}", f"o{j}", j, x) for j, x in enumerate(o)]
        new += [(f"g{g}", f"n{i}", i, x) for i, x in enumerate(n)]
        want[f"g{g}"] = [(None if j is None else f"o{j}", None if i is None else f"n{i}") for j, i in greedy(o, n)]
    schema = "grp string, id string, pos int, name string"
    got = C.align_sections(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    for g, expected in want.items():
        mine = sorted((r for r in got if r["grp"] == g), key=lambda r: (r["k1"], r["k2"], r["k3"]))
        assert [(r["old_id"], r["new_id"]) for r in mine] == expected, g


def test_repeated_headings(spark):
    df = spark.createDataFrame([("1", "s", 1, "Subsection 1", "h3", ""), ("2", "s", 2, "Subsection 2", "h3", "")], SUB)
    assert rows(trees.repeated_headings(df), "name", "error") == [("Subsection 2", "Repeated heading level: two h3 headings in a row.")]


@pytest.mark.parametrize("x,y", [("h3", "h5"), ("h3", "h6"), ("h3", "h7"), ("h4", "h6"), ("h4", "h7"), ("h5", "h7")])
def test_skipped_headings(spark, x, y):
    df = spark.createDataFrame([(str(i), "s", i, f"Subsection {i}", t, "x") for i, t in enumerate(["h3", "h4", x, y], 1)], SUB)
    names = spark.createDataFrame([("s", "Step 1")], "id string, name string")
    assert "4" in [r["id"] for r in trees.skipped_headings(df, names).collect()]


def test_broken_links(spark):
    bodies = ["[broken link](#h.broken-link)", "[valid link](https://example.com)", "[broken link](#id.broken-link)", "[x](/contacts)", "[ok](#here)"]
    subs = spark.createDataFrame([(str(i), "s", i, "n", "h3", b, "here" if i == 5 else "") for i, b in enumerate(bodies, 1)], SUB + ", html_id string")
    secs = spark.createDataFrame([("s", "d", "")], "id string, document_id string, html_id string")
    assert [r[0] for r in rows(quality.broken_links(subs, secs), "subsection_id")] == ["1", "3", "4"]


def test_match_context(spark):
    df = spark.createDataFrame([("a" * 150 + "match" + "b" * 150,), ("x match" + "y" * 300 + "MATCH z",), ("none",)], "t string")
    got = [r[0] for r in df.select(X.match_context(F.col("t"), "match", 50, 200)).collect()]
    assert len(got[0]) == 1 and got[0][0].startswith("…" + "a" * 50 + "<strong>") and got[0][0].endswith("b" * 50 + "…")
    assert len(got[1]) == 2 and got[1][0].startswith("x <strong>") and got[1][1].endswith(" z")
    assert got[2] == []


def test_replace_keeps_link_targets(spark):
    df = spark.createDataFrame([("a page [my page](https://x.org/page/1) PAGE (page)",)], "t string")
    assert df.select(X.replace_text(F.col("t"), "page", "$leaf")).first()[0] == "a $leaf [my $leaf](https://x.org/page/1) $leaf ($leaf)"


def test_variables(spark):
    body = r"One {variable}. { variable with spaces } {List: Codes} {variable} \{not one\} {.cls}"
    got = templates.extract_variables(spark.createDataFrame([("1", body)], "id string, body string"))
    assert rows(got.orderBy("position"), "position", "key", "type", "label") == [
        (0, "variable", "string", "variable"), (1, "variable_with_spaces", "string", "variable with spaces"), (2, "codes", "list", "Codes"), (3, "variable_2", "string", "variable"),
    ]


def test_normalize_and_sanitize(spark):
    df = spark.createDataFrame([("<h1>Hello World</h1>☐ ¨",), ("ｆｕｌｌ​  width",), (None,)], "t string")
    assert df.select(X.normalize_chars(F.col("t"))).first()[0] == "<h1>Hello World</h1>◻ ◻"
    assert [r["o"] for r in search.sanitize_text(df, "t", "o").collect() if r["t"] and "w" in r["t"] and "<" not in r["t"]] == ["full width"]


def test_rename_rule(spark):
    cases = [
        ("Cost-sharing commitments", "Cosmic horror is required", "a", "b", True), ("Cost-sharing commitments", "Colorado chalets", "a", "b", False),
        ("Summary", "Overview", "a", "b", False), ("Summary", "Overview", "a", "a ", True),
    ]
    df = spark.createDataFrame(cases, "n string, o string, nb string, ob string, want boolean")
    got = df.select(C._is_rename(F.col("n"), F.col("nb"), F.col("o"), F.col("ob")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_segmentation(spark):
    html = (
        "<html><body><p>lost</p><h1>Step 1</h1><p>intro</p><h2 id='x'>Part</h2><p>text</p><p>Key facts</p>"
        "<table><tr><td><p>Ask us</p></td></tr></table><p>after</p><h1>Glossary</h1><h3>Deep</h3></body></html>"
    )
    raw = spark.createDataFrame([("d", html.replace("'", '"'))], "doc_id string, html string")
    units = segment.units(segment.blocks(segment.html_tokens(raw)))
    assigned = segment.assign_sections(units)
    assert rows(segment.sections(assigned), "order", "name", "has_section_page") == [(1, "Step 1", True), (2, "Glossary", False)]
    assert rows(segment.assign_subsections(assigned), "section", "order", "name", "tag", "callout_box", "body") == [
        (1, 1, "", "", False, "intro"), (1, 2, "Part", "h3", False, "text"), (1, 3, "Key facts", "h4", False, ""),
        (1, 4, "", "", True, "Ask us"), (1, 5, "", "", False, "after"), (2, 1, "Deep", "h4", False, ""),
    ]


def test_readability_counts(spark):
    df = spark.createDataFrame([("d", "Applicants describe their proposed work. We review each application.")], "id string, t string")
    r = quality.readability(df, "id", "t").first()
    assert (r["word_count"], r["words_per_sentence"]) == (9.0, 4.5)


def test_goals_are_checked(spark):
    bad = [("word_count", "", "at_most", 1.0, None, None), ("nope", "x", "at_most", 1.0, None, None), ("word_count", "x", "at_most_by_category", None, 2.0, 1.0)]
    assert quality.check_goals(spark.createDataFrame(bad, quality.GOAL_SCHEMA)).filter("problem IS NULL").count() == 0
    assert quality.check_goals(quality.default_goals(spark)).filter("problem IS NOT NULL").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert readers.scan_images(spark, str(tmp_path)).count() == 1
    assert sinks.report_name("nb_export", "hrsa", "2025-04-01", "2025-04-30") == "nb_export_hrsa_2025-04-01_2025-04-30.csv"


def test_registry_and_plans(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(q) - set(entry.LLM_QUERIES) == set(sql) - set(entry.LLM_SQL) and set(sql) <= set(q) and len(q) >= 170
    for name in ("broken_links", "edits_per_user_doc", "union_heading_errors", "access_matrix", "carry_over_classes"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan, name
    assert entry.entry(spark).count() == 150


def test_stream_equals_batch_on_a_folder_with_late_events(spark, tmp_path):
    """Two runs over a folder of part files; the second brings events days older than the first's."""
    days = ["2024-01-05 10:00:00", "2024-01-05 11:00:00", "2024-01-09 08:00:00", "2024-01-02 07:00:00", "2024-01-05 12:00:00"]
    rows = [(i, f"o{i % 2}", d) for i, d in enumerate(days)]
    schema = "id bigint, label string, datetime timestamp"
    table, out = f"{tmp_path}/events.parquet", f"{tmp_path}/daily"
    label = lambda e: e.select("id", F.lit("Document").alias("object_type"), F.col("label").alias("description"), "datetime")

    def put(part):
        df = spark.createDataFrame(part, "id bigint, label string, at string").select("id", "label", F.col("at").cast("timestamp").alias("datetime"))
        df.write.mode("append").parquet(table)
        streams.dedup_daily(streams.follow(spark, table, df.schema), label, out, f"{tmp_path}/state").awaitTermination()

    put(rows[:3])
    put(rows[3:])
    cols = ("object_type", "description", "day", "id", "datetime", "first_at")
    want = rows_sorted(audit.dedup_daily(label(spark.read.schema(schema).parquet(table))), cols)
    assert len(want) == 4 and rows_sorted(streams.daily(spark, out), cols) == want
    streams.compact(spark, out, f"{tmp_path}/folded")
    assert rows_sorted(streams.daily(spark, f"{tmp_path}/folded"), cols) == want


def rows_sorted(df, cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster)


def test_checklist_children_of_one_hot_key(spark):
    """A third of the rows in one key; must equal a plain loop."""
    rnd = random.Random(2)
    data = [(k, i, rnd.choice([None, 0, 1, 2, 3])) for k, n in [("hot", 60), *((f"k{j}", 6) for j in range(20))] for i in range(n)]
    got = {(r.k, r.pos): r.is_child for r in segment.checklist_children(spark.createDataFrame(data, "k string, pos int, indent int"), ["k"]).collect()}
    for key in {d[0] for d in data}:
        low, prev, begun = None, None, False
        for _, pos, x in (d for d in data if d[0] == key):
            low = x if low is None else min(low, x if x is not None else low)
            deep = x is not None and x > low
            begun = deep and (begun or (prev is not None and prev < x))
            assert got[key, pos] == begun, (key, pos)
            prev = x


def test_segmentation_keeps_all_text(spark):
    html = {
        "stray": "<p>ages < 18 are eligible &nbsp;now &amp; then &#8217;s &#xE9; &amp;lt;</p>",
        "quote": '<p title="x>y" class=\'a b\'>attr</p><p ID=first>id</p>',
        "after": "<p>in</p>bare<div><table><tr><td><p>a</p>tail</td></tr></table></div>",
    }
    raw = spark.createDataFrame(list(html.items()), "doc_id string, html string")
    got = {}
    for r in segment.blocks(segment.html_tokens(raw)).orderBy("doc_id", "seg").collect():
        got.setdefault(r.doc_id, []).append((r.tag, r.text))
    assert [t for _, t in got["stray"]] == ["ages < 18 are eligible now & then ’s é &lt;"]
    assert got["quote"] == [("p", "attr"), ("p", "id")]
    assert [x for x in got["after"] if x[1]] == [("p", "in"), ("p", "bare"), ("p", "a"), ("p", "tail")]
    cells = {r.doc_id: r.text for r in segment.units(segment.blocks(segment.html_tokens(raw))).filter("tag = 'table'").collect()}
    assert cells["after"] == "a tail"
    ids = segment.html_tokens(raw).select(markup.attribute("attrs", "id").alias("i"), markup.attribute("attrs", "class").alias("c")).collect()
    assert {r.i for r in ids} == {"", "first"} and {r.c for r in ids} == {"", "a b"}


def test_links_with_titles_brackets_quotes_and_markup(spark):
    body = (
        """[a](https://x.org/1 "t") ![img](https://x.org/i.png) [b [c]](<https://x.org/2>) <https://x.org/3> <a HREF='https://x.org/4'><em>d</em> e</a> """
        """<a id="n" href=https://x.org/5>f</a> <a name="x">no</a> <a title="1>0" href="https://x.org/6">g</a>"""
    )
    df = spark.createDataFrame([(body,)], "body string")
    got = [(x.url, x.link_text) for x in df.select(links.found(F.col("body")).alias("l")).first().l]
    assert got == [
        ("https://x.org/1", "a"), ("https://x.org/2", "b [c]"), ("https://x.org/3", "https://x.org/3"), ("https://x.org/4", "d e"), ("https://x.org/5", "f"), ("https://x.org/6", "g"),
    ]
    html = spark.createDataFrame([(1, "<p><a><strong>bold</strong> text</a><a id='k'>named</a><a class=\"c\">plain</a><abbr>x</abbr></p>")], "k int, html string")
    assert sorted(r.link_text for r in quality.hrefless_links(html, "k", "html").collect()) == ["bold text", "plain"]


def test_event_diffs_of_variables(spark):
    v = lambda x: json.dumps([{"key": "a", "type": "string", "label": "Name", "value": x}])
    log = [
        (1, "subsection", "s1", json.dumps({"variables": [v("old"), v("new")]})),
        (2, "subsection", "s1", json.dumps({"variables": [v("same"), v("same")]})),
        (3, "subsection", "s1", json.dumps({"body": ["a b", "a  b"], "variables": [v("x"), v("y")]})),
        (4, "subsection", "s2", json.dumps({"body": ["a", "c"]})),
        (5, "section", "s1", json.dumps({"variables": [v("old"), v("new")]})),
    ]
    events = spark.createDataFrame(log, "id long, model string, object_id string, changed_fields string")
    subs = spark.createDataFrame([("s1", "Dear {Name}, hello"), ("s2", "c")], "id string, body string")
    got = rows(audit.event_diffs(events, subs), "id", "object_id", "old_body", "new_body")
    assert got == [(1, "s1", "Dear old, hello", "Dear new, hello"), (4, "s2", "a", "c")]
