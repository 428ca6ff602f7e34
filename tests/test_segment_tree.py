"""Element trees, element text and anchor names of hand-made pages; trees against a stack in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import segment as S
from tomeflow.plans import catalog
from tomeflow.plans.roles import Roles


def pages(spark, **html):
    return spark.createDataFrame([(k, v.replace("'", '"')) for k, v in html.items()], "doc_id string, html string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_nested_tables_keep_their_rows(spark):
    raw = pages(
        spark,
        nested="<table><tr><td>a<table><tr><td>in1</td><td>in2</td></tr><tr><td>in3</td></tr></table>b</td><td>c</td></tr><tr><td>d</td></tr></table><p>out</p>",
        loose="<table><tr><td>x<td>y<tr><td>z</table></table><p>end</p><table><tr><td>w</td></tr></table>",
    )
    blocks = S.blocks(S.html_tokens(raw))
    assert rows(S.table_cells(blocks), "doc_id", "tbl", "row", "cell", "text") == [
        ("loose", 1, 1, 1, "x"), ("loose", 1, 1, 2, "y"), ("loose", 1, 2, 3, "z"), ("loose", 2, 1, 1, "w"),
        ("nested", 1, 1, 1, "a b"), ("nested", 1, 1, 2, "c"), ("nested", 1, 2, 3, "d"), ("nested", 2, 1, 1, "in1"), ("nested", 2, 1, 2, "in2"), ("nested", 2, 2, 3, "in3"),
    ]
    assert rows(S.units(blocks), "doc_id", "tag", "text") == [
        ("loose", "p", "end"), ("loose", "table", "w"), ("loose", "table", "x y z"), ("nested", "p", "out"), ("nested", "table", "a in1 in2 in3 b c d"),
    ]
    assert rows(S.table_shape(S.table_cells(blocks)), "doc_id", "tbl", "columns", "rows") == [("loose", 1, 2, 2), ("loose", 2, 1, 1), ("nested", 1, 2, 2), ("nested", 2, 2, 2)]


def test_tree_equals_stack(spark):
    rnd = random.Random(5)
    tags = ["<table>", "</table>", "<tr>", "<td>", "</td>", "<p>", "x"]
    docs = {f"d{i}": "".join(rnd.choices(tags, [3, 3, 3, 4, 2, 2, 2], k=60)) for i in range(40)}
    got = {(r.doc_id, r.pos): (r.depth_t, r.tbl, r.tr, r.cell) for r in S.in_tables(S.html_tokens(pages(spark, **docs))).collect()}
    assert len(got) > 1000
    for doc, html in docs.items():
        stack, n, counts, pos = [], 0, {0: [0, 0]}, -1
        for part in [t for t in html.replace("x", "").replace(">", "> ").split()]:
            pos += 1
            if part == "<table>":
                n += 1
                stack.append(n)
                counts[n] = [0, 0]
            elif part == "</table>" and stack:
                stack.pop()
            here = stack[-1] if stack else 0
            counts[here][0] += part == "<tr>"
            counts[here][1] += part == "<td>"
            assert got[doc, pos] == (len(stack), here, *counts[here]), (doc, pos)


def test_text_without_tags_stays(spark):
    raw = pages(spark, plain="plain only", lead="before <p>in</p>", bold="<b>bold</b> start<p>x</p>", page="<!DOCTYPE html><html><head><title>T</title></head><body>hello<p>y</p></body></html>", none="", tags="<br>")
    assert rows(S.blocks(S.html_tokens(raw)).filter("text <> ''"), "doc_id", "tag", "text") == [
        ("bold", "p", "bold start"), ("bold", "p", "x"), ("lead", "p", "before"), ("lead", "p", "in"), ("page", "p", "hello"), ("page", "p", "y"), ("plain", "p", "plain only"),
    ]


def test_endnotes_heading_with_inner_markup(spark):
    raw = pages(spark, has="<h1><strong>Endnotes</strong></h1><hr>", rule="<h1>End<em>note</em></h1><p>x</p><hr>", notes="<ol><li id='endnote-1'><p>n</p></li></ol>", styled="<hr style='x'>")
    assert rows(S.detect_endnotes(S.html_tokens(raw)), "doc_id", "kind", "pos") == [("notes", "list", 0), ("rule", "rule", 6)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a href='u'><em>x</em></a><a href='u'>y</a>", [("u", 2, "xy", False)]),
        ("<a href='u'><em>x</em></a> <a href='u'>y</a> <b>.</b>", [("u", 2, "x y", True)]),
        ("<span><a href='u'>x</a></span><span><a href='u'>y</a></span> <span><a href='u'>z</a></span>", [("u", 3, "xy z", False)]),
        ("<a href='u'>x</a><b>n</b><a href='u'>y</a>", [("u", 1, "x", False), ("u", 1, "y", False)]),
        ("<a id='k'>x</a><a id='k'>y</a><a id='m'>z</a>", [("", 1, "z", False), ("", 2, "xy", False)]),
        ("<a>x</a><a>y</a><a href='u'>z", [("u", 1, "z", False)]),
    ],
)
def test_adjacent_links(spark, html, want):
    got = S.merge_adjacent_links(S.html_tokens(pages(spark, d=f"<p>{html}</p>")))
    assert rows(got, "href", "links", "text", "drops_space") == want


def test_metadata_in_cells(spark):
    raw = pages(
        spark,
        d="<table><tr><td><p><b>Opportunity</b> name: Care</p></td><td>Opportunity number: N-1</td></tr><tr><td><p>Opdiv:</p><p>Health</p><p>Agency: Office</p></td></tr></table><p>Tagline: late</p>",
        e="<table><tr><td><p>Opdiv:</p></td><td><p>Health</p></td><td><p>Agency: Office</p></td></tr></table>",
    )
    got = {r.doc_id: r for r in S.extract_metadata(S.blocks(S.html_tokens(raw)), {"author": "A"}).collect()}
    d = got["d"]
    assert (d.title, d.number, d.opdiv, d.agency, d.tagline, d.author) == ("Care", "N-1", "Health", "Office", "late", "A")
    assert (got["e"].opdiv, got["e"].agency) == ("", "Office")


def test_anchors_before_a_heading_collapse(spark):
    raw = pages(
        spark,
        d="<p><a id='a1'></a><a id='a2'></a></p><h2 id='own'><a id='a3'></a>Fees</h2><p id='p'>x <a href='#a1'>1</a><a href='#a2'>2</a><a href='#a3'>3</a><a href='#own'>4</a><a href='#p'>5</a><a href='#no'>6</a></p>",
        e="<p><a id='b'></a>text <a href='#b'>1</a></p><p><a id='last'></a></p><a href='#last'>2</a>",
    )
    got = S.resolve_anchors(S.html_tokens(raw))
    assert sorted((r.doc_id, r.href, r.new_href, r.target_pos) for r in got.collect() if r.doc_id == "d") == [
        ("d", "#a1", "#a3", 6), ("d", "#a2", "#a3", 6), ("d", "#a3", "#a3", 6), ("d", "#no", "#__no", None), ("d", "#own", "#a3", 6), ("d", "#p", "#p", 10),
    ]
    assert {(r.href, r.new_href) for r in got.collect() if r.doc_id == "e"} == {("#b", "#b"), ("#last", "#last")}


def test_image_texts_and_header_widths(spark):
    raw = pages(spark, d="<img src='a' alt='x\n\ny'><img src='b'><img src='c' alt=''><img data-alt='z' src='e'>")
    assert rows(S.missing_alt_text(S.html_tokens(raw)), "src", "alt", "missing") == [("a", "x\ny", False), ("b", "", True), ("c", "", False), ("e", "", True)]
    raw = pages(spark, d="<table><tr><td>Component</td><td>How to upload it</td><td>Page limits</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><table><tr><th>a</th><th>b</th><th>c</th><th>d</th></tr></table>")
    got = S.header_widths(S.table_header_fix(S.table_cells(S.blocks(S.html_tokens(raw)))))
    assert rows(got.filter(F.col("width").isNotNull()), "tbl", "cell", "width") == [(1, 1, "w-45"), (1, 2, "w-40"), (1, 3, "w-15"), (2, 1, "w-25"), (2, 2, "w-25"), (2, 3, "w-25"), (2, 4, "w-25")]


def test_pages_are_cut_once_for_instructions(spark, monkeypatch):
    """Before, the pages were cut into units twice, and the subsections stood in two joins, so all of it ran four times."""
    calls, whole = [], S.html_tokens
    monkeypatch.setattr(S, "html_tokens", lambda *a, **k: calls.append(1) or whole(*a, **k))
    catalog.PLANS["attach_instructions"](Roles(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1
    subs = spark.range(9).selectExpr("'d' AS doc_id", "id AS section", "1L AS `order`", "if(id % 2 = 0, '', 'Scope (all)') AS name", "'scope: x' AS body")
    ins = spark.createDataFrame([("d", 1, "do", "scope")], "doc_id string, unit bigint, instructions string, title string")
    plan = S.attach_instructions(subs, ins)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 9") == 1


def test_instructions_find_titles_and_unnamed_bodies(spark):
    subs = [("d", 2, 1, "Scope (all)", ""), ("d", 1, 3, "", " Scope and more"), ("d", 3, 1, "(x)", ""), ("d", 3, 2, "", "anything"), ("e", 1, 1, "Scope", "b"), ("e", 1, 2, "Fees", "b"), ("g", 1, 1, None, "Scope")]
    ins = [("d", 7, "one", "scope"), ("d", 5, "two", " SCOPE (new)"), ("d", 8, "blank", "(y)"), ("d", 9, "none", None), ("e", 1, "three", "fees"), ("e", 2, "lost", "rates"), ("f", 1, "four", "scope"), ("g", 1, "five", "scope")]
    s = spark.createDataFrame(subs, "doc_id string, section bigint, `order` bigint, name string, body string")
    i = spark.createDataFrame(ins, "doc_id string, unit bigint, instructions string, title string")
    got = sorted(map(tuple, S.attach_instructions(s, i).collect()))
    assert got == [("d", 1, 3, "two"), ("d", 3, 1, "blank"), ("e", 1, 2, "three")]


def test_documents_without_instructions_are_left_out_whole(spark):
    rows = [("a", 1, True, "Instructions for new program team Scope"), ("a", 2, False, "x"), ("b", 1, True, "Other box"), ("b", 2, False, "Instructions for new program team"), ("c", 1, None, None), (None, 3, True, "Grant-specific instructions"), (None, 4, False, "y")]
    units = spark.createDataFrame(rows, "doc_id string, unit bigint, is_callout boolean, text string")
    assert sorted((r.doc_id or "", r.unit) for r in S.instructed(units).collect()) == [("", 3), ("", 4), ("a", 1), ("a", 2)]
