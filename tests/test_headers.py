"""Header groups against a plain loop over each section, one of which holds most rows; references cut out of bodies."""

from __future__ import annotations

import random

from tomeflow import fixed_values as V
from tomeflow.operators import trees, versions


def plain(rows):
    out = []
    for section in {r[1] for r in rows}:
        no, heading, empty = 0, None, True
        for i, (id_, _, order, name, tag, body, ins) in enumerate(sorted((r for r in rows if r[1] == section), key=lambda r: r[2])):
            if i == 0 or name.strip().lower() in V.GROUP_HEADERS or tag.lower() in ("h2", "h3"):
                no, heading, empty = no + 1, name, True
            bare = body == "" and ins == "" and name.strip().lower() == heading.strip().lower()
            empty = empty and bare
            if not empty:
                out.append((id_, no, heading))
    return sorted(out)


def test_groups_equal_loop(spark):
    rnd = random.Random(4)
    names = [*list(V.GROUP_HEADERS)[:2], "Other", "Plain", ""]
    rows = []
    for section, n in [("hot", 9000), *((f"s{i}", rnd.randint(1, 8)) for i in range(40))]:
        rows += [(f"{section}-{i}", section, i + 1, rnd.choice(names), rnd.choice(["", "h4", "h3", "H2"]), rnd.choice(["", "", "text"]), rnd.choice(["", "", "note"])) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, section_id string, `order` int, name string, tag string, body string, instructions string")
    assert sorted((r.id, r.group_no, r.heading) for r in trees.group_by_header(df).collect()) == plain(rows)


def test_references_are_replaced_in_one_pass(spark):
    bodies = {"1": 'see (#a) and <a HREF="#B">x</a>, (#a)(#c) (# d) #a', "2": "(#a", "3": "no reference", "4": "", "5": "(#a)", "6": "a (#b) é (#x&y) $1 \\ (#zz)"}
    rows = spark.createDataFrame([("d" if i != "5" else "e", i, b) for i, b in bodies.items()], "document_id string, id string, body string")
    m = spark.createDataFrame([("d", "a", "n-a", 1), ("d", "A", "later", 2), ("d", "b", "n$1b", 1), ("d", "x&y", "n-x", 1), ("d", "", "never", 1)], "document_id string, old_id string, new_id string, rank int")
    got = {r.id: r.body for r in versions.rewrite_anchor_refs(rows, m).collect()}
    assert {i: got[i] for i in "2345"} == {i: bodies[i] for i in "2345"} and got["6"] == "a (#n$1b) é (#n-x) $1 \\ (#zz)"
    assert got["1"].lower() == 'see (#n-a) and <a href="#n$1b">x</a>, (#n-a)(#c) (# d) #a'
