"""Ranks under skew, re-keying down the tree, lines of versions, reading with rejects, reading from a store, deleted sections."""

from __future__ import annotations

import json
import random
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import bench
from tomeflow.operators import audit, filters, ordered, templates, versions
from tomeflow.operators import compare as C
from tomeflow.plans import catalog
from tomeflow.plans.roles import Roles
from tomeflow.session import checkpoint_dir
from tomeflow.sources import readers, sinks, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_row_numbers_of_a_hot_key_and_instant(spark):
    rnd = random.Random(3)
    data = [("hot", 5, i) for i in range(4000)] + [(k, rnd.randint(0, 9), 10_000 + i) for i, k in enumerate(rnd.choices(["a", "b", None], k=3000))]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, m int, id int").repartition(6)
    got = ordered.row_numbers(df, ["k"], [F.desc("m"), "id"])
    want = {}
    for k, m, i in sorted(data, key=lambda x: (-x[1], x[2])):
        want.setdefault(k, []).append(i)
    assert {(r.k, r.id): r.position for r in got.collect()} == {(k, i): n + 1 for k, ids in want.items() for n, i in enumerate(ids)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # of so few rows Spark would make one part
    spread = df.repartitionByRange("k", F.desc("m"), "id").filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1  # the hot minute is more than one task
    everything = ordered.row_numbers(df, [], ["id"]).collect()
    assert sorted(r.position for r in everything) == list(range(1, 7001)) and len({(r.id, r.position) for r in everything}) == 7000


def test_lists_have_default_orders(spark):
    df = spark.createDataFrame([("1", "b", 2), ("2", "a", 1), ("3", "b", 1)], "id string, title string, updated int")
    assert [r.id for r in filters.in_order(df, "documents by title").orderBy("position").collect()] == ["2", "1", "3"]
    assert [r.id for r in filters.in_order(df, "documents, last updated first").orderBy("position").collect()] == ["1", "2", "3"]


def test_history_page_reads_the_log_once(spark):
    log = [(d, i, f"2024-01-01 00:{i:02d}:00", "") for d in ("x", "y") for i in range(7 if d == "x" else 2)]
    h = spark.createDataFrame(log, "document_id string, id int, datetime string, changed_fields string").withColumn("datetime", F.col("datetime").cast("timestamp")).withColumn("event_type", F.lit(1))
    got = audit.history_page(h, offset=2, limit=3)
    assert rows(got, "document_id", "id", "position", "has_more") == [("x", 2, 5, True), ("x", 3, 4, True), ("x", 4, 3, True)]
    assert rows(audit.history_page(h, 0, 2), "document_id", "id", "has_more") == [("x", 5, True), ("x", 6, True), ("y", 0, False), ("y", 1, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_rekey_leaves_no_child_behind(spark):
    t = {
        "document": spark.createDataFrame([("1", None, "2"), ("2", "1", None), ("3", "9", None)], "id string, parent string, successor string"),
        "section": spark.createDataFrame([("10", "1"), ("11", "2")], "id string, document_id string"),
        "subsection": spark.createDataFrame([("10-1", "10"), ("11-1", "11")], "id string, section_id string"),
    }
    graph = {"document": {"id": "document", "parent": "document", "successor": "document"}, "section": {"id": "section", "document_id": "document"}, "subsection": {"id": "subsection", "section_id": "section"}}
    mapping = reduce(DataFrame.unionByName, (df.select(F.lit(m).alias("model"), F.col("id").alias("old_id"), audit.stable_uuid(m, F.col("id")).alias("new_id")) for m, df in t.items()))
    new = audit.rekey_tables(t, mapping, graph)
    assert rows(audit.dangling_keys(new, graph), "table", "column", "key") == rows(audit.dangling_keys(t, graph), "table", "column", "key") == [("document", "parent", "9")]
    ids = {(r.model, r.old_id): r.new_id for r in mapping.collect()}
    assert rows(new["subsection"], "id", "section_id") == sorted((ids["subsection", f"{k}-1"], ids["section", k]) for k in ("10", "11"))
    text = '{"pk": 10, "fields": {"document": 1, "order": 1, "section": 77, "document": 2}}'
    log = spark.createDataFrame([(1, "section", "10", text), (2, "document", "8", '{"pk": 8}'), (3, "section", None, None)], "id int, model string, object_id string, object_json_repr string")
    got = {r.id: (r.object_id, r.object_json_repr) for r in audit.rekey_events(log, mapping, {"document": "document", "section": "section"}).collect()}
    d = {k: ids["document", k] for k in "12"}
    assert got[1] == (ids["section", "10"], f'{{"pk": "{ids["section", "10"]}", "fields": {{"document": "{d["1"]}", "order": 1, "section": 77, "document": "{d["2"]}"}}}}')
    assert got[2] == ("8", '{"pk": 8}') and got[3] == (None, None)


def test_rekey_by_own_ids_moves_no_new_key(spark):
    """Before, every join carried the new ids: more than twice the bytes."""
    n = lambda c, m: (F.col("id") % m).cast("string").alias(c)
    t = {
        "document": spark.range(3000).select(n("id", 9999), F.when(F.col("id") % 3 > 0, F.col("id") * 2).cast("string").alias("parent")),
        "section": spark.range(9000).select(n("id", 9999), n("document_id", 4000)),
        "subsection": spark.range(20000).select(F.concat(n("", 9500), F.lit("-"), F.col("id").cast("string")).alias("id"), n("section_id", 9500)),
    }
    graph = {"document": {"id": "document", "parent": "document"}, "section": {"id": "section", "document_id": "document"}, "subsection": {"id": "subsection", "section_id": "section"}}
    mapping = reduce(DataFrame.unionByName, (df.select(F.lit(m).alias("model"), F.col("id").alias("old_id"), audit.stable_uuid(m, F.col("id")).alias("new_id")) for m, df in t.items()))
    text = F.concat(F.lit('{"pk": '), F.col("id").cast("string"), F.lit(', "document": 7, "section": 8999, "document": 5000}'))
    log = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, t)), (F.col("id") % 3 + 1).cast("int")).alias("model"), n("object_id", 3500), F.when(F.col("id") % 7 > 0, text).alias("object_json_repr"))

    def run(tables_map, event_map):
        new = audit.rekey_tables(t, tables_map, graph) | {"event": audit.rekey_events(log, event_map, {"document": "document", "section": "section"})}
        bench.shuffled.since = bench.newest_stage(spark)
        return {k: sorted(map(tuple, df.collect()), key=str) for k, df in new.items()}, bench.shuffled(spark)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (got, moved), (want, before) = run(None, audit.own_ids(t)), run(mapping, mapping)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and moved < before / 2


def test_line_of_a_thousand_versions_and_cycles(spark):
    docs = [(f"v{i:04d}", f"v{i + 1:04d}" if i < 999 else None, i) for i in range(1000)]
    docs += [("c1", "c2", 1), ("c2", "c3", 2), ("c3", "c1", 3), ("in", "c1", 0), ("loose", "nowhere", 5), ("alone", None, 6), ("me", "me", 7)]
    df = spark.createDataFrame(docs, "id string, successor string, created int")
    lines = {r.id: (r.last, r.steps, r.cycle) for r in versions.version_lines(df).collect()}
    assert all(lines[f"v{i:04d}"] == ("v0999", 999 - i, False) for i in range(1000))
    assert {i for i, (_, _, c) in lines.items() if c} == {"c1", "c2", "c3", "in", "me"} and lines["loose"] == ("loose", 0, False)
    short = df.filter("id >= 'v0960' OR id < 'v'")
    chain = rows(versions.version_chain(short), "id", "ancestor", "steps", "position")
    assert chain == sorted((f"v{j:04d}", f"v{i:04d}", j - i, i - 959) for i in range(960, 1000) for j in range(i + 1, 1000))


def test_nested_json_is_read_or_rejected(spark):
    good = {"id": "1", "title": "T", "sections": [{"name": "s", "order": 1, "subsections": [{"name": "x", "order": 1, "tag": "h3", "body": "b"}]}]}
    path = Path(checkpoint_dir(spark).removeprefix("file://")) / "nested-rejects"
    path.mkdir(parents=True)
    (path / "a.json").write_text("\n".join([json.dumps(good), '{"id": "2", "sections": [', '{"id": "3", "title": "U", "sections": []}', '{"id": "4"}', '{"title": "V", "sections": [{}]}', "not json"]))
    docs, sections, subs, rejects = readers.read_nested_json(spark, str(path), "g")
    assert rows(docs, "source_id", "title", "group") == [("1", "T", "g")] and sections.count() == subs.count() == 1
    assert sorted(((r.reason, r.id) for r in rejects.collect()), key=str) == sorted([("malformed", None), ("malformed", None), ("no id", None), ("no sections", "3"), ("no sections", "4")], key=str)
    assert {r.line for r in rejects.collect() if r.reason == "malformed"} == {'{"id": "2", "sections": [', "not json"}


def test_rows_of_nested_json_are_the_joined_tables_without_a_shuffle(spark):
    """Before, the query joined what it had just taken apart."""
    r, path = Roles(spark, "/root/testdata/sf0.001"), Path(checkpoint_dir(spark).removeprefix("file://")) / "nested-rows"
    sinks.write_nested_json(r.documents, r.sections, r.subsections, str(path))
    got = readers.nested_rows(readers.nested_lines(spark, str(path)), "g")
    docs, sections, subs, _ = readers.read_nested_json(spark, str(path), "g")
    s, d = sections.select(F.col("id").alias("section_id"), F.struct("*").alias("section")), docs.select(F.col("id").alias("document_id"), F.struct("*").alias("document"))
    want = subs.join(s, "section_id").join(d, F.col("section.document_id") == F.col("document_id")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(got) and "Exchange" in plan(want)
    assert "Exchange" not in plan(catalog.PLANS["read_nested_json"](r))


def test_nested_json_is_written_small(spark):
    """Before, as long as its text."""
    r, path = Roles(spark, "/root/testdata/sf0.001"), Path(checkpoint_dir(spark).removeprefix("file://")) / "nested-small"
    sinks.write_nested_json(r.documents, r.sections, r.subsections, str(path))
    lines = sinks.nested(r.documents, r.sections, r.subsections).select(F.to_json(F.struct("*")).alias("line"))
    assert sum(f.stat().st_size for f in path.glob("part-*")) < lines.agg(F.sum(F.length("line"))).first()[0] / 4
    assert sorted(map(tuple, spark.read.text(str(path)).collect())) == sorted(map(tuple, lines.collect()))


def test_uploads_are_judged_by_content(spark):
    path = Path(checkpoint_dir(spark).removeprefix("file://")) / "uploads"
    path.mkdir(parents=True)
    files = {"a.html": "﻿ <p>é</p>".encode(), "b.HTM": b"<html></html>", "c.html": b"PK\x03\x04zip", "d.docx": b"PK\x03\x04zip", "e.html": b"%PDF-1.7", "f.html": b"<p>\xff\xfe</p>", "g.txt": b"<p>x</p>", "i.html": b"words"}
    for name, content in files.items():
        (path / name).write_bytes(content)
    ok, bad = readers.split_uploads(readers.read_uploads(spark, str(path)))
    assert rows(ok, "filename", "html") == [("a.html", " <p>é</p>"), ("b.HTM", "<html></html>")]
    word = "Word file: convert to HTML first"
    assert rows(bad, "filename", "reason") == [("c.html", word), ("d.docx", word), ("e.html", "Not HTML inside: pdf"), ("f.html", "Not UTF-8."), ("g.txt", "Please import a .docx or HTML file."), ("i.html", "Not HTML inside: other")]


def test_packed_uploads_are_judged_like_files(spark):
    path = Path(checkpoint_dir(spark).removeprefix("file://")) / "uploads-both"
    path.mkdir(parents=True)
    files = {"a.html": "\ufeff <p>é</p>".encode(), "c.html": b"PK\x03\x04zip", "f.html": b"<p>\xff\xfe</p>", "g.txt": b"<p>x</p>\n"}
    for name, content in files.items():
        (path / name).write_bytes(content)
    columns = ["filename", "kind", "reason", "html"]
    each = readers.read_uploads(spark, str(path))
    sinks.pack_uploads(each.unionByName(spark.createDataFrame([("", "empty.html", bytearray(), 0)], each.schema)), f"{path}-packed")
    packed = readers.read_uploads(spark, f"{path}-packed", packed=True)
    assert packed.dtypes == each.dtypes and packed.count() == 5
    assert rows(packed.filter("filename <> 'empty.html'"), "filename", "content", "size") == rows(each, "filename", "content", "size")
    assert rows(readers.judge_uploads(packed).filter("filename <> 'empty.html'"), *columns) == rows(readers.judge_uploads(each), *columns)
    assert rows(readers.judge_uploads(packed).filter("filename = 'empty.html'"), *columns) == [("empty.html", "other", "Not HTML inside: other", None)]


def test_uploads_of_a_query_are_no_file_each(spark):
    """Before, each upload was written to a folder of its own, listed and opened."""
    root = Path(checkpoint_dir(spark).removeprefix("file://"))
    got = catalog.PLANS["read_raw_html"](Roles(spark, "/root/testdata/sf0.001"))
    stores = list(root.glob("uploads-*/"))
    n = got.count()
    assert n == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").filter("page_id % 4 = 0").count() > 8
    assert all(len(list(s.rglob("part-*"))) <= 8 for s in stores if "both" not in s.name)


def test_every_page_is_an_upload(spark):
    """Before, only pages whose id is divisible by four were."""
    got = catalog.PLANS["read_raw_html"](Roles(spark, "/root/testdata/sf0.001"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(int(r.filename.split(".")[0]) for r in got.collect()) == sorted(r.page_id for r in pages.collect())


def test_store_is_read_in_ranges_with_pushed_filters(spark):
    url = f"jdbc:derby:memory:store{random.Random().randint(0, 10**9)};create=true"
    data = spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(5, 105)] + [(None, "none", 1)], "ID int, TITLE string, KIND int")
    try:
        data.write.format("jdbc").options(url=url, dbtable="docs").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded store here: {str(e)[:80]}")
    df = tables.read_jdbc(spark, url, "docs", "ID", partitions=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 101
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 27
    plan = df.filter("KIND = 1 AND ID > 50").select("TITLE")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(ID,50)" in plan
    some = tables.read_jdbc(spark, url, "docs", "ID", partitions=4, where="kind = 2", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert {r.KIND for r in some.collect()} == {2}


def test_prefill_by_the_labels_of_the_data(spark):
    df = spark.createDataFrame([("Enter the guide title", "T", "N"), ("x", "T", "N"), ("Guide title and no.", "", "N")], "label string, title string, number string")
    got = df.select(templates.prefill(F.col("label"), F.lit("-"), {"title": "Guide title", "number": "No."}).alias("v")).collect()
    assert [r.v for r in got] == ["T", "-", "N"]


def test_deleted_sections_are_reported_when_asked(spark):
    sec = "pair string, name string, `order` int, id string"
    old = spark.createDataFrame([("p", "A", 1, "1"), ("p", "Gone", 2, "2"), ("p", "Gone", 3, "3")], sec)
    new = spark.createDataFrame([("p", "A", 1, "11"), ("p", "Fresh", 2, "12")], sec)
    row = "section_id string, id string, pos int, name string, `order` int, tag string, html_id string, body string"
    o = spark.createDataFrame([(s, f"o{s}", 1, "x", 1, "h3", "", "b") for s in "123"], row).withColumn("comparison_type", F.lit("body")).withColumn("required", F.array().cast("array<string>"))
    n = spark.createDataFrame([("11", "n1", 1, "x", 1, "h3", "", "b"), ("12", "n2", 1, "y", 1, "h3", "", "c")], row)
    assert rows(C.compare_versions(C.pair_sections(old, new), o, n), "section_name", "status") == [("A", "MATCH"), ("Fresh", "ADD")]
    got = C.compare_versions(C.pair_sections(old, new, include_deleted=True), o, n)
    assert rows(got, "section_name", "status", "grp") == [("A", "MATCH", "11"), ("Fresh", "ADD", "12"), ("Gone", "DELETE", "old:2"), ("Gone", "DELETE", "old:3")]
