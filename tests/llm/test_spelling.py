"""Spelling variants against plain Python: every pair of words compared, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

from tomeflow.llm import spelling

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(ABC, ABC.lower()))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def fixture():
    rnd = random.Random(3)
    common = ["station", "stations", "réunion", "committee", "aaaaaaa", "aaaaaaaa", "bbaabbaa", "ÀÉÎÕÜßÿ", "Station", "sstation"]
    rare = ["statiom", "statiun", "tation", "sttation", "committe", "commitee", "comittee", "réunionn", "aaaaaaab", "baaaaaaa", "bbaabba", "bbabbaa", "stationt", "stationts"]
    rows = []
    for i in range(150):
        w = rnd.choices(common, k=40) + (rnd.choices(rare, k=3) if i % 3 == 0 else [])
        w += ["".join(rnd.choices("ab", k=rnd.randint(6, 9))) for _ in range(12)]
        rnd.shuffle(w)
        rows.append((i, rnd.choice([" ", "1", ",\n", "Ā"]).join(w)))
    long = "".join(rnd.choices("abcde", k=300))
    ends = "".join(rnd.choices("xyz", k=64))
    rows += [(900, f"{long} {long} {long[:-1]} {long[:-1]} {long}x {long}x {long[:50]}q{long[51:]} {long[:50]}q{long[51:]} " * 2), (901, f"{ends} {ends}a {ends} {ends}a {ends[1:]} {ends[1:]} " * 3)]
    rows += [(902, None), (903, ""), (None, "station committee"), (904, "station " * 30000), (3, rows[3][1]), (3, rows[3][1]), (905, "12 $ $$ a$b")]
    # a chain of forms: ten times as frequent at each step
    rows += [(1000 + i, "abcdefgh " * 200) for i in range(20)] + [(2000 + i, "abcdefgi " * 20) for i in range(10)] + [(3000 + i, "abcdefji ") for i in range(12)]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(tuple(r) for r in spelling.variants(df).collect())
    want = plain(rows)
    assert got == want
    assert any(len(w) > 64 and k for w, _, _, _, k, _ in want) and any(f and r != f for _, f, r, *_ in want)


def test_groups_across_batches(spark):
    rows = fixture()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(rows[:90], "doc_id long, text string")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows[:90])


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
