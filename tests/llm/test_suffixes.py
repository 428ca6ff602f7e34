"""Prefix-free parsing dedup against plain Python."""

import hashlib
import random

import pytest

from tomeflow.llm import suffixes


def plain(rows, window):
    """Rows with one id are not before one another; rows without an id come last."""
    first, out = {}, []
    order = lambda i: (1 << 63) - 1 if i is None else i
    for doc, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            first[s] = min(first.get(s, 1 << 63), order(doc))
    for doc, t in rows:
        raw, gone, seen = (t or "").encode(), set(), set()
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            if first[s] < order(doc) or s in seen:
                gone.update(range(i, i + window))
            seen.add(s)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(raw), len(gone), spans, hashlib.sha256(bytes(b for j, b in enumerate(raw) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def fixture(window):
    rnd = random.Random(window)
    text = lambda n: "".join(rnd.choices("abcdé ñß\n", k=n))
    passages = [text(rnd.randint(window - 2, 3 * window)) for _ in range(5)]
    rows = []
    for i in range(60):
        w = text(rnd.choice([0, 5, window - 1, window, 4 * window]))
        for _ in range(rnd.choice([0, 1, 2])):
            at = rnd.randint(0, len(w))
            w = w[:at] + rnd.choice(passages) + w[at:]
        rows.append((i, w))
    rnd.shuffle(rows)
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (None, None), (102, ""), (104, "to " * 2000), (105, "xy" * 300), (106, "z" * 500), (104, passages[1])]
    rows += [(200 + i, text(30) + passages[0] + text(30)) for i in range(40)]
    return rows


@pytest.mark.parametrize(("window", "part", "hot"), [(100, 32, 2000), (100, 32, 3), (20, 6, 2000), (20, 6, 2)])
def test_equals_brute_force(spark, window, part, hot):
    rows = fixture(window)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row_key int, place string")
    got = sorted((tuple(r) for r in suffixes.dedup(df, window=window, part=part, hot=hot).collect()), key=str)
    assert got == plain(rows, window)


def test_empty(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
