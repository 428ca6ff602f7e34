"""Substring dedup against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from tomeflow.llm import substrings


def plain(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def fixture(window):
    rnd = random.Random(window)
    vocab = ["".join(rnd.choices("abcéñß", k=rnd.randint(1, 6))) for _ in range(60)]
    passages = [rnd.choices(vocab, k=rnd.randint(window - 2, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(70):
        w = rnd.choices(vocab, k=rnd.choice([0, 3, window - 1, window, 90]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (101, None), (102, ""), (103, " \n "), (104, "to " * 3000), (105, "x y " * 40), (101, rows[5][1])]
    rows += [(200 + i, " ".join(passages[0]) + f" tail{i}") for i in range(40)]  # a third of all rows share one passage
    return rows


@pytest.mark.parametrize(("window", "start"), [(35, 18), (35, 9), (8, 4)])
def test_equals_brute_force(spark, window, start):
    rows = fixture(window)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row_key int, kept string")
    got = sorted((tuple(r) for r in substrings.dedup(df, window=window, start=start).collect()), key=str)
    assert got == plain(rows, window)


def test_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
