"""Ranked search against scores of all documents in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tomeflow.llm import ranking

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATTERN = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(PATTERN, (text or "").translate(str.maketrans(ABC, ABC.lower())))


def plain(docs, items, top=10):
    vectors = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, v in vectors if v)
    total = sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for d, v in vectors:
            if not v:
                continue
            m = 25 + 75 * sum(v.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * v[t] // (1000 * v[t] + 8 * m)) for t in terms(text) if t in v)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(12)
    vocab = [f"{a}{b}" for a in "abcdefg" for b in ("la", "Ré", "9x", "şu", "no")]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    say = lambda n: rnd.choice([" ", "-", ", "]).join(rnd.choices(vocab, weights, k=n))
    docs = [(i, say(rnd.choice([0, 1, 5, 40, 200]))) for i in range(400)]
    items = [(i, say(rnd.choice([1, 3, 12]))) for i in range(12)]
    docs += [(1000 + i, docs[7][1] + " " + items[3][1]) for i in range(200)]  # a third of all rows are copies
    docs += [(2000, None), (2001, ""), (2002, " -- "), (None, docs[9][1]), (5, docs[5][1]), (5, docs[5][1]), (2003, "ala " * 50000)]
    rnd.shuffle(docs)
    items += [(100, None), (101, ""), (102, "nothing has this"), (3, items[4][1]), (3, items[3][1]), (None, "ala aRé"), (103, " ".join(vocab) * 3)]
    return docs, items


@pytest.mark.parametrize(("first", "block", "rows"), [(10_000, 1000, None), (50, 5, 64)])
def test_equals_brute_force(spark, monkeypatch, first, block, rows):
    monkeypatch.setattr(ranking, "FIRST", first)
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, item int, score string").repartition(4)
    q = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, rank string")
    if rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = sorted((tuple(r) for r in ranking.search(d, q, block=block).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(docs, items)


def test_buckets_are_left_out():
    """A bucket whose lengths cannot reach the tenth score is never scored, and bounds keep what can."""
    items = ranking.Items([b"a b", b"c"]).weigh(10, 100, {0: 1, 1: 2, 2: 3})
    ids, vec = pa.array([1, 2, 3]), pa.array([[0, 1], [0], [1, 2]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([ids, vec, pa.array([[500, 400], [300], [200, 100]], pa.list_(pa.int64())), pa.array([1e6, 1e6, 1e6])], ["doc_id", "terms", "impacts", "length"])
    all_of = list(ranking._search(items, [0, 0], 10)([batch]))[0].to_pylist()
    w = items.w.tolist()
    assert {(r["item"], r["doc_id"], r["score"]) for r in all_of} == {(0, 1, 500 * w[0] + 400 * w[1]), (0, 2, 300 * w[0]), (0, 3, 200 * w[1]), (1, 3, 100 * w[2])}
    short = batch.set_column(3, "length", pa.array(np.full(3, 1e-3)))
    assert list(ranking._search(items, [10**9, 10**9], 10)([short]))[0].num_rows == 0


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert ranking.search(docs, items).count() == 1
