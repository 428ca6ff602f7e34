"""Spaced-seed decontamination against a plain loop over texts, items and alignments."""

import random
from itertools import combinations

from tomeflow.llm import decontaminate as D


def plain(docs, items):
    """By similarity alone: every text, item and alignment."""
    out = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, passage in items:
            v = (passage or "").lower().split()
            if item is None or not v:
                continue
            width, best = min(len(v), D.WINDOW), None
            for d in range(-len(v), len(w)):
                e = [0 <= d + j < len(w) and w[d + j] == v[j] for j in range(len(v))]
                if sum(e) * 5 < width * 4:
                    continue
                most = max(sum(e[k : k + width]) for k in range(len(v) - width + 1))
                if most * 5 >= width * 4 and (best is None or (most, sum(e), -d) > best):
                    best = (most, sum(e), -d)
            if best:
                out[doc, item] = (round(best[0] / width, 9), best[1], -best[2])
    return out


def fixture():
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 4))) for _ in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=n))) for i, n in enumerate([5, 7, 9, 12, 20, 35, 60, 3])]
    items += [(20, None), (21, ""), (3, items[3][1])]
    docs = []
    for i in range(60):
        w = rnd.choices(vocab, k=rnd.choice([0, 4, 30, 150]))
        if i % 2:
            v = rnd.choice(items[:7])[1].split()
            v = [rnd.choice(vocab) if rnd.random() < rnd.choice([0, 0.1, 0.3]) else x for x in v]
            at = rnd.randint(0, len(w))
            w[at:at] = v[rnd.choice([0, 0, 5]) :]
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(w).title()))
    docs += [(200 + k, f"{rnd.choice(vocab)} {items[7][1]} {rnd.choice(vocab)}") for k in range(3)]
    docs += [(100, None), (101, ""), (None, items[5][1]), (102, "so so " * 20000 + items[6][1]), (7, docs[7][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, item_id int, w string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.n_matched, r.start_word) for r in D.overlaps(d, b).collect()}
    want = plain(docs, items)
    assert want and got == want
    left = D.clean(d, b)
    assert left.columns == d.columns
    hit = {doc for doc, _ in want}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, _ in docs if i not in hit), key=str)


def test_every_allowed_substitution_is_found(spark):
    """Items of 1 to 20 words: each pattern of as many substitutions as four fifths allow is found, one more is not."""
    docs, items, more = [], [], []
    for n in range(1, 21):
        v = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(v)))
        errors = n - D.needed(n)
        for gone in combinations(range(n), errors):
            docs.append((1000 * n, len(docs), " ".join("xx" if k in gone else x for k, x in enumerate(v))))
        for gone in list(combinations(range(n), errors + 1))[::37]:
            more.append((1000 * n + 1, len(docs) + len(more), " ".join("xx" if k in gone else x for k, x in enumerate(v))))
    df = spark.createDataFrame([(i, f"lead {t} tail") for _, i, t in docs + more], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, n // 1000) for n, i, _ in docs}
    assert len(docs) > 6000


def test_masks_hit_whatever_is_allowed():
    for n in range(1, 40):
        width, m = min(n, D.WINDOW), D.mask(n)
        ones = [k for k, bit in enumerate(m) if bit == "1"]
        for gone in combinations(range(width), width - D.needed(width)):
            assert any(not set(gone) & {o + k for o in ones} for k in range(width - len(m) + 1)), (n, gone)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert D.overlaps(d.limit(0), b).count() == 0 and D.overlaps(d, b.limit(0)).count() == 0 and D.clean(d, b.limit(0)).count() == 1
