"""SimHash against a plain Python version, with nulls, empty and long texts, ties, copies, clashing columns, hot keys."""

import random

import pytest
import xxhash

from tomeflow.llm import simhash
from tomeflow.llm.common import components

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(items):
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and ((items[a] ^ items[b]) & MASK).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in items}


def fixture():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdeéñß", k=rnd.randint(2, 7))) for _ in range(300)]
    docs = []
    for i in range(60):
        base = rnd.choices(vocab, k=rnd.choice([1, 2, 3, 40, 200]))
        docs.append(" ".join(base))
        if i % 3 == 0:
            docs.append("\n".join(base).upper())
        if i % 4 == 0:
            for _ in range(3):
                base = list(base)
                base[rnd.randrange(len(base))] = rnd.choice(vocab)
                docs.append(" ".join(base))
    docs += [None, "", " \t\n", "x", "x", "word " * 60000]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("hot", [4096, 2])
def test_equals_brute_force(spark, hot):
    data = fixture()
    want_fp = {i: plain_fingerprint(t) for i, t in data}
    want = plain_components(want_fp)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in data], "doc_id long, text string, key string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, hot=hot).collect()}
    assert got == {i: (f"{want_fp[i]:016x}", want[i]) for i, _ in data}


def test_links_of_random_bits(spark):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        x = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    want = plain_components(dict(enumerate(sorted(signed))))
    for hot in (4096, 3):
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        root = {r.node: r.root for r in components(simhash.links(df, hot)).collect()}
        order = sorted(signed)
        assert [root.get(x, x) for x in order] == [order[want[i]] for i in range(len(order))]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_one_of_each_keeps_other_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, "other words are here now"), (3, "yet another text under one id"), (4, None), (5, ""), (None, "a b c d e f"), (None, "alone without id")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.text, r.component_id) for r in simhash.one_of_each(df).collect()), key=str)
    want = [(1, "a b c d e f", 7), (3, "other words are here now", 7), (3, "yet another text under one id", 7), (4, None, 7), (None, "alone without id", 7)]
    assert got == sorted(want, key=str)
