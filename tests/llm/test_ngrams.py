"""LM scores against plain Python: unigrams exactly, the back-off model with exact counts in place of the filter."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeflow.llm import ngrams
from tomeflow.llm.common import learning_row

LEARN = lambda i: learning_row(i, 7, 2)
ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens(text):
    return [*(text or "").translate(str.maketrans(ABC, ABC.lower())).encode().split(), b""]


def plain(rows):
    train = [tokens(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t, strict=True))
    total, types = Counter(), defaultdict(int)
    for (h, _), k in pairs.items():
        total[h] += k
        types[h] += 1
    stands = lambda k: float(ngrams.STANDS[int(ngrams.levels(np.array([k]))[0])])
    out = []
    for d, text in rows:
        said = tokens(text)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in said)
        score = 0.0
        for h, w in zip([None, *said[:-1]], said, strict=True):
            if pairs[h, w]:
                score += math.log10((min(stands(pairs[h, w]), stands(total[h])) - ngrams.DISCOUNT) / stands(total[h]))
            else:
                back = min(1.0, ngrams.DISCOUNT * stands(types[h]) / stands(total[h])) if total[h] else 1.0
                score += math.log10(back) + math.log10((c[w] + 1) / (n + v + 1))
        out.append((d, len(said), sum(c[w] > 0 for w in said), n, base, score))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(13)
    vocab = ["".join(rnd.choices("abcdeéñ", k=rnd.randint(1, 5))) for _ in range(120)]
    say = lambda k: rnd.choice([" ", "\n", " \t"]).join(a if rnd.random() < 0.9 else a.upper() for a in rnd.choices(vocab, [1 / (i + 1) for i in range(120)], k=k))
    rows = [(i, say(rnd.choice([0, 1, 10, 80]))) for i in range(200)]
    rows += [(500 + i, "Licence text, the same in many documents. " * 3) for i in range(100)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, say(5)), (None, None), (903, "wörd " * 40000), (3, rows[3][1]), (3, rows[3][1]), (904, "\x00 \x85 zz")]
    return rows


@pytest.mark.parametrize("setting", [{}, {"filter_bytes": 300, "head": 5}, {"head": 0}])
def test_equals_plain_model(spark, monkeypatch, setting):
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 3000)
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, word int, tokens string").repartition(5)
    got = sorted((tuple(r) for r in ngrams.score(df, LEARN, bits=4000, **setting).collect()), key=str)
    want = plain(rows)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4:] for r in got] == [pytest.approx(r[4:], rel=1e-9) for r in want]


def test_filter_errs_on_one_side():
    rnd = np.random.default_rng(5)
    keys, counts = rnd.integers(0, 1 << 63, 20000).astype(np.uint64), rnd.zipf(1.7, 20000).clip(1, 10**12)
    q = ngrams.levels(counts)
    assert all(1 + math.floor(math.log(c) / math.log(ngrams.BASE) + 1e-12) == k for c, k in zip(counts.tolist(), q.tolist(), strict=True))
    words = int(q.sum()) * ngrams.BITS // 64 + 1
    bloom = ngrams.Bloom(bytes(8 * words), np.zeros(1, np.uint64), np.array([words], np.uint64))
    none = np.zeros(20000, np.int64)
    bloom.add(keys, q, none)
    read = bloom.read(keys, none)
    assert (read >= q).all() and (read > q).mean() < 0.01
    assert (bloom.read(rnd.integers(0, 1 << 63, 20000).astype(np.uint64), none) > 0).mean() < 0.01


def test_better_than_unigrams_on_held_out_text(spark):
    rnd = random.Random(1)
    follow = {w: rnd.sample(range(300), 4) for w in range(300)}

    def walk(n):
        at, out = 0, []
        for _ in range(n):
            at = rnd.choice(follow[at])
            out.append(f"w{at}")
        return out

    texts = [walk(60) for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(7000 + i, " ".join(rnd.sample(t, len(t)))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = lambda i: LEARN(i) & (i < 7000)
    got = ngrams.score(df, learn).withColumn("held", ~learn(F.col("doc_id"))).collect()
    in_order = [r for r in got if r.held and r.doc_id < 7000]
    mixed = {r.doc_id - 7000: r for r in got if r.doc_id >= 7000}
    assert len(in_order) > 20 and all(r.score > r.base_score and r.score > mixed[r.doc_id].score for r in in_order)


def test_empty_and_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ngrams.score(df.limit(0), LEARN).count() == 0
    got = sorted(tuple(r) for r in ngrams.score(df, lambda i: F.lit(False)).collect())
    assert got == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
