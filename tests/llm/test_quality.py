"""Quality classifier: rules against plain evaluation, held-out accuracy, and the edge rows."""

import random

from pyspark.sql import functions as F

from tomeflow.llm import quality
from tomeflow.llm.common import learning_row


def learn(i):
    return learning_row(i, 5, 0)


def corpus():
    rnd = random.Random(1)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(240):
        n = rnd.choice([12, 80, 400])
        w = rnd.choices(vocab, k=n)
        if i % 4 == 0:
            w = [rnd.choice(vocab)] * n if i % 8 else [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 0 if i % 4 == 0 else 1))
    docs += [(1000, None, "en"), (1001, "", None), (None, " ".join(vocab[:50]), "en"), (1002, "ab " * 30000, "en"), (5, docs[5][1], "en")]
    labels += [(None, 1), (7, None), (2000, 1)]
    return docs, labels


def test_rules_and_edges(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*x, "mine") for x in docs], "doc_id long, text string, lang string, predicted string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.classify(d, lab, learn).withColumn("held", ~learn(F.col("doc_id"))).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {i: q for i, q in labels if q is not None}
    held = [r for r in rows if r.held and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert next(r for r in rows if r.doc_id == 1002).predicted == 0  # a very long repetition
    twice = [r.score for r in rows if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_paths_and_scores_equal_plain_python(spark):
    text = """x
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.0)
     If (feature 0 <= 2.0)
      Predict: 1.0
     Else (feature 0 > 2.0)
      Predict: 0.0
    Else (feature 0 > 5.0)
     Predict: 1.0
"""
    paths = quality.tree_paths(text, ("a", "b"))
    assert paths == {(("a", True, 5.0),), (("a", True, 2.0),), (("a", False, 2.0), ("a", True, 5.0)), (("a", False, 5.0),)}
    rules = quality.Rules(0.5, ((((("a", False, 2.0), ("a", True, 5.0))), -1.25),))
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 5.0, 6.0)], "a double")
    got = [r.s for r in df.select(rules.score(F.struct("a")).alias("s")).collect()]
    want = [1 / (1 + 2.718281828459045 ** -(0.5 - 1.25 * (2 < x <= 5))) for x in (1, 2, 3, 5, 6)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in quality.classify(d, none, learn).collect()] == [(0.5, 1)]
    assert quality.classify(d.limit(0), none, learn).count() == 0
