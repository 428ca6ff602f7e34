"""Raking against a plain loop, draws against their rates, and the edge rows."""

import random

import numpy as np

from tomeflow.llm import mixing


def plain_rake(tokens, shares, rounds=400):
    """tokens: array over the dimensions; shares: one array per dimension."""
    mass = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, share in enumerate(shares):
            have = mass.sum(axis=tuple(k for k in range(mass.ndim) if k != axis), keepdims=True)
            aim = (share / share.sum()).reshape([-1 if k == axis else 1 for k in range(mass.ndim)])
            mass = np.where(mass > 0, mass * aim / np.where(have > 0, have, 1), 0)
    return mass


def test_rake_equals_plain_loop(spark):
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 900, (4, 3, 2))
    shares = [rng.random(k) + 0.1 for k in tokens.shape]
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(tokens[a, b, c])) for a, b, c in np.ndindex(tokens.shape)], "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame([(f"{d[0]}{k}", float(x)) for k, x in enumerate(s)], "value string, share double") for d, s in zip(mixing.DIMENSIONS, shares, strict=True)}
    got = mixing.rake(cells, targets, tolerance=1e-10).collect()
    want = plain_rake(tokens, shares)
    assert all(abs(r.mass - want[int(r.source[1]), int(r.lang[1]), int(r.topic[1])]) < 1e-8 for r in got) and len(got) == tokens.size


def test_mix_meets_targets_and_edges(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 60)), rnd.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 5}", 9) for i in range(600)]
    rows += [(1000, None, "en", "hot", 9), (1001, "", "en", "hot", 9), (None, "a b", "en", None, 9), (3, rows[3][1], rows[3][2], rows[3][3], 9), (1002, "w " * 30000, "de", "hot", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    topics = spark.createDataFrame([(i, str(i % 4)) for i in range(0, 600, 2)] + [(2, "9"), (None, "1")], "doc_id long, topic string")
    got = mixing.mix(docs, topics).collect()
    assert len(got) == len(rows)
    total = sum(r.tokens for r in got)
    for name in mixing.DIMENSIONS:
        sums, drawn = {}, {}
        for r in got:
            v = r[name] or mixing.NONE
            sums[v] = sums.get(v, 0) + r.tokens
            drawn[v] = drawn.get(v, 0) + r.tokens * r.rate
        power = {v: t ** mixing.POWERS[name] for v, t in sums.items() if t}
        for v, p in power.items():
            assert abs(drawn[v] / total - p / sum(power.values())) < 1e-3
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].rate == by_id[1001].rate == 0 and by_id[1000].copies == 0 and by_id[2].topic == "9" and by_id[1].topic == mixing.NONE
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 and r.probability == min(1, r.rate) for r in got)
    twice = [r.copies for r in got if r.doc_id == 3]
    assert twice[0] == twice[1] and abs(sum(r.copies for r in got) - sum(r.rate for r in got)) < 60
    assert mixing.mix(docs.limit(0), topics).count() == 0


def test_targets_of_absent_or_barred_values(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "x", 30), ("c", "x", 5), ("a", "y", 0)], "source string, lang string, tokens long")
    to = lambda rows: spark.createDataFrame(rows, "value string, share double")
    got = {(r.source, r.lang): r.mass for r in mixing.rake(cells, {"source": to([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 0.0), ("zz", 5.0)]), "lang": to([("x", 1.0), ("y", 1.0)])}).collect()}
    assert got == {("a", "x"): 0.25, ("b", "x"): 0.75, ("c", "x"): 0.0, ("a", "y"): 0.0}


def test_rounds_go_on_until_met_or_hopeless(spark):
    """Nearly empty cells converge slowly and are met all the same; targets that contradict each other end and say so."""
    to = lambda rows: spark.createDataFrame(rows, "value string, share double")
    half = {"source": to([("a", 1.0), ("b", 1.0)]), "lang": to([("x", 1.0), ("y", 1.0)])}
    slow = spark.createDataFrame([("a", "x", 1_000_000), ("a", "y", 1), ("b", "x", 3), ("b", "y", 900_000)], "source string, lang string, tokens long")
    got = mixing.rake(slow, half).collect()
    assert {r.off for r in got} == {got[0].off} and got[0].off <= mixing.TOLERANCE
    sparse = spark.createDataFrame([("a", "x", 10), ("a", "y", 10), ("b", "x", 10)], "source string, lang string, tokens long")
    uneven = mixing.rake(sparse, {"source": to([("a", 1.0), ("b", 3.0)]), "lang": to([("x", 1.0), ("y", 3.0)])}).collect()
    by_lang = {}
    for r in uneven:
        by_lang[r.lang] = by_lang.get(r.lang, 0) + r.mass
    assert uneven[0].off > 0.1 and abs(by_lang["y"] - 0.75) < 1e-9


def test_columns_with_internal_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "mine", 2, 3)], "doc_id long, text string, lang string, source string, __topic string, topic int, id int")
    topics = spark.createDataFrame([(1, "t")], "doc_id long, topic string")
    got = mixing.mix(docs, topics).collect()
    assert [(r["__topic"], r.topic, r.id, r.tokens) for r in got] == [("mine", "t", 3, 2)]
