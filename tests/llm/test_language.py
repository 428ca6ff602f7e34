"""Cross-parsing language identification against a plain parse, on held-out rows, and the edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.llm import language
from tomeflow.llm.common import learning_row

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ström", "gård", "ung", "ei"], "cc": ["qué", "ción", "ar", "ez"]}


def say(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def plain_phrases(word, sample):
    count, i = 0, 0
    while i < len(word):
        n = 1
        while i + n < len(word) and word[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_parse_equals_plain_loop():
    rnd = random.Random(2)
    samples = {k: [say(rnd, k, 30)] for k in SYLLABLES}
    model = language.Model(samples)
    texts = [say(rnd, rnd.choice(list(SYLLABLES)), rnd.randint(0, 30)) + rnd.choice(["", " Ωδ x!", "123"]) for _ in range(40)] + ["", "7 8", "KALO", "a", "b"]
    counts, letters = model.parse(texts)
    for t, row, n in zip(texts, counts.tolist(), letters.tolist(), strict=True):
        assert n == sum(c.isalpha() for c in t)
        want = [sum(plain_phrases(w, language.letters_of(samples[k][0])) for w in language.letters_of(t).split()) for k in model.names]
        assert row == want, t


@pytest.mark.parametrize("most", [400, 12])
def test_held_out_and_edges(spark, monkeypatch, most):
    monkeypatch.setattr(language, "ROWS", most)
    rnd = random.Random(4)
    rows = [(i, say(rnd, lang, rnd.choice([3, 20, 200])), lang, "s") for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=120))]
    rows += [(500, None, "aa", None), (501, "", "aa", "s"), (502, "1234 !!", "bb", "s"), (None, say(rnd, "aa", 9), "aa", "s"), (503, say(rnd, "bb", 9), None, "s"), (504, "ström " * 40000, None, "s"), (7, rows[7][1], rows[7][2], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    learned = lambda i: learning_row(i, 3, 1)
    got = language.identify(df, learned).withColumn("held", ~learned(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    held = [r for r in got if r.held and r.lang and r.lang_pred != "und"]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert next(r for r in got if r.doc_id == 504).lang_pred == "bb"


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(df, lambda i: F.lit(True)).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), lambda i: F.lit(True)).count() == 0


def test_shared_openings_do_not_hide_the_language(spark):
    """All documents begin with the same 2,000 characters, more than a sampled stretch."""
    rnd = random.Random(6)
    opening = (say(rnd, "aa", 700) + " ")[:2000]
    rows = [(i, opening + say(rnd, lang, 120), lang) for i, lang in enumerate(rnd.choices(["bb", "cc"], k=300))]
    learned = lambda i: learning_row(i, 3, 1)
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned).where(~learned(F.col("doc_id"))).collect()
    assert len(got) > 60 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_three_hundred_languages(spark, monkeypatch):
    """Every labelled language is learned, in several passes over the texts, and the passes agree with a single one."""
    rnd = random.Random(8)
    vocab = {f"l{k:03d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(8)] for k in range(300)}
    rows = [(i, " ".join(rnd.choices(vocab[lang], k=12)), lang) for i, lang in enumerate(sorted(vocab) * 4)] + [(9000, None, "l000"), (9001, "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    learned = lambda i: learning_row(i, 3, 1)
    got = {r.doc_id: (r.lang, r.lang_pred, round(r.score, 9)) for r in language.identify(df, learned).collect()}
    held = [v for i, v in got.items() if i < 9000]
    assert sum(a == b for a, b, _ in held) / len(held) > 0.95 and len({b for _, b, _ in held}) > 280
    monkeypatch.setattr(language, "ALL_LETTERS", 20_000)
    again = {r.doc_id: (r.lang, r.lang_pred, round(r.score, 9)) for r in language.identify(df, learned).collect()}
    same = sum(got[i] == again[i] for i in got)
    assert same / len(got) > 0.99 and again[9000][1:] == again[9001][1:] == ("und", 0.0)
