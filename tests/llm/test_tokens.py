"""Token attribution against a plain loop over tokens and sections, and exact totals."""

import random
from pathlib import Path

import pytest

from tomeflow.llm import tokens

RANKS = Path(tokens.VOCABULARY).read_bytes()


def plain(text, sections, rule):
    encoding, _ = tokens.encoder(RANKS)
    raw = text.encode()
    char = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = {}, 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        chars = sorted(set(char[at : at + size]))
        at += size
        share = {k: sum(a <= c < b for c in chars) for k, (a, b) in enumerate(sections)}
        if rule == "first":
            pick = next((k for k, (a, b) in enumerate(sections) if a <= chars[0] < b), -1)
        else:
            pick = max(share, key=lambda k: (share[k], -sections[k][0]), default=-1)
            pick = pick if pick >= 0 and share[pick] else -1
        out[pick] = out.get(pick, 0) + 1
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_equals_plain_loop(spark, rule):
    rnd = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        text = "".join(rnd.choices(["the ", "quality", "é", "ß", "\n", "日本", "😀", " 1234", "!!", "unbelievable"], k=rnd.randint(0, 60)))
        marks = sorted(rnd.sample(range(len(text) + 1), min(len(text), rnd.randint(0, 8))))
        sections = list(zip(marks[::2], marks[1::2], strict=False))
        rows.append((i, text, [(a, b) for a, b in sections], "x"))
        want |= {(i, k): n for k, n in plain(text, sections, rule).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:long,stop:long>>, section string")
    got = tokens.token_counts(df, sections="sections", rule=rule).collect()
    assert {(r.doc_id, r.section): r.n_tokens for r in got if r.n_tokens} == want
    lines = tokens.token_counts(df, rule=rule).collect()
    for i, text, _, _ in rows:
        mine = sorted((r for r in lines if r.doc_id == i), key=lambda r: r.section)
        assert "".join(text[r.start : r.stop] for r in mine) == text and len(mine) == text.count("\n") + 1
        assert sum(r.n_tokens for r in mine) == len(tokens.encoder(RANKS)[0].encode_ordinary(text))


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 50000), (4, "z" * 5000), (4, "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.section, r.start, r.stop, r.n_tokens) for r in tokens.token_counts(df).collect()), key=str)
    assert (1, 0, 0, 0, 0) in got and (2, 0, 0, 0, 0) in got and (None, 0, 0, 3, 2) in got
    assert next(g for g in got if g[0] == 3)[4] == 50001 and sum(g[0] == 4 for g in got) == 2
    spans = spark.createDataFrame([(3, 0, 6), (3, 4, 9), (3, -5, 2), (9, 0, 1), (4, None, 2)], "doc_id long, start long, stop long")
    met = tokens.token_counts(tokens.gathered(df, spans), sections="sections").where("doc_id = 3").collect()
    assert sorted((r.section, r.start, r.stop) for r in met) == [(-1, 0, 250000), (0, 0, 2), (1, 2, 6), (2, 6, 9)]
    assert sum(r.n_tokens for r in met) == 50001
    assert tokens.token_counts(df.limit(0)).count() == 0
