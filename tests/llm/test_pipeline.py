"""The whole pipeline against plain Python: fixed rules for the classifier, loops for every other stage."""

import random

import numpy as np
import xxhash
from test_decontaminate import plain as plain_held
from test_mixing import plain_rake
from test_secrets import plain_candidates
from test_simhash import plain_components, plain_fingerprint

import __spark_entry__ as entry
import corpus_pipeline
from tomeflow.llm import mixing, quality, secrets


def hash_of(doc_id, text):
    h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), 42) if doc_id is not None else 42
    h = xxhash.xxh64_intdigest(text.encode(), h) if text is not None else h
    return xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), h)


def fixture():
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdefghé", k=rnd.randint(2, 7))) for _ in range(400)]
    bench = [(i, " ".join(rnd.choices(vocab, k=25))) for i in range(4)]
    docs = []
    for i in range(150):
        w = rnd.choices(vocab, k=rnd.randint(60, 200))
        if i % 10 == 0:
            w = [x + "!!" for x in w]
        elif i % 10 == 1:
            w[30:30] = bench[i % 4][1].split()
        elif i % 10 == 2:
            w[5:5] = ["password=" + "".join(rnd.choices("0123456789abcdef", k=20)), "".join(rnd.choices("0123456789", k=16))]
        docs.append((i, " ".join(w), rnd.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 4}"))
        if i % 7 == 0:
            docs.append((1000 + i, docs[-1][1].upper(), "en", "hot"))
        if i % 9 == 0:
            docs.append((2000 + i, docs[-1][1], "de", None))
    docs += [(3000, None, "en", "s1"), (3001, "", "en", "s1")]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    return docs, bench, [(i, int(i % 10 != 0), 0) for i in range(0, 150, 2)], [(i, [1.0, 0.0], i % 3) for i in range(0, 150, 2)]


def test_run_equals_plain(spark, tmp_path, monkeypatch):
    docs, bench, labels, vectors = fixture()
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars int"), ("benchmark", bench, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(quality, "fit", lambda *_: quality.Rules(-2.0, (((("marks_per_word", True, 0.5),), 4.0),)))
    got = {r.doc_id: r.asDict() for r in entry.queries()["pipeline"](spark, str(tmp_path)).collect()}

    at = quality.STATS.index("marks_per_word")
    kept = [d for d in docs if quality.stats_of(d[1])[at] <= 0.5]
    comp = plain_components({d[0]: plain_fingerprint(d[1]) for d in kept})
    kept = [d for d in kept if comp[d[0]] == d[0]]
    held = {i for i, _ in plain_held([(d[0], d[1]) for d in kept], bench)}
    kept = [d for d in kept if d[0] not in held]
    masked = []
    for i, t, lang, source, n in kept:
        for _, _, c in plain_candidates(t):
            if "password=" + c.lower() in t.lower():
                t = t.replace(c, "[SECRET]")
        masked.append((i, t, lang, source, len(t) if t is not None else n))
    topic = {i: str(label) for i, _, label in vectors}
    cells = [(d[3] or mixing.NONE, d[2] or mixing.NONE, topic.get(d[0], mixing.NONE)) for d in masked]
    size = [len((d[1] or "").split()) for d in masked]
    names = [sorted({c[k] for c in cells}) for k in range(3)]
    table = np.zeros([len(x) for x in names])
    for c, n in zip(cells, size, strict=True):
        table[tuple(names[k].index(c[k]) for k in range(3))] += n
    shares = [table.sum(axis=tuple(a for a in range(3) if a != k)) ** mixing.POWERS[d] for k, d in enumerate(mixing.DIMENSIONS)]
    mass = plain_rake(table, shares)
    want = {}
    for d, c, n in zip(masked, cells, size, strict=True):
        where = tuple(names[k].index(c[k]) for k in range(3))
        rate = table.sum() * mass[where] / table[where] if n else 0.0
        unit = (hash_of(d[0], d[1]) >> 11) / (1 << 53)
        if abs(unit - rate % 1) < 1e-3:
            continue  # the draw hangs on the last digits of the raking
        copies = int(rate) + (unit < rate - int(rate))
        if copies:
            want[d[0]] = (d[1], d[4], copies)
        else:
            assert d[0] not in got
    assert want and {i: (got[i]["text"], got[i]["n_chars"], got[i]["copies"]) for i in want} == want
    assert not set(got) - {d[0] for d in masked}


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, bench, labels, vectors = fixture()
    for name, rows, schema in (("benchmark", bench, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.dtypes == none.dtypes and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
    assert secrets.THRESHOLD == 0.5
