"""Embedding near-dedup against all pairs in double precision."""

import math

import numpy as np
import pytest

from tomeflow.llm import embeddings


def plain(rows, threshold=0.95):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, a in enumerate(good):
        for b in good[p + 1 :]:
            x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
            if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        comp = min(ids) if ids else i
        out.append((i, links[k], comp, comp is None or i == comp))
    return sorted(out, key=str)


def fixture():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    for k in range(200):
        v = base[rng.integers(0, 60)]
        v = v / np.linalg.norm(v) + rng.standard_normal(16) * rng.choice([0.01, 0.05, 0.08]) / 2
        rows.append((100 + k, (v * rng.choice([0.1, 1, 30])).astype(np.float32).tolist()))
    rows += [(400 + k, rows[5][1]) for k in range(90)]  # a third of all rows are one vector
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[7][1]), (3, rows[9][1]), (3, rows[3][1]), (None, [0.0] * 16)]
    return rows


@pytest.mark.parametrize("tile", [1024, 8])
def test_equals_all_pairs(spark, tile):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, node int, label int")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df, tile=tile).collect()), key=str)
    assert got == plain(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 400, 64))
    y = x * 0.8 + y * 0.6
    signs, factor, _ = embeddings.encode(x, 1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    turned = unit(y) @ embeddings.rotation(64, 0).T
    estimate = (np.where(signs, 1.0, -1.0) * turned).sum(axis=1) / (8 * factor)
    error = estimate - (unit(x) * unit(y)).sum(axis=1)
    bound = embeddings.CONFIDENCE * np.sqrt((1 - factor**2) / (factor**2 * 63))
    assert abs(error.mean()) < 0.02 and (np.abs(error) <= bound).all()


def test_bytes_of_rotated_vectors_keep_the_bounds():
    """Codes and bytes alone: no pair at the threshold falls short of its bound, most others do."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    y = x + rng.standard_normal((300, 64)) * 0.25
    signs, factor, _ = embeddings.encode(x, 1)
    near, step = embeddings.rounded(embeddings.encode(y, 1)[2])
    assert near.dtype == np.int8 and np.abs(near).max() == 127
    upper = embeddings._upper(signs, near * step[:, None], factor, step[None, :])
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit(x) @ unit(y).T
    assert (upper >= cosine - 1e-9).mean() > 0.9998 and (upper[cosine >= 0.95] >= 0.95).all() and (upper[cosine < 0.5] < 0.95).mean() > 0.98


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
