"""Embedding near-dedup with randomised-rotation binary codes.

Every vector is rotated by random orthogonal matrices and stored as the signs (one bit a dimension) with a correction factor, the
inner product of the unit vector with its own code. With it, the code of one vector and the rotated other, rounded to a byte a
dimension, give an unbiased estimate of their inner product and a confidence bound; only pairs whose upper bound reaches the
threshold are computed exactly, in double precision, so no link below the threshold is ever reported.

What travels to the buckets are codes and bytes, not vectors. A vector is fetched, by its own key, only for a bucket in which the
codes leave it undecided with some other.

Pairs meet in buckets of equal code bits (``bands``). The number of bits grows with the logarithm of the number of vectors, the
number of bands with it, so that a pair at the threshold is missed with a chance of at most ``MISS`` and work grows little
faster than the input. A bucket with more than ``TILE`` vectors is dealt out as pairs of tiles. No pair is ever a row: a task
sends back, per vector, how many it linked and the smallest vector it reached."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import components, small
from tomeflow.session import cut

THRESHOLD = 0.95
MISS = 1e-4
#: Standard deviations of the estimate's error that the confidence bound allows for.
CONFIDENCE = 4.0
BUCKET = 32
TILE = 1024
SMALL_ROWS = 1_000_000
SEED = 23

Batches = Iterator[pa.RecordBatch]


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a bucket's key and number of bands for ``n`` vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(n, 2) / BUCKET)))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same**bits)))


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of ``count`` rotations side by side (one bool a dimension and rotation), and the correction factor and the rotated unit
    vector of the first."""
    unit, signs, factor, first = _unit(x), [], None, None
    for k in range(count):
        turned = unit @ rotation(x.shape[1], k).T
        signs.append(turned > 0)
        if k == 0:
            factor, first = np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1]), turned
    return np.concatenate(signs, axis=1), factor, first


def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as whole numbers from -127 to 127, and the step of each row."""
    step = np.abs(turned).max(axis=1) / 127
    return np.rint(turned / step[:, None]).astype(np.int8), step


def _coded(bits: int, bands: int):
    """One row per vector and band: bucket, band, node, dim, code of the first rotation, factor, bytes and step of the rotated
    vector."""

    def work(batches: Batches) -> Batches:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                x = np.asarray(batch.column("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                signs, factor, turned = encode(x, -(-bits * bands // int(dim)))
                keys = band_keys(signs, bits, bands)
                codes = pa.array([r.tobytes() for r in np.packbits(signs[:, :dim], axis=1)], pa.binary())
                near, step = rounded(turned)
                bytes_ = pa.array([r.tobytes() for r in near], pa.binary())
                for b in range(bands):
                    bucket = (keys[:, b].astype(np.int64) * bands + b) * 65_537 + int(dim)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), pa.array(np.full(len(x), b, np.int32)), batch.column("node"), batch.column("dim"), codes, pa.array(factor), bytes_, pa.array(step)],
                        ["bucket", "band", "node", "dim", "code", "factor", "turned", "step"],
                    )

    return work


def _upper(signs: np.ndarray, turned: np.ndarray, factor: np.ndarray, step: np.ndarray | float) -> np.ndarray:
    """Upper bounds (row: the code's vector, column: the rotated one) on all inner products."""
    dim = signs.shape[1]
    estimate = (np.where(signs, 1.0, -1.0) @ turned.T) / (math.sqrt(dim) * factor[:, None])
    spread = np.maximum(0.0, 1 - factor**2) / max(1, dim - 1)
    return estimate + CONFIDENCE * np.sqrt((spread[:, None] + np.square(step) / 12) / (factor**2)[:, None])


def _undecided(rows: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """The vectors of one bucket, or pair of tiles, that the codes do not keep apart from all others."""
    dim, side = rows.column("dim")[0].as_py(), rows.column("side").to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(side), -1), axis=1)[:, :dim].astype(bool)
    step = rows.column("step").to_numpy()
    turned = np.frombuffer(b"".join(rows.column("turned").to_pylist()), np.int8).reshape(len(side), dim) * step[:, None]
    upper = _upper(bits, turned, rows.column("factor").to_numpy(), step[None, :])
    asked = np.maximum(upper, upper.T) >= threshold
    np.fill_diagonal(asked, False)
    if side.any():
        asked &= side[:, None] != side[None, :]
    hit = np.flatnonzero(asked.any(axis=1))
    return rows.select(["cell", "side", "band", "node"]).take(pa.array(hit)).combine_chunks().to_batches()[0] if len(hit) else None


def band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Key of every band: ``bits`` bits of the code each, no bit in two bands."""
    used = signs[:, : bits * bands].reshape(len(signs), bands, bits)
    return used @ (1 << np.arange(bits, dtype=np.int64))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(rows: pa.Table, bits: int, bands: int, threshold: float) -> pa.RecordBatch | None:
    """Links within one bucket or pair of tiles, less those an earlier band has found."""
    rows = rows.sort_by("node")
    node, side, weight = (rows.column(c).to_numpy() for c in ("node", "side", "weight"))
    x = np.asarray(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(node), -1)
    dim, band, unit = x.shape[1], rows.column("band")[0].as_py(), _unit(x)
    code, factor, turned = encode(x, -(-bits * bands // x.shape[1]))
    upper = _upper(code[:, :dim], turned, factor, 0.0)
    asked = np.triu(np.maximum(upper, upper.T) >= threshold, 1)
    if side.any():
        asked &= side[:, None] != side[None, :]
    i, j = np.nonzero(asked)
    if not len(i):
        return None
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        good[part] = (unit[i[part]] * unit[j[part]]).sum(axis=1) >= threshold
    i, j = i[good], j[good]
    if band and len(i):
        keys = band_keys(code, bits, bands)[:, :band]
        fresh = np.ones(len(i), bool)
        for b in range(band):
            fresh &= keys[i, b] != keys[j, b]
        i, j = i[fresh], j[fresh]
    if not len(i):
        return None
    n = np.zeros(len(node), np.int64)
    np.add.at(n, i, weight[j])
    np.add.at(n, j, weight[i])
    root = _roots(len(node), i, j)
    hit = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(n[hit]), pa.array(node[root[hit]])], ["node", "n", "root"])


def _by_cell(one):
    """``one`` on each cell of rows sorted by cell; a cell holds one bucket, or two tiles of one."""

    def work(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            starts = np.append(np.flatnonzero(np.diff(cell, prepend=~cell[0])), len(cell))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if held and held[0].column("cell")[0] != part.column("cell")[0]:
                    if (rows := pa.Table.from_batches(held)).num_rows > 1 and (out := one(rows)) is not None:
                        yield out
                    held = []
                held.append(part)
        if held and (rows := pa.Table.from_batches(held)).num_rows > 1 and (out := one(rows)) is not None:
            yield out

    return work


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept
    (vec_id = component_id).

    Two rows link if the cosine of their vectors, in double precision, is ``threshold`` or more. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are one
    node that counts as many; repeated ids are rows of their own. A row without an id counts as a link, but names no component;
    it is kept unless its component has a named row. An empty table gives an empty result."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    read = cut(vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, v.cast(f"array<{kind}>")).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))))
    nodes = cut(read.where("vector is not null").groupBy("node", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first")))
    bits, bands = plan(nodes.count(), threshold, miss)
    coded = nodes.select("node", F.size("vector").alias("dim"), "vector").mapInArrow(
        _coded(bits, bands), "bucket long, band int, node long, dim int, code binary, factor double, turned binary, step double"
    )
    full = cut(coded.groupBy("bucket").count().where(F.col("count") > tile).select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    dealt = coded.join(small(full, SMALL_ROWS), "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cell = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = dealt.select(cell.alias("cell"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "band", "node", "dim", "code", "factor", "turned", "step")
    left = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_cell(lambda rows: _undecided(rows, threshold)), "cell long, side int, band int, node long")
    fetched = cut(left).join(nodes.select("node", "weight", "vector"), "node").select("cell", "side", "band", "node", "weight", "vector")
    found = cut(fetched.repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_cell(lambda rows: _linked(rows, bits, bands, threshold)), "node long, n long, root long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = nodes.select("node", "weight", "first").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(roots, "node", "left")
    placed = cut(counted.select("node", "first", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    named = placed.join(small(least, SMALL_ROWS), "root").select("node", "n_links", "component_id")
    out = read.select("vec_id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
