"""SimHash near-dedup with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 3 bits, cut into 2 segments of 32 bits, agree in one segment up to one bit.
So each distinct fingerprint is indexed under every one-wildcard variant of both segments (64 keys); an equality on such a key
finds every pair, and the full distance is then verified.

Groups never expand into pairs. A key met once is dropped after a pre-aggregated count; a key met twice is one pair, its minimum
and maximum; larger groups give one star per connected part, found with whole-array distances. A key with more than
``hot`` fingerprints is first cut again by one-wildcard variants of the halves of the *other* segment (they differ in at most 3
bits, so one half differs in at most one); such a group holds at most 2**18 fingerprints whatever the input, so no task is
unbounded and no link is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import components, small
from tomeflow.session import cut

SEED = 42
WIDTH = 3
DISTANCE = 3
HOT = 4096
#: Keys of large groups and of dropped rows are broadcast up to this count; beyond it Spark shuffles both sides.
GONE_ROWS = 500_000


def fingerprint_of(text: str | None) -> int:
    """Signed 64-bit fingerprint of one text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1).tolist()
    stops = (ends[min(WIDTH, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """64-bit SimHash (long) of the ``WIDTH``-word shingles of ``text``, A-Z lower-cased; repeats count; fewer words: the whole
    sequence; no words or null: zero."""

    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(x) for x in batch], dtype="int64")

    return udf(text)


def variants(value: Column, bits: int, tag: Column | None = None) -> Column:
    """Array of the one-wildcard variants of the two halves of ``value`` (2 * bits bits): half, place and the half without that bit."""
    keys = []
    for half in range(2):
        part = F.shiftrightunsigned(value, half * bits).bitwiseAND(F.lit((1 << bits) - 1))
        for place in range(bits):
            masked = part.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << place)))
            key = masked.bitwiseOR(F.lit((half * bits + place) << bits))
            keys.append(key if tag is None else F.xxhash64(tag, key))
    return F.array(*keys)


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest value of each connected part of ``values`` (under the distance limit) to the others. Each value is
    compared with those not reached yet."""
    left, a, b = np.unique(values).astype(np.int64).view(np.uint64), [], []  # bit counts of signed numbers ignore the sign
    while len(left):
        root, stack, left = left[0], [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            near = np.bitwise_count(left ^ u) <= DISTANCE
            if near.any():
                got = left[near]
                left = left[~near]
                a.append(np.full(len(got), root))
                b.append(got)
                stack.extend(got)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (none, none)


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for group in batch["fps"]:
            a, b = forest(np.asarray(group, np.int64))
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})


def _grouped(keyed: DataFrame) -> DataFrame:
    groups = keyed.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return groups.mapInPandas(_forests, "a long, b long")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp long) that connect exactly what lies within ``DISTANCE`` bits."""
    keyed = fps.select("fp", F.explode(variants(F.col("fp"), 32)).alias("key"))
    met = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = met.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    wide = keyed.join(small(met.where("n > 2").select("key", "n"), GONE_ROWS), "key")
    other = F.when(F.shiftrightunsigned(F.col("key"), 32) >= 32, F.col("fp")).otherwise(F.shiftrightunsigned(F.col("fp"), 32)).bitwiseAND(F.lit((1 << 32) - 1))
    cut_again = wide.where(F.col("n") > hot).select("fp", F.explode(variants(other, 16, F.col("key"))).alias("key"))
    return pairs.union(_grouped(wide.where(F.col("n") <= hot))).union(_grouped(cut_again)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Rows with equal fingerprints are one node, so exact copies cost nothing. Null and empty texts have fingerprint zero and link
    like any other; repeated rows give repeated results; a null doc_id keeps its row and gets the component of its fingerprint
    (null if no row of it has an id). An empty table gives an empty result; other columns are ignored."""
    return _placed(docs, text, doc_id, hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(docs: DataFrame, text: str, doc_id: str, hot: int = HOT) -> DataFrame:
    """row_key (hash of id and text), doc_id, fp, root (a fingerprint of the component), component_id of every row."""
    read = cut(docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    nodes = cut(read.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), hot))
    placed = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    named = placed.join(small(least, GONE_ROWS), "root")  # no aggregation beside the join, so that Spark can split a large component
    return read.join(named, "fp")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the smallest id (of several texts under that id the one with
    the smallest hash; of equal rows any). Rows of a group without any id all stay. Columns stay as they are.

    Rows to go are met by their hash; they are broadcast only up to ``GONE_ROWS``, else texts pass one shuffle."""
    found = cut(_placed(docs, text, doc_id).where("component_id is not null").select("row_key", "doc_id", "root", "component_id"))
    winner = found.where("doc_id = component_id").groupBy("root").agg(F.min("row_key").alias("first"))
    met = found.groupBy("root", "row_key").agg(F.count("*").alias("n")).join(winner, "root")
    fate = cut(met.select(F.col("row_key").alias("__key"), (F.col("row_key") != F.col("first")).alias("gone"), "n").where("gone or n > 1").distinct())
    keyed = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))
    left = keyed.join(small(fate.where("gone").select("__key"), GONE_ROWS), "__key", "left_anti")
    twice = fate.where("not gone").select("__key")
    if not twice.isEmpty():
        once = left.join(small(twice, GONE_ROWS), "__key", "left_anti")
        left = once.unionByName(left.join(small(twice, GONE_ROWS), "__key", "left_semi").dropDuplicates(["__key"]))
    return left.drop("__key")
