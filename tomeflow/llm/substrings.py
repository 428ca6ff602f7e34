"""Substring dedup by level-wise doubling: windows of words that repeat at one length alone are extended to twice that length,
until the full length is reached or no candidate survives.

At the first length only anchors are counted: of every full window the part of that length with the smallest hash. Equal windows
have equal anchors at equal offsets, so a window whose anchor is unique is unique, and about one word in ten is an anchor. At each
further length the surviving windows are tested by their beginning and their end of that length, last by themselves.

Counts are pre-aggregated, so a passage in a third of all rows is one number per task. What a count sends back are the *unique*
anchors and windows: a hash met once carries its own place, so nothing is joined back by hash and no level depends on size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm import rolling
from tomeflow.llm.common import small
from tomeflow.session import cut

WINDOW = 35
START = 18
#: Keys of rows are broadcast up to this count; beyond it Spark shuffles both sides.
SMALL_ROWS = 500_000

Batches = Iterator[pa.RecordBatch]


def raw_texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """UTF-8 bytes of every text, one at a time; null is empty."""
    for x in batch.column("text").cast(pa.large_binary()):
        yield x.as_py() or b""


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first(window: int, start: int) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        for batch in batches:
            n_words, digests, places, hashes = [], [], [], []
            for raw in raw_texts(batch):
                sums, n = rolling.word_sums(raw)
                at, h, _, _ = rolling.anchors(sums, n, window, start)
                n_words.append(n)
                digests.append(_digest(raw.split()))
                places.append(at.astype(np.int32))
                hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), lists(places, pa.int32()), lists(hashes, pa.int64())],
                ["row_key", "doc_id", "n_words", "sha", "places", "hashes"],
            )

    return work


def _candidates(sums: np.ndarray, n: int, window: int, start: int, alone: np.ndarray) -> np.ndarray:
    """Starts of the full windows whose anchor is none of ``alone``, the unique ones."""
    at, _, first, last = rolling.anchors(sums, n, window, start)
    good = ~np.isin(at, alone)
    return rolling.ranges(first[good], last[good])


def _survivors(starts: np.ndarray, window: int, length: int, unique: np.ndarray) -> np.ndarray:
    """Of ``starts`` those whose beginning and end of ``length`` words are both not ``unique``."""
    return starts[~(np.isin(starts, unique) | np.isin(starts + window - length, unique))]


def _level(window: int, start: int, done: list[int], length: int) -> Callable[[Batches], Batches]:
    """Hashes and places of the parts of ``length`` words that the candidates of the levels ``done`` have."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            alone = batch.column("alone").to_pylist()
            unique = [batch.column(f"unique_{k}").to_pylist() for k in done]
            hashes, places = [], []
            for i, raw in enumerate(raw_texts(batch)):
                sums, n = rolling.word_sums(raw)
                starts = _candidates(sums, n, window, start, np.array(alone[i] or [], np.int64))
                for k, u in zip(done, unique, strict=True):
                    starts = _survivors(starts, window, k, np.array(u[i] or [], np.int64))
                at = np.union1d(starts, starts + window - length)
                hashes.append(rolling.span(sums, at, at + length).view(np.int64))
                places.append(at.astype(np.int32))
            if hashes:
                keys = np.repeat(batch.column("row_key").to_numpy(), list(map(len, places)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(keys), pa.array(np.concatenate(places))], ["h", "row_key", "place"])

    return work


def _last(window: int, start: int, done: list[int]) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        for batch in batches:
            alone = batch.column("alone").to_pylist()
            unique = [batch.column(f"unique_{k}").to_pylist() for k in done]
            n_words, removed, digests, texts = [], [], [], []
            for i, raw in enumerate(raw_texts(batch)):
                sums, n = rolling.word_sums(raw)
                starts = _candidates(sums, n, window, start, np.array(alone[i] or [], np.int64))
                for k, u in zip(done, unique, strict=True):
                    starts = _survivors(starts, window, k, np.array(u[i] or [], np.int64))
                gone = rolling.covered(starts, window, n)
                found = raw.split()
                left = [found[j] for j in np.flatnonzero(~gone)]
                n_words.append(n)
                removed.append(int(gone.sum()))
                digests.append(_digest(left))
                texts.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.large_binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return work


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, start: int = START) -> tuple[DataFrame, DataFrame]:
    """Two tables. The first has row_key (hash of id and text), doc_id, n_words and sha (of all words) of the rows that stay whole. The second has
    doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words joined by one space) of the rows in which some word may
    have to go.

    A word goes if a window of ``window`` words over it also starts anywhere else, in the same or another row. Words are runs of
    anything but ASCII white space. Null and empty texts have no words; shorter texts than a window lose none; a repeated row
    counts as often as it is there, and an id may be null or repeat; an empty table gives empty results."""
    keyed = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    base = cut(keyed.mapInArrow(_first(window, start), f"row_key long, doc_id {kind}, n_words long, sha string, places array<int>, hashes array<long>"))
    at = base.select("row_key", F.explode(F.arrays_zip("places", "hashes")).alias("a")).select("row_key", F.col("a.places").alias("place"), F.col("a.hashes").alias("h"))
    once = at.groupBy("h").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min("place").alias("place")).where("n = 1")
    alone = once.groupBy("row_key").agg(F.collect_list("place").alias("alone"))
    anchored = base.groupBy("row_key").agg(F.max(F.size("places")).alias("anchors")).where("anchors > 0")
    marks = cut(anchored.join(alone, "row_key", "left").where(F.coalesce(F.size("alone"), F.lit(0)) < F.col("anchors")).drop("anchors"))
    length, done = start, []
    while length < window:
        length = min(2 * length, window)
        # only rows that still have candidates are read on; texts pass one shuffle, by row
        alive = keyed.join(small(marks.select("row_key"), SMALL_ROWS), "row_key", "left_semi").join(marks, "row_key")
        parts = alive.select("row_key", "text", "alone", *(f"unique_{k}" for k in done)).mapInArrow(_level(window, start, list(done), length), "h long, row_key long, place int")
        alone = parts.groupBy("h").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min("place").alias("place")).where("n = 1")
        unique = cut(alone.groupBy("row_key").agg(F.collect_list("place").alias(f"unique_{length}")))
        marks = cut(marks.join(unique, "row_key", "left"))
        done.append(length)
    final = keyed.join(small(marks.select("row_key"), SMALL_ROWS), "row_key", "left_semi").join(marks, "row_key")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    changed = final.select("doc_id", "text", "alone", *(f"unique_{k}" for k in done)).mapInArrow(_last(window, start, done), schema)
    return base.select("row_key", "doc_id", "n_words", "sha").join(small(marks.select("row_key"), SMALL_ROWS), "row_key", "left_anti"), changed


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, start: int = START) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (see ``repeated_windows``)."""
    whole, changed = repeated_windows(docs, text, doc_id, window, start)
    return whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")).unionByName(changed.drop("kept_text"))
