"""Byte-wise dedup of long repeats by prefix-free parsing.

Rolling-hash triggers cut every text into phrases that overlap by less than a window: the trigger of a window is its part of
``PART`` bytes with the smallest rolling hash, and a phrase is the stretch of all windows with one trigger. Equal windows have equal triggers at
equal offsets, so the parse decides nearly all windows at once:

- a trigger met once: its windows are nowhere else;
- a trigger whose phrases are all equal (one entry of the dictionary): every phrase after the first goes whole;
- a trigger in different phrases: equal phrases go as before, and only the first of each dictionary entry is looked into: the
  windows (suffixes of the phrase, cut at the window's length) of the trigger's entries are brought into order, and of equal ones
  all but the earliest go.

The order needed is that of equal strings and places only, so suffixes are ordered by a 64-bit hash of their 100 bytes together
with the trigger's; texts, parse and dictionary stay distributed throughout. A trigger with more than ``HOT`` dictionary entries
(a very common passage) is not brought into one task: its windows are rows of a pre-aggregated count instead."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm import rolling
from tomeflow.llm.common import small
from tomeflow.llm.substrings import lists, raw_texts
from tomeflow.session import cut

WINDOW = 100
PART = 32
HOT = 2000
SMALL_ROWS = 200_000
#: Bytes of phrases a task orders at a time, besides the phrases of one trigger, and phrases it sends back at a time.
CHUNK = 1 << 20
PIECES = 20_000
LAST = (1 << 63) - 1

Batches = Iterator[pa.RecordBatch]


def _phrases(raw: bytes, window: int, part: int) -> tuple[np.ndarray, ...]:
    """Running sums, places and hashes of the triggers, first and last window start of each phrase, and the hashes of the phrases."""
    sums = rolling.byte_sums(raw)
    at, trigger, first, last = rolling.anchors(sums, len(raw), window, part)
    phrase = rolling.mix(rolling.span(sums, first, last + window) + rolling.mix((at - first).astype(np.uint64)))
    return sums, at, trigger, first, last, phrase


def _parse(window: int, part: int):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            sizes, digests, local, places, triggers, phrases = [], [], [], [], [], []
            for raw in raw_texts(batch):
                _, at, trigger, _, _, phrase = _phrases(raw, window, part)
                _, once = np.unique(trigger ^ rolling.mix(phrase), return_index=True)
                once.sort()  # of equal phrases in one text the first stands for all
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                local.append(len(np.unique(trigger)) < len(trigger))
                places.append(at[once].astype(np.int32))
                triggers.append(trigger[once].view(np.int64))
                phrases.append(phrase[once].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(local, pa.bool_()), lists(places, pa.int32()), lists(triggers, pa.int64()), lists(phrases, pa.int64())],
                ["row_key", "doc_id", "n_bytes", "sha", "local", "places", "triggers", "phrases"],
            )

    return work


def _entries(window: int, part: int):
    """Bytes of the phrases listed in ``firsts`` (place, trigger): row_key, ord, trigger, start, piece."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            firsts = batch.column("firsts")
            owner, triggers, starts, pieces = [], [], [], []
            for i, raw in enumerate(raw_texts(batch)):
                _, at, trigger, first, last, _ = _phrases(raw, window, part)
                pick = np.flatnonzero(np.isin(at, np.array(firsts[i].as_py(), np.int64)))
                owner.append(np.full(len(pick), i))
                triggers.append(trigger[pick].view(np.int64))
                starts.append(first[pick].astype(np.int32))
                pieces += [raw[x:y] for x, y in zip(first[pick].tolist(), (last[pick] + window).tolist(), strict=True)]
                if len(pieces) >= PIECES or i == batch.num_rows - 1:
                    of = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_key").take(of), batch.column("ord").take(of), pa.array(np.concatenate(triggers)), pa.array(np.concatenate(starts)), pa.array(pieces, pa.binary())],
                        ["row_key", "ord", "trigger", "start", "piece"],
                    )
                    owner, triggers, starts, pieces = [], [], [], []

    return work


def _ordered(window: int):
    """Rows come sorted by trigger. Per phrase the starts of its windows that an earlier text has in a phrase of the same trigger."""

    def later(rows: pa.Table) -> pa.RecordBatch:
        pieces = rows.column("piece").to_pylist()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(sizes) - sizes
        count = sizes - window + 1
        at = rolling.ranges(begin, begin + count - 1)
        who = np.repeat(np.arange(len(pieces)), count)
        trigger = rows.column("trigger").to_numpy().view(np.uint64)
        key = rolling.mix(rolling.span(rolling.byte_sums(b"".join(pieces)), at, at + window) + rolling.mix(trigger)[who])
        order = np.argsort(key, kind="stable")
        group = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        ords = rows.column("ord").to_numpy()[who]
        least = np.repeat(np.minimum.reduceat(ords[order], group), np.diff(np.append(group, len(order))))
        gone = np.zeros(len(key), bool)
        gone[order] = ords[order] > least
        starts = (at - begin[who] + rows.column("start").to_numpy()[who])[gone]
        hit, n = np.unique(who[gone], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(rows.column("row_key").to_numpy()[hit]), lists(np.split(starts, np.cumsum(n)[:-1]) if len(hit) else [], pa.int32())], ["row_key", "starts"])

    def work(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) < CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            trigger = rows.column("trigger").to_numpy()
            whole = int(np.flatnonzero(trigger == trigger[-1])[0])  # the last trigger may go on
            if whole:
                yield later(rows.slice(0, whole).combine_chunks())
            held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield later(pa.Table.from_batches(held).combine_chunks())

    return work


def _remove(window: int, part: int):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            dup_at, dup_starts = batch.column("dup_at").to_pylist(), batch.column("dup_starts").to_pylist()
            sizes, removed, spans, digests, texts = [], [], [], [], []
            for i, raw in enumerate(raw_texts(batch)):
                sums, at, trigger, first, last, _ = _phrases(raw, window, part)
                whole = np.isin(at, np.array(dup_at[i] or [], np.int64))
                starts = [rolling.ranges(first[whole], last[whole]), np.array([x for s in dup_starts[i] or [] for x in s], np.int64)]
                # earlier in the same text: windows of triggers that repeat in it
                _, back, n = np.unique(trigger, return_inverse=True, return_counts=True)
                again = n[back] > 1
                own = rolling.ranges(first[again], last[again])
                _, once = np.unique(rolling.span(sums, own, own + window), return_index=True)
                starts.append(np.delete(own, once))
                gone = rolling.covered(np.unique(np.concatenate(starts)), window, len(raw))
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                sizes.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
            )

    return work


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, part: int = PART, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables: row_key, doc_id, n_bytes, sha of the rows that stay whole, and doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept_bytes of the rows that may lose bytes.

    A byte of the UTF-8 text goes if a string of ``window`` bytes over it also starts earlier: in a row with a smaller id, or
    earlier in its own row; n_spans counts the maximal removed runs. Ids are integers; rows with one id are not before one another, and rows
    without an id come last. Null and empty texts have no bytes; texts shorter than the window lose none; a character may lose
    part of its bytes; an empty table gives empty results."""
    keyed = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord")
    base = cut(keyed.mapInArrow(_parse(window, part), f"row_key long, doc_id {kind}, n_bytes long, sha string, local boolean, places array<int>, triggers array<long>, phrases array<long>"))
    zipped = F.explode(F.arrays_zip("places", "triggers", "phrases")).alias("p")
    parse = base.select("row_key", order, zipped).select("row_key", "ord", F.col("p.places").alias("place"), F.col("p.triggers").alias("trigger"), F.col("p.phrases").alias("phrase"))
    met = cut(parse.groupBy("trigger").agg(F.count("*").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi"), F.min("ord").alias("first")).where("n > 1").drop("n"))
    known = cut(parse.join(small(met, SMALL_ROWS), "trigger").where("lo <> hi or ord > first").select("row_key", "ord", "place", "trigger", "phrase", (F.col("lo") != F.col("hi")).alias("mixed")))
    mixed = known.where("mixed")
    entries = cut(mixed.groupBy("trigger", "phrase").agg(F.min("ord").alias("first")))
    told = cut(mixed.join(small(entries, SMALL_ROWS), ["trigger", "phrase"]).select("row_key", "ord", "place", (F.col("ord") > F.col("first")).alias("later")))
    firsts = cut(told.where("not later").groupBy("row_key", "ord").agg(F.collect_set("place").alias("firsts")))
    alive = keyed.join(small(firsts.select("row_key"), SMALL_ROWS), "row_key", "left_semi").join(firsts, "row_key").select("row_key", "ord", "text", "firsts")
    pieces = cut(alive.mapInArrow(_entries(window, part), "row_key long, ord long, trigger long, start int, piece binary"))
    hot_triggers = cut(entries.groupBy("trigger").count().where(F.col("count") > hot).select("trigger"))
    few = pieces.join(small(hot_triggers, SMALL_ROWS), "trigger", "left_anti")
    by_task = few.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_ordered(window), "row_key long, starts array<int>")
    many = pieces.join(small(hot_triggers, SMALL_ROWS), "trigger").select("row_key", "ord", "trigger", "start", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - window)).alias("i"))
    many = many.select("row_key", "ord", "trigger", (F.col("start") + F.col("i")).alias("at"), F.xxhash64(F.expr(f"substring(piece, i + 1, {window})")).alias("h"))
    ahead = many.groupBy("trigger", "h").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").drop("last")
    by_row = many.join(ahead, ["trigger", "h"]).where("ord > first").select("row_key", F.array("at").alias("starts"))
    none = F.lit(None)
    phrases_gone = known.where("not mixed").select("row_key", "place").union(told.where("later").select("row_key", "place"))
    parts = phrases_gone.select("row_key", "place", none.cast("array<int>").alias("starts")).union(by_task.union(by_row).select("row_key", none.cast("int"), "starts"))
    parts = parts.union(base.where("local").select("row_key", none.cast("int"), none.cast("array<int>")))
    marks = cut(parts.groupBy("row_key").agg(F.collect_set("place").alias("dup_at"), F.collect_set("starts").alias("dup_starts")))
    final = keyed.join(small(marks.select("row_key"), SMALL_ROWS), "row_key", "left_semi").join(marks, "row_key").select("doc_id", "text", "dup_at", "dup_starts")
    changed = final.mapInArrow(_remove(window, part), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return base.select("row_key", "doc_id", "n_bytes", "sha").join(small(marks.select("row_key"), SMALL_ROWS), "row_key", "left_anti"), changed


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, part: int = PART, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see ``repeated_bytes``)."""
    whole, changed = repeated_bytes(docs, text, doc_id, window, part, hot)
    zero = F.lit(0).cast("long")
    return whole.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256")).unionByName(changed.drop("kept_bytes"))
