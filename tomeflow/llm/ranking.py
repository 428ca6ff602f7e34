"""Ranked lexical search in norm buckets, after LEMP (large entry retrieval by pruned products).

A document is a vector of integer impacts, an item a vector of term weights; a score is their product. Both are scaled by the
square root of the term's weight, so that rare terms count in lengths as they do in products. Documents are ordered by length
(range partitions, sorted inside) and cut into buckets; for every item

* a bucket is left out if its greatest length times the item's length cannot reach the item's tenth score (Cauchy-Schwarz),
* inside, the item's heaviest coordinates are multiplied out; what the others can add is bounded by the lengths of the rests, and
  documents whose bound falls short go,
* survivors are scored exactly, in 64-bit integers.

The tenth scores come from the bucket of the longest documents first, and rise as a task goes on. A bound is never below the
score, so nothing is lost by it; ties with the tenth score stay in."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeflow.llm import rolling
from tomeflow.llm.substrings import Batches, lists, raw_texts
from tomeflow.session import cut

TOP = 10
#: Items searched at once: their terms and best scores are what tasks and the driver hold.
ITEMS = 1000
#: Documents in the first bucket.
FIRST = 10_000
#: Share of an item's squared length that its focus coordinates hold.
FOCUS = 0.9
#: Relative slack on bounds computed in doubles.
SLACK = 1e-9
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return TERM.findall(raw.lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items as vectors over their common terms."""

    def __init__(self, texts: list[bytes]) -> None:
        self.counts = [Counter(terms_of(t)) for t in texts]
        self.index = {t: i for i, t in enumerate(dict.fromkeys(t for c in self.counts for t in c))}

    def weigh(self, n_docs: int, total: int, df: dict[int, int]) -> Items:
        """Weights from the corpus: documents with a term, all their terms, document frequencies by term number."""
        self.n_docs, self.total = n_docs, total
        self.w = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(self.index))], np.int64)
        self.root = np.sqrt(self.w.astype(np.float64))
        self.terms, self.gain, self.coordinate, self.focus, self.tail, self.length = [], [], [], [], [], []
        for count in self.counts:
            terms = np.array([self.index[t] for t in count], np.int64)
            times = np.array(list(count.values()), np.int64)
            held = self.w[terms] > 0
            terms, times = terms[held], times[held]
            q = times * self.root[terms]
            order = np.argsort(-q, kind="stable")
            terms, times, q = terms[order], times[order], q[order]
            squares = np.cumsum(q * q)
            most = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1 if len(q) else 0
            self.terms.append(terms)
            self.gain.append(times * self.w[terms])
            self.coordinate.append(q)
            self.focus.append(most)
            self.tail.append(float(np.sqrt((q[most:] ** 2).sum())))
            self.length.append(float(np.sqrt(squares[-1])) if len(q) else 0.0)
        return self


def _vectors(index: dict[bytes, int]) -> Callable[[Batches], Batches]:
    """Per document: number of its terms, numbers and counts of those that items have."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            sizes, numbers, counts = [], [], []
            for raw in raw_texts(batch):
                found = terms_of(raw)
                count = Counter(found)
                held = [t for t in count if t in index]
                sizes.append(len(found))
                numbers.append(np.array([index[t] for t in held], np.int32))
                counts.append(np.array([count[t] for t in held], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), lists(numbers, pa.int32()), lists(counts, pa.int32())], ["doc_id", "n", "terms", "tf"])

    return work


def _impacts(items: Items) -> Callable[[Batches], Batches]:
    """The vectors with impacts instead of counts, and their scaled lengths."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            terms, tf = batch.column("terms"), batch.column("tf")
            ends = np.diff(terms.offsets.to_numpy())
            flat, tfs = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            m = np.array([25 + 75 * n * items.n_docs // items.total for n in batch.column("n").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(batch)), ends)
            impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[row])
            length = np.sqrt(np.bincount(row, (impact * items.root[flat]) ** 2, minlength=len(batch)))
            split = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)), pa.int32()), pa.array(impact))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), terms, split, pa.array(length)], ["doc_id", "terms", "impacts", "length"])

    return work


def _search(items: Items, least: list[int], top: int) -> Callable[[Batches], Batches]:
    """The best ``top`` documents of the partition for every item (item number, doc_id, score); ``least`` are scores to reach."""

    def work(batches: Batches) -> Batches:
        best: list[list[tuple]] = [[] for _ in least]
        floor, kind = list(least), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            if not len(batch):
                continue
            flat, impact = batch.column("terms").flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column("terms").offsets.to_numpy()))
            length = batch.column("length").to_numpy()
            order = np.argsort(flat, kind="stable")
            row, impact = row[order], impact[order]
            edge = np.append(0, np.cumsum(np.bincount(flat, minlength=len(items.w))))
            scaled = impact * items.root[flat[order]]
            place = pc.rank(batch.column("doc_id"), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            for k, terms in enumerate(items.terms):
                if not len(terms) or items.length[k] * length.max() * (1 + SLACK) < floor[k]:
                    continue
                focus = terms[: items.focus[k]]
                sizes = edge[focus + 1] - edge[focus]
                at = rolling.ranges(edge[focus], edge[focus + 1] - 1)
                p = scaled[at]
                part = np.bincount(row[at], p * np.repeat(items.coordinate[k][: items.focus[k]], sizes), minlength=len(batch))
                rest = np.sqrt(np.maximum(length**2 * (1 + SLACK) - np.bincount(row[at], p * p, minlength=len(batch)), 0.0))
                bound = (part + items.tail[k] * rest) * (1 + SLACK)
                alive = (bound >= floor[k]) & (bound > 0)
                if not alive.any():
                    continue
                sizes = edge[terms + 1] - edge[terms]
                at = rolling.ranges(edge[terms], edge[terms + 1] - 1)
                gain = np.repeat(items.gain[k], sizes)
                keep = alive[row[at]]
                score = np.zeros(len(batch), np.int64)
                np.add.at(score, row[at][keep], gain[keep] * impact[at][keep])
                found = np.flatnonzero((score > 0) & (score >= floor[k]))
                found = found[np.lexsort((place[found], -score[found]))[:top]]
                ids = batch.column("doc_id").take(pa.array(found)).to_pylist()
                best[k] = sorted(best[k] + [(-s, i is None, i) for s, i in zip(score[found].tolist(), ids, strict=True)], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:top]
                if len(best[k]) == top:
                    floor[k] = max(floor[k], -best[k][-1][0])
        if kind is not None:
            rows = [(k, i, -s) for k, b in enumerate(best) for s, _, i in b]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    return work


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _ranked(read: DataFrame, texts: list[bytes], top: int) -> DataFrame:
    """item (number in ``texts``), doc_id, score, rank of one block of items."""
    spark, kind = read.sparkSession, read.schema["doc_id"].dataType.simpleString()
    items = Items(texts)
    vectors = cut(read.mapInArrow(_vectors(items.index), f"doc_id {kind}, n long, terms array<int>, tf array<int>"))
    n_docs, total, met = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.size("terms") > 0, 1))).first()
    schema = f"item int, doc_id {kind}, score long"
    if not met:
        return spark.createDataFrame([], f"{schema}, rank int")
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most as many as the block has terms
    items.weigh(n_docs, total, df)
    measured = cut(vectors.where(F.size("terms") > 0).mapInArrow(_impacts(items), f"doc_id {kind}, terms array<int>, impacts array<long>, length double"))
    border = measured.agg(F.percentile_approx("length", max(0.0, 1 - FIRST / met))).first()[0]
    by_length = lambda part: part.repartitionByRange(F.desc("length"), "doc_id").sortWithinPartitions(F.desc("length"), "doc_id")
    first = cut(_best(by_length(measured.where(F.col("length") >= border)).mapInArrow(_search(items, [0] * len(texts), top), schema), top))
    least = dict(first.where(F.col("rank") == top).select("item", "score").collect())
    rest = by_length(measured.where(F.col("length") < border)).mapInArrow(_search(items, [least.get(k, 0) for k in range(len(texts))], top), schema)
    return _best(first.drop("rank").union(rest), top)


def search(docs: DataFrame, queries: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` rows of ``docs`` with the highest score above 0 for each row of
    ``queries``, equal scores by ascending doc_id (null last).

    Items are searched in blocks of about ``block``, each against all documents. Null and empty texts have no terms: such
    documents are not counted, such items get no rows. Repeated documents are ranked each; equal items (same id and text) count
    once, items that share an id but not the text are ranked each; texts of any length are taken whole; empty tables give an
    empty result; other columns are ignored."""
    items = cut(queries.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct())
    blocks = max(1, -(-items.count() // block))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        named = read.sparkSession.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _ranked(read, [r[1].encode() for r in rows], top).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out


SQL = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lens),
q0 AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM q0 GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT doc_id, 25 + ((75 * n * n_docs) // total) AS m FROM lens, tot),
s AS (SELECT item_id, tf.doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
