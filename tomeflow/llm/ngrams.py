"""LM scoring with a log-frequency Bloom filter.

A bigram's training count c is held as the quantised logarithm q = 1 + floor(log_BASE c): the filter contains (bigram, 1) to
(bigram, q). A count is read by probing for level 1, 2, ... until one is missing, so it may come out too high with the filter's
small error rate, never too low. Beside bigrams it holds, per history, its count and its number of different continuations.
Probabilities back off by absolute discounting::

    P(w | h) = (c(hw) - D) / c(h)                         if the bigram is in the filter
             = D * types(h) / c(h) * (c(w) + 1) / (N + V + 1)   else (the first factor is 1 for an unknown history)

which add up to at most one over all words, but for quantising. Unigram counts are exact: frequent words are broadcast (their
number is bounded by ``HEAD``), rare ones meet their counts in one join.

The filter is built in shards by history, each as large as its own entries need, and grows with the corpus. Shards are broadcast
up to ``FILTER_BYTES`` at a time: a larger filter takes several passes over the documents, each scoring the words whose history
it holds, and the sums add up to the same scores. A single history is never split, so its continuations (at most the vocabulary)
have to fit. Bigrams are 64-bit keys, 32 of the history and 32 of the word with its history; equal keys share their counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm import rolling
from tomeflow.llm.substrings import Batches, raw_texts
from tomeflow.session import cut

BASE = 1.5
DISCOUNT = 0.75
#: Bits of the filter per entry, and bits an entry sets: an absent entry is taken for a present one with a chance below 1 in 100.
BITS = 14
PROBES = 4
#: Most words whose exact counts are broadcast.
HEAD = 250_000
FILTER_BYTES = 160 << 20
#: Training tokens per shard of the filter, and most shards.
SHARD_TOKENS = 500_000
MOST_SHARDS = 20_000
#: Bytes of text handled at once in a task: when counting, and when scoring.
COUNT_BYTES = 4 << 20
SCORE_BYTES = 2 << 20
_U = np.uint64
_START, _END, _COUNT, _TYPES = (_U(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_LEVEL = 0xD6E8FEB86659FD93
_ONE = _U(1)
_LOWEST = BASE ** np.arange(110)
_UPPER = np.minimum(np.ceil(_LOWEST[1:]) - 1, 2.0**63)
#: Count that stands for each level: the middle of the whole numbers with it.
STANDS = np.concatenate(([0.0], (np.ceil(_LOWEST[:-1]) + np.maximum(_UPPER, np.ceil(_LOWEST[:-1]))) / 2))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE c) of positive counts."""
    return np.searchsorted(_LOWEST, counts, "right")


class Parsed:
    """The tokens of some texts, all in one go: ``words`` (A-Z lower-cased), ``at`` (which token each word is), ``keys`` (bigram that
    each token ends, the end token of a text included), ``ends`` (where the tokens of each text begin, and the end of the last)."""

    def __init__(self, raws: list[bytes]) -> None:
        self.blob = b" ".join(raws).lower()
        self.start, self.stop = rolling.word_bounds(self.blob)
        text_at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        n = np.diff(np.searchsorted(self.start, text_at))
        self.ends = np.append(0, np.cumsum(n + 1))
        self.at = np.arange(len(self.start)) + np.repeat(np.arange(len(raws)), n)

    @cached_property
    def keys(self) -> np.ndarray:
        token = np.full(int(self.ends[-1]), _END)
        token[self.at] = rolling.span(rolling.byte_sums(self.blob), self.start, self.stop)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.ends[:-1]] = _START
        return (before >> _U(32) << _U(32)) | (rolling.mix(before * _U(3) + token) >> _U(32))

    @cached_property
    def words(self) -> pa.BinaryArray:
        raw = np.frombuffer(self.blob, np.uint8)
        sizes = np.append(0, np.cumsum(self.stop - self.start)).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(sizes), pa.py_buffer(raw[~rolling.SPACES[raw]])])


def _together(batches: Batches, most: int, key: str | None = None) -> Iterator[tuple[list[bytes], list]]:
    """Texts of about ``most`` bytes at a time, and their values of the column ``key``."""
    raws, rows, size = [], [], 0
    for batch in batches:
        for raw, row in zip(raw_texts(batch), batch.column(key).to_pylist() if key else [None] * len(batch), strict=True):
            raws.append(raw)
            rows.append(row)
            size += len(raw)
            if size > most:
                yield raws, rows
                raws, rows, size = [], [], 0
    if raws:
        yield raws, rows


def _words(batches: Batches) -> Batches:
    """Words and their counts; the end token is the empty word."""
    for raws, _ in _together(batches, COUNT_BYTES):
        found = pc.value_counts(Parsed(raws).words)
        ends = pa.array([b""], pa.binary()), pa.array([len(raws)], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip((found.field("values"), found.field("counts")), ends, strict=True)], ["word", "n"])


def _bigrams(batches: Batches) -> Batches:
    for raws, _ in _together(batches, COUNT_BYTES):
        keys, counts = np.unique(Parsed(raws).keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "n"])


class Bloom:
    """Bits of one or several shards, end to end; ``first`` and ``words`` are the place and size of every shard in 64-bit words (0:
    not here). An entry sets ``PROBES`` bits of one word, so a probe reads one place."""

    def __init__(self, data: bytes, first: np.ndarray, words: np.ndarray) -> None:
        self.data, self.first, self.words = data, first, words

    def _probe(self, keys: np.ndarray, level: int, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word of every entry, and its bits."""
        h = rolling.mix(keys + _U(level * _LEVEL % (1 << 64)))
        at = (first + ((h >> _U(32)) * words >> _U(32))).astype(np.int64)
        mask = _ONE << (h & _U(63))
        for i in range(1, PROBES):
            mask |= _ONE << ((h >> _U(6 * i)) & _U(63))
        return at, mask

    def add(self, keys: np.ndarray, q: np.ndarray, shard: np.ndarray) -> None:
        order = np.argsort(-q, kind="stable")
        keys, shard, q = keys[order], shard[order], q[order]
        data = np.frombuffer(self.data, "<u8").copy()
        for level in range(1, int(q.max(initial=0)) + 1):
            n = int(np.searchsorted(-q, -level, "right"))
            np.bitwise_or.at(data, *self._probe(keys[:n], level, self.first[shard[:n]], self.words[shard[:n]]))
        self.data = data.tobytes()

    def read(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The highest level up to which every one is there."""
        q, data = np.zeros(len(keys), np.int64), np.frombuffer(self.data, "<u8")
        alive = np.flatnonzero(self.words[shard] > 0)
        left, first, words = keys[alive], self.first[shard[alive]], self.words[shard[alive]]
        for level in range(1, len(STANDS)):
            at, mask = self._probe(left, level, first, words)
            there = (data[at] & mask) == mask
            alive, left, first, words = alive[there], left[there], first[there], words[there]
            if not len(alive):
                break
            q[alive] = level
        return q


def _history(keys: np.ndarray) -> np.ndarray:
    return keys >> _U(32)


def _shard_of(history: np.ndarray, shards: int) -> np.ndarray:
    return (history % _U(shards)).astype(np.int64)


def _entries(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter keys and levels of the bigrams of whole histories, and of the counts and types of these histories."""
    history, place, types = np.unique(_history(keys), return_inverse=True, return_counts=True)
    total = np.bincount(place, counts, minlength=len(history))
    return np.concatenate((keys, rolling.mix(history ^ _COUNT), rolling.mix(history ^ _TYPES))), levels(np.concatenate((counts, total, types)))


def _built(bits: int) -> Callable[[Batches], Batches]:
    """One row per shard from (shard, key, n) sorted by shard."""

    def one(shard: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, q = _entries(keys, counts)
        size = -(-int(q.sum()) * bits // 64) * 8
        bloom = Bloom(bytes(size), np.zeros(1, _U), np.array([size // 8], _U))
        bloom.add(keys, q, np.zeros(len(keys), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([bloom.data], pa.binary())], ["shard", "size", "data"])

    def work(batches: Batches) -> Batches:
        now, held = -1, []
        for batch in batches:
            shard, keys, counts = (batch.column(i).to_numpy() for i in range(3))
            for a, b in zip(edges := np.flatnonzero(np.diff(shard, prepend=-1)), [*edges[1:], len(shard)], strict=True):
                if shard[a] != now and held:
                    yield one(now, held)
                    held = []
                now = int(shard[a])
                held.append((keys[a:b].view(_U), counts[a:b]))
        if held:
            yield one(now, held)

    return work


def build(docs: DataFrame, n_tokens: int, bits: int = BITS) -> tuple[DataFrame, int]:
    """The filter of ``docs`` (text) as a written table (shard, size, data), and its number of shards."""
    shards = min(MOST_SHARDS, n_tokens // SHARD_TOKENS + 1)
    parts = docs.select("text").mapInArrow(_bigrams, "key long, n long").withColumn("shard", F.pmod(F.shiftrightunsigned("key", 32), F.lit(shards)).cast("int"))
    # as many parts as shards bound what a task sorts
    counts = parts.repartition(shards, "shard").groupBy("shard", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("shard")
    return cut(counts.mapInArrow(_built(bits), "shard int, size long, data binary")), shards


def _held(filters: DataFrame, shards: int, wanted: list[int]) -> Bloom:
    first, words, parts, end = np.zeros(shards, _U), np.zeros(shards, _U), [], 0
    for r in filters.where(F.col("shard").isin(wanted)).select("shard", "data").toLocalIterator():
        first[r.shard], words[r.shard] = end, len(r.data) // 8
        parts.append(r.data)
        end += len(r.data) // 8
    return Bloom(b"".join(parts) or bytes(8), first, words)


def _scored(model: Broadcast, head: Broadcast, wanted: np.ndarray) -> Callable[[Batches], Batches]:
    """Per document, over the tokens whose history lies in the shards ``wanted``: their number, those that are frequent words,
    sums of log10(c + 1) of these, of bigram logarithms and back-off weights, tokens backed off, and the rare words."""

    def unseen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is scored here, whether its bigram is missing, and its logarithm without the unigram."""
        bloom = model.value
        unique, place = np.unique(keys, return_inverse=True)
        history, of = np.unique(_history(unique), return_inverse=True)
        shard = _shard_of(history, len(wanted))
        here = wanted[shard]
        count, types = np.zeros(len(history)), np.zeros(len(history))
        count[here] = STANDS[bloom.read(rolling.mix(history[here] ^ _COUNT), shard[here])]
        types[here] = STANDS[bloom.read(rolling.mix(history[here] ^ _TYPES), shard[here])]
        known = here[of] & (count[of] > 0)
        q = np.zeros(len(unique), np.int64)
        q[known] = bloom.read(unique[known], shard[of[known]])
        c = count[of]
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(c > 0, np.minimum(DISCOUNT * np.maximum(types[of], 1) / c, 1.0), 1.0)
            p = np.where(q > 0, (np.minimum(STANDS[q], c) - DISCOUNT) / c, back)
        return here[of][place], (here[of] & (q == 0))[place], np.log10(p)[place]

    def one(raws: list[bytes], rows: list[int]) -> pa.RecordBatch:
        common, gains = head.value
        parsed, n = Parsed(raws), len(raws)
        here, missing, logs = unseen(parsed.keys)
        coded = parsed.words.dictionary_encode()
        ids, place = coded.indices.to_numpy(), pc.fill_null(pc.index_in(coded.dictionary, value_set=common), -1).to_numpy()
        end = pc.index(common, pa.scalar(b"", pa.binary())).as_py()
        each = np.full(int(parsed.ends[-1]), end, np.int64)
        each[parsed.at] = place[ids] if len(ids) else 0
        known = each >= 0
        gain = np.where(known, gains[each], 0.0) if len(gains) else np.zeros(len(each))
        of = np.repeat(np.arange(n), np.diff(parsed.ends))
        total = lambda x: np.bincount(of, x, minlength=n)
        whole = lambda x: pa.array(total(x).astype(np.int64))
        sums = [whole(here), whole(here & known), pa.array(total(np.where(here, gain, 0.0))), pa.array(total(np.where(here, logs, 0.0) + np.where(missing, gain, 0.0))), whole(missing)]
        # rare words, counted per text
        rare = (here & ~known)[parsed.at]
        pair, back, tf = np.unique(of[parsed.at][rare] * max(1, len(coded.dictionary)) + ids[rare], return_inverse=True, return_counts=True)
        backs = np.bincount(back, missing[parsed.at][rare], minlength=len(pair)).astype(np.int64)
        text, word = np.divmod(pair, max(1, len(coded.dictionary)))
        at = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=n))), pa.int32())
        lists_ = [pa.ListArray.from_arrays(at, x) for x in (coded.dictionary.take(pa.array(word)), pa.array(tf, pa.int64()), pa.array(backs))]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *sums, *lists_], ["row_key", "tokens", "known", "base", "score", "backed", "words", "tfs", "backs"])

    def work(batches: Batches) -> Batches:
        for raws, rows in _together(batches, SCORE_BYTES, "row_key"):
            yield one(raws, rows)

    return work


def _passes(filters: DataFrame, most: int) -> list[list[int]]:
    """Shards of each pass, by their sizes; a shard beyond the bound has one of its own."""
    out, size = [[]], 0
    for shard, n in sorted(filters.select("shard", "size").collect()):
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(shard)
        size += n
    return out


def _frequent(counts: DataFrame, most: int) -> int:
    """Least power of two such that at most ``most`` words have that count."""
    row = counts.agg(*(F.count(F.when(F.col("c") >= F.lit(1 << k), 1)).alias(f"k{k}") for k in range(62))).first()
    return next((1 << k for k in range(62) if row[k] <= most), 1 << 62)


def score(docs: DataFrame, learn: Callable[[Column], Column], text: str = "text", doc_id: str = "doc_id", bits: int = BITS, filter_bytes: int = FILTER_BYTES, head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known (tokens that training rows have), train_tokens, base_score (add-one unigrams)
    and score, both log10 probabilities of the whole text and its end; ``learn(doc_id)`` says which rows are learned from.

    Null and empty texts are the end token alone. Repeated rows count as often as they are there and get equal scores; a null id
    is scored and learned from as ``learn`` says; without training rows every probability is 1; texts of any length are taken
    whole; an empty table gives an empty result; other columns are ignored."""
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    train = read.where(learn(F.col("doc_id")))
    counts = cut(train.select("text").mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    filters, shards = build(train, n, bits)
    floor = _frequent(counts, head)
    common = (F.col("c") >= floor) | (F.length("word") == 0)
    table = counts.where(common).toArrow()
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((table.column("word").cast(pa.binary()).combine_chunks(), np.log10(table.column("c").to_numpy() + 1.0)))
    wide = "row_key long, tokens long, known long, base double, score double, backed long, words array<binary>, tfs array<long>, backs array<long>"
    groups, done = _passes(filters, filter_bytes), None
    for group in groups:
        wanted = np.zeros(shards, bool)
        wanted[group if len(groups) > 1 else slice(None)] = True
        if len(groups) > 1 and group is groups[0]:
            wanted[np.setdiff1d(np.arange(shards), [s for g in groups for s in g])] = True  # shards without any entry
        model = spark.sparkContext.broadcast(_held(filters, shards, group))
        part = cut(read.select("row_key", "text").mapInArrow(_scored(model, known, wanted), wide))
        model.unpersist()
        done = part if done is None else done.union(part)
    known.unpersist()
    rare = done.select("row_key", F.explode(F.arrays_zip("words", "tfs", "backs")).alias("w")).select("row_key", F.col("w.words").alias("word"), F.col("w.tfs").alias("tf"), F.col("w.backs").alias("back"))
    gain = F.log10(F.col("c") + 1)
    met = rare.join(counts.where(~common), "word").groupBy("row_key").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * gain).alias("more_base"), F.sum(F.col("back") * gain).alias("more_score"))
    sums = done.groupBy("row_key").agg(*(F.sum(c).alias(c) for c in ("tokens", "known", "base", "score", "backed")), (F.count("*") / len(groups)).alias("copies"))
    both = sums.join(met, "row_key", "left").na.fill(0, ["more_known", "more_base", "more_score"])
    space = math.log10(n + v + 1)
    each = lambda c: F.col(c) / F.col("copies")  # noqa: E731  equal rows have equal sums
    whole = lambda c: F.round(each(c)).cast("long")
    told = both.select(
        "row_key", whole("tokens").alias("n_tokens"), (whole("known") + whole("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (each("base") + each("more_base") - whole("tokens") * space).alias("base_score"), (each("score") + each("more_score") - whole("backed") * space).alias("score"),
    )
    return read.select("row_key", F.col("doc_id").cast(kind).alias("doc_id")).join(told, "row_key").drop("row_key")
