"""Language identification by cross-parsing entropy.

Per language, a suffix automaton over a bounded sample of labelled text knows every string of that sample. A text is cut, left to
right, into the longest phrases the automaton knows; the fewer phrases per letter, the closer the language. Phrases end at word
ends, so a text's count is the sum over its words, and a word that comes often is parsed once per batch.

Parsing runs over all distinct words of a batch at once, one letter place after the other, as look-ups in the automaton's table
(state and letter give the next state, or the state a new phrase starts in). Only the fit is bounded (``LETTERS`` per language,
stretches at hashed places of the rows with the smallest hash of their id); every letter of every text is parsed. Every labelled
language is learned: languages whose samples together exceed ``ALL_LETTERS`` take further passes over the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeflow.llm.common import small
from tomeflow.session import cut

#: Labelled text taken per language: rows, characters a row may give (a stretch at a hashed place of the whole text), characters
#: in all.
ROWS = 400
ROW_LETTERS = 500
LETTERS = 80_000
#: Characters of the samples of one pass: the automata of a worker hold about a kilobyte for every four.
ALL_LETTERS = 400_000
#: Labelled languages whose counts are broadcast; beyond it Spark shuffles both sides.
MANY = 100_000
#: Letters of the alphabet that have a symbol of their own; rarer ones share one.
SYMBOLS = 126
CHUNK = 2_000_000
_NEW = np.int32(1 << 30)


def letters_of(text: str) -> str:
    """Lower-cased text with everything but letters as one space between words."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions (state, symbol) of the suffix automaton of a sequence, -1 where there is none. State 0 is the start."""
    table = np.full((2 * len(symbols) + 2, size), -1, np.int32)
    nexts: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for s in symbols:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = twin
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = twin
                    p = link[p]
        last = now
    for state, to in enumerate(nexts):
        for s, q in to.items():
            table[state, s] = q
    return table[: len(nexts)]


class Model:
    """Symbol of every code point, and per language the parsing table and the size of its sample."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.names = sorted(samples)
        words = {k: " ".join(letters_of(x) for x in v).split() for k, v in samples.items()}
        tally: dict[str, int] = {}
        for found in words.values():
            for w in found:
                for c in w:
                    tally[c] = tally.get(c, 0) + 1
        own = sorted(sorted(tally), key=lambda c: -tally[c])[:SYMBOLS]
        self.alphabet = {c: i + 2 for i, c in enumerate(own)}  # 0: no letter, 1: letters without a symbol
        self.size = len(own) + 3
        # words are joined by a symbol no text has, so no phrase crosses a word's end
        self.joined = [bytes(s for w in words[k] for s in (*(self.alphabet.get(c, 1) for c in w), self.size - 1)) for k in self.names]
        self.bits = [float(np.log2(max(2, len(x)))) for x in self.joined]
        self._symbols: np.ndarray | None = None
        self._tables: list[np.ndarray] | None = None

    def tables(self) -> list[np.ndarray]:
        """Parsing table of every language (made once per worker; only the samples are sent)."""
        if self._tables is None:
            self._tables = []
            for joined in self.joined:
                auto = suffix_automaton(list(joined), self.size)
                fresh = np.where(auto[0] >= 0, auto[0], 0).astype(np.int32) | _NEW
                table = np.where(auto >= 0, auto, fresh).astype(np.int32)
                table[0] = fresh  # at the start, any letter begins a phrase
                self._tables.append(table.ravel())
        return self._tables

    def symbols(self) -> np.ndarray:
        """Symbol of each code point (made once per worker, not sent along)."""
        if self._symbols is None:
            table = np.zeros(0x110000, np.uint8)
            table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
            for i in range(0x110000):
                c = chr(i).lower()
                if c in self.alphabet:
                    table[i] = self.alphabet[c]
            self._symbols = table
        return self._symbols

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_symbols": None, "_tables": None}

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text in every language, and the letters of every text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.symbols()[code]
        owner = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(owner[letter > 0], minlength=len(texts))
        edge = np.ones(len(letter) + 1, bool)  # a word ends where there is no letter and where a text ends
        edge[:-1] = letter == 0
        cuts = np.zeros(len(letter) + 1, bool)
        cuts[np.cumsum(sizes)] = True
        inside = ~edge[:-1]
        begins = np.flatnonzero(inside & np.concatenate(([True], edge[:-2] | cuts[1:-1])) if len(letter) else inside)
        stops = np.flatnonzero(inside & (edge[1:] | cuts[1:])) + 1
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        if not len(begins):
            return counts, letters
        # equal words are parsed once: sums of random numbers per place stand for the words
        key = np.zeros(len(letter) + 1, np.uint64)
        rolled = np.cumsum(letter.astype(np.uint64) * _powers(len(letter)), dtype=np.uint64)
        key[1:] = rolled
        hashed = (key[stops] - key[begins]) * _inverse(len(letter))[begins] + (stops - begins).astype(np.uint64)
        _, one, back = np.unique(hashed, return_index=True, return_inverse=True)
        start, long = begins[one], (stops - begins)[one]
        order = np.argsort(-long, kind="stable")
        start, long = start[order], long[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        alive = np.searchsorted(-long, -np.arange(1, int(long[0]) + 1), side="right")
        for k, table in enumerate(self.tables()):
            state, phrases = np.zeros(len(start), np.int32), np.ones(len(start), np.int64)
            for place, n in enumerate(alive):
                step = table[state[:n].astype(np.int64) * self.size + letter[start[:n] + place]]
                if place:
                    phrases[:n] += step >> 30
                state[:n] = step & (_NEW - 1)
            counts[:, k] = np.bincount(owner[begins], weights=phrases[rank][back], minlength=len(texts)).astype(np.int64)
        return counts, letters

    def nearest(self, texts: list[str | None]) -> list[list[tuple[float, str]]]:
        """The two languages with the least entropy (phrases, each as a place in the sample) for every text with a letter."""
        out: list[list[tuple[float, str]]] = [[] for _ in texts]
        todo = [(i, t) for i, t in enumerate(texts) if t]
        while todo and self.names:
            known, size = [], 0
            while todo and (not known or size + len(todo[-1][1]) <= CHUNK):
                known.append(todo.pop())
                size += len(known[-1][1])
            counts, letters = self.parse([t for _, t in known])
            entropy = counts * np.array(self.bits)
            for (i, _), row, n in zip(known, entropy, letters, strict=True):
                if n:
                    out[i] = [(float(row[k]), self.names[k]) for k in np.argsort(row, kind="stable")[:2]]
        return out


_tables: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[:1] = 1
        have = _tables[base] = np.multiply.accumulate(steps)
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _power(0x9E3779B97F4A7C15, n)


def _inverse(n: int) -> np.ndarray:
    return _power(pow(0x9E3779B97F4A7C15, -1, 1 << 64), n)


def samples(labelled: DataFrame) -> DataFrame:
    """lang, place, text: bounded samples of rows (id, text, lang), of every language. Per language the ``ROWS`` rows with the
    smallest hash of id and text, of each a stretch of ``ROW_LETTERS`` characters at a hashed place of the whole text."""
    rows = labelled.where("text is not null and lang is not null and id is not null").select("id", "lang", "text")
    size = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    # one pass for all languages: below a bound on the hash lie about twice as many rows as are wanted
    drawn = rows.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 31))).join(small(size, MANY), "lang")
    at = F.pmod(F.xxhash64("text", "id"), F.greatest(F.length("text") - ROW_LETTERS, F.lit(0)) + 1).cast("int")
    stretch = F.substr("text", at + 1, F.lit(ROW_LETTERS)).alias("text")
    few = cut(drawn.where(F.col("h") < F.lit(float(1 << 31)) * F.least(F.lit(1.0), 2 * ROWS / F.col("n"))).select("lang", "h", "id", stretch))
    got = few.groupBy("lang").agg(F.count("*").alias("got"))
    if not size.join(got, "lang", "left").where(F.coalesce("got", F.lit(0)) < F.least("n", F.lit(ROWS))).isEmpty():  # very unequal repeats
        few = drawn.select("lang", "h", "id", stretch)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    return cut(few.withColumn("place", place).where(F.col("place") <= ROWS).select("lang", "place", "text"))


def learn(labelled: DataFrame) -> Iterator[Model]:
    """Models of the languages of ``labelled`` (id, text, lang) that have a letter, so many at a time that their samples hold at
    most ``ALL_LETTERS`` characters; the samples of one model come to the driver."""
    drawn = samples(labelled)
    sizes = drawn.groupBy("lang").agg(F.least(F.sum(F.length("text")), F.lit(LETTERS)).alias("n")).orderBy("lang").toLocalIterator()
    groups: list[list[str]] = [[]]
    held = 0
    for r in sizes:
        if groups[-1] and held + r["n"] > ALL_LETTERS:
            groups.append([])
            held = 0
        groups[-1].append(r["lang"])
        held += r["n"]
    for group in groups:
        left, texts = dict.fromkeys(group, LETTERS), {}
        for r in drawn.where(F.col("lang").isin(group)).orderBy("lang", "place").collect() if group else ():
            if left[r["lang"]] > 0 and any(c.isalpha() for c in r["text"]):
                texts.setdefault(r["lang"], []).append(r["text"][: left[r["lang"]]])
                left[r["lang"]] -= len(texts[r["lang"]][-1])
        if texts:
            yield Model(texts)


def identify(docs: DataFrame, learned: Callable[[Column], Column], text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The columns of ``docs``, then lang_pred and score (0 to 1: how far the best language's entropy is below the next).

    Learns from the rows whose id meets ``learned`` and whose text and ``lang`` are not null. A text that is null or has no letter
    is ``und`` with score 0, as is everything if nothing could be learned; with one language the score is 1; ties go to the first
    name. Own columns named lang_pred or score are replaced; repeated rows are judged each; an empty table gives an empty result."""
    known = docs.where(learned(F.col(doc_id))).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    models = [docs.sparkSession.sparkContext.broadcast(m) for m in learn(known)]

    def judge(model: Broadcast | None) -> Column:
        @F.pandas_udf("best array<struct<bits:double,name:string>>")
        def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = model.value.nearest(batch.tolist()) if model else [[] for _ in batch]
                yield pd.DataFrame({"best": [[{"bits": b, "name": n} for b, n in x] for x in near]})

        return udf(F.col(text))["best"]

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if len(models) < 2:
        said = docs.withColumn("__best", judge(models[0] if models else None))
    else:
        # a pass over the texts for each model; equal texts are one row, so this is at most two languages per model and text
        key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        parts = [cut(docs.select(key.alias("__key"), F.explode(judge(m)).alias("b"))) for m in models]
        best = reduce(DataFrame.union, parts).groupBy("__key").agg(F.slice(F.array_sort(F.collect_set("b")), 1, 2).alias("__best"))
        said = docs.withColumn("__key", key).join(best, "__key", "left")
    best = F.coalesce("__best", F.array().cast("array<struct<bits:double,name:string>>"))
    first, second = F.get(best, F.lit(0)), F.get(best, F.lit(1))
    ratio = F.lit(1.0) - first["bits"] / F.greatest(second["bits"], F.lit(1e-9))
    score = F.when(first.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)))
    return said.select(*own, F.coalesce(first["name"], F.lit("und")).alias("lang_pred"), score.alias("score"))
