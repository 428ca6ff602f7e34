"""Spelling variants by permuterm rotations.

A word marked with a terminator is turned round at every place: ``w = abcd`` gives ``abcd$``, ``bcd$a``, ``cd$ab``, ... Every rotation
but the first ends with one character of the word, and what stands before it is the word with that character skipped. So two
words that differ by a replaced character share that prefix, and a word that lacks the character *is* that prefix. All rotations
are sorted by the prefix; each group of equal prefixes is scanned, and every member is given the number of its neighbours in the
group and the most frequent of them. A group never expands into pairs, and as its words differ in one character it is no larger
than the alphabet.

A character of a run of equal ones can be skipped at several places with the same result; only the first of the run counts as
missing in the shorter word, so that each pair of words meets in exactly one group.

Words of more than ``LONG`` characters would have rotations of their length squared, so theirs are compared by hash; each such
pair is verified by the words themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm import rolling
from tomeflow.llm.common import small
from tomeflow.llm.substrings import Batches, lists, raw_texts
from tomeflow.session import cut

#: Least characters of a word, least occurrences, and how many times as frequent a form has to be.
LEAST = 7
TWICE = 2
RATIO = 10
#: Occurrences with a crc32 that this number divides lose a character.
EVERY = 31
MARK = "$"
LONG = 64
#: Words held by a task before they are handed on.
FLUSH = 300_000
FORMS_ROWS = 500_000
ROUNDS = 7


def _without(run: bytes, h: int) -> bytes:
    said = run.decode()
    at = h % len(said)
    return (said[:at] + said[at + 1 :]).encode()


def _counted(least: int, every: int) -> Callable[[Batches], Batches]:
    pattern = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF]){%d,}" % least)

    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def work(batches: Batches) -> Batches:
        total: Counter = Counter()
        for batch in batches:
            for raw, doc in zip(raw_texts(batch), batch.column("doc_id").to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc or ''}:".encode())
                for run, n in Counter(pattern.findall(raw.lower())).items():
                    h = zlib.crc32(run, seed)
                    if h % every == 0:
                        run = _without(run, h)
                        if len(run) - run.count(b"\xc3") < least:
                            continue
                    total[run] += n
                if len(total) > FLUSH:
                    yield flush(total)
                    total = Counter()
        yield flush(total)

    return work


def counted_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n: the maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least ``least``
    characters, and how often each occurs. Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run loses the character at
    crc32 mod its length, as a made misspelling. Counts are added up inside tasks before they are shuffled."""
    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return read.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """key, skipped, n of every rotation of every word: its prefix and the character after it ("" for the whole word)."""
    w = F.col("word")
    turned = lambda i, skip: F.concat(F.substr(w, i + F.lit(1 + skip)), F.lit(MARK), F.substr(w, F.lit(1), i))
    places = F.sequence(F.lit(0), F.length(w) - 1)
    short = F.transform(places, lambda i: F.struct(turned(i, 1).alias("key"), F.substr(w, i + F.lit(1), F.lit(1)).alias("skipped")))
    whole = F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.struct(turned(i, 0).alias("key"), F.lit("").alias("skipped")))
    return words.select(F.explode(F.concat(short, whole)).alias("r"), "n").select("r.key", "r.skipped", "n")


def _neighbours(key: str, members: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of neighbours, n and word of the best neighbour) of each member (skipped character, n) that has one."""
    tail, head = key.split(MARK)
    found = sorted((-n, head + c + tail, c, not head.endswith(c) if c else True) for c, n in members)
    skip = [x for x in found if x[2]]
    missing = [x for x in skip if x[3]]  # those that the whole word, if it is there, is near to
    whole = [x for x in found if not x[2]]
    for x in found:
        near = missing if not x[2] else skip if not (whole and x[3]) else found
        n = len(near) - (x[2] != "")
        if n:
            best = near[0] if near[0] is not x else near[1]
            yield x[1], n, -best[0], best[1]


def _scan(batches: Batches) -> Batches:
    """Groups of equal keys in rows sorted by key; a group may go on in the next batch. A group has at most one member per letter
    besides the whole word."""
    held: pa.RecordBatch | None = None

    def groups(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys = rows.column("key")
        first = np.flatnonzero(np.append(True, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)))
        sizes = np.diff(np.append(first, len(keys)))
        first, sizes = first[sizes > 1], sizes[sizes > 1]
        at = rolling.ranges(first, first + sizes - 1)
        names = keys.take(pa.array(first)).to_pylist()
        chars, counts = rows.column("skipped").take(pa.array(at)).to_pylist(), rows.column("n").take(pa.array(at)).to_pylist()
        out, i = [], 0
        for name, size in zip(names, sizes.tolist(), strict=True):
            out.extend(_neighbours(name, list(zip(chars[i : i + size], counts[i : i + size], strict=True))))
            i += size
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best"])

    for batch in batches:
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        if not len(rows):
            continue
        keys = rows.column("key")
        last = int(np.flatnonzero(np.append(True, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)))[-1])
        held = rows.slice(last)
        if last:
            yield groups(rows.slice(0, last))
    if held is not None:
        yield groups(held)


def _hashed(batches: Batches) -> Batches:
    """Hashes of the rotations of long words, of the whole ones and of those that skip their last character."""
    for batch in batches:
        words, keys, wholes = batch.column("word").to_pylist(), [], []
        for word in words:
            u = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
            n, at, sums = len(u), np.arange(len(u) + 1), rolling.prefix(rolling.mix(u + np.uint64(1)))
            joined = lambda end, start: rolling.mix(rolling.span(sums, np.zeros_like(end), end) * np.uint64(3) + rolling.span(sums, start, np.full_like(start, n)))  # noqa: E731,B023
            keys.append(np.concatenate((joined(at[:-1], at[1:]), joined(at, at))).view(np.int64))
            wholes.append(np.arange(2 * n + 1) >= n)
        if words:
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists(keys, pa.int64()), pa.array([x.tolist() for x in wholes], pa.list_(pa.bool_()))], ["word", "keys", "wholes"])


def _long_neighbours(words: DataFrame) -> DataFrame:
    """word, near, best_n, best from the pairs of which one word at least is longer than ``LONG``."""
    some = cut(words.where(F.length("word") >= LONG).withColumn("id", F.xxhash64("word")))
    keys = some.select("word").mapInArrow(_hashed, "word string, keys array<long>, wholes array<boolean>")
    at = keys.select(F.xxhash64("word").alias("id"), F.explode(F.arrays_zip("keys", "wholes")).alias("k")).select("id", "k.keys", "k.wholes")
    met = at.groupBy("keys").agg(F.collect_set(F.struct("id", "wholes")).alias("m")).where(F.size("m") > 1)
    # as above: every member meets the others by its own row, no list of pairs of a group is ever built
    each = met.select("m", F.explode("m").alias("x")).select(F.col("x.id").alias("a"), F.explode(F.filter("m", lambda y: (y["id"] != F.col("x.id")) & ~(y["wholes"] & F.col("x.wholes")))).alias("y"))
    pairs = each.select("a", F.col("y.id").alias("b")).distinct()
    left, right = some.select(F.col("id").alias("a"), "word"), some.select(F.col("id").alias("b"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    known = pairs.join(left, "a").join(right, "b").where(F.greatest(F.length("word"), F.length("best")) > LONG)
    known = known.where(F.levenshtein("word", "best", 1) == 1)
    return known.select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of minus n and word) of every word of ``words`` (word, n) that differs from another by exactly
    one inserted, deleted or replaced character. Equal words must have been counted together."""
    turned = rotations(words.where(F.length("word") <= LONG)).repartition("key").sortWithinPartitions("key")
    found = turned.mapInArrow(_scan, "word string, near long, best_n long, best string")
    if not words.where(F.length("word") > LONG).isEmpty():
        found = found.union(_long_neighbours(words))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus_n"), "best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): forms followed to the last, each round doubling the steps. A form is at least ten
    times as frequent as its word, so 64-bit counts end within 19 steps and ``ROUNDS`` rounds are never used up."""
    r = forms.select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        onward = r.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if r.join(small(onward.select("root"), FORMS_ROWS), "root", "left_semi").isEmpty():
            return r
        r = cut(r.join(small(onward, FORMS_ROWS), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    raise RuntimeError("forms have not ended")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, twice: int = TWICE, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word (``counted_words``) with at least ``twice`` occurrences.

    ``form`` is the near word of the largest n (ties: smallest in code-point order), if that is at least ``ratio`` times the
    word's n, else null, and ``form_n`` its n; ``root`` is the last of the chain of forms, the word itself if it has none. A null
    text has no words, a null id counts as an empty one; empty texts have none either; repeated rows count as often as they are
    there; texts and words of any length are taken whole; an empty table gives an empty result; other columns are ignored."""
    words = cut(counted_words(docs, text, doc_id, least, every).where(F.col("n") >= twice))
    near = near_words(words)
    fits: Column = -F.col("best.minus_n") >= ratio * F.col("n")
    named = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.best")).alias("form"), F.when(fits, -F.col("best.minus_n")).alias("form_n")))
    last = roots(named.where("form is not null").select("word", "form"))
    return named.join(small(last, FORMS_ROWS), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same from its definition: crc32 byte by byte over a computed table, one join for replaced and one for missing characters.
SQL = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST} GROUP BY doc_id, run),
hexed AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM per),
crc AS (SELECT run, k, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: CAST('0x' || substr(x, i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h FROM hexed, tab),
said AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM crc),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM said WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {TWICE}),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word, y.word AS v, y.n AS vn FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word
UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, v, vn, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY vn DESC, v) AS r FROM near),
named AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.vn >= {RATIO} * w.n THEN b.v END AS form, CASE WHEN b.vn >= {RATIO} * w.n THEN b.vn END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
chain AS (SELECT word, word AS root FROM named UNION ALL SELECT c.word, m.form FROM chain c JOIN named m ON m.word = c.root AND m.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN named m ON m.word = c.root AND m.form IS NULL)
SELECT n.word, n.form, e.root, n.n, n.n_near, n.form_n FROM named n JOIN ends e USING (word)"""
