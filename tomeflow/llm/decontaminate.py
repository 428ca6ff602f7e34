"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask such as ``1000010000100001`` looks at some of many consecutive words and ignores the rest, so a hit survives substituted
words. Hashes of all positions of all texts are joined with those of the benchmark; each hit names an item and a diagonal (place
in the text less place in the item), and the words along that diagonal are then compared one by one.

The masks lose no overlap. Where e of n words may differ, the n places fall into e + 1 classes by their remainder mod e + 1, and one
class at least has no difference in it. All classes have one shape, ones at every (e + 1)-th place, so one mask, laid at every
place, hits every allowed pattern. e depends on the item's length alone; up to 4 words nothing may differ and the mask is all
ones. Only masks of lengths that the benchmark has are laid on the texts.

What is joined: the benchmark's seeds and the hits are broadcast only after a count that stays under ``SMALL_ROWS``; beyond it
Spark shuffles both sides. Texts never pass a shuffle as long as the hits are few: they are read again and met by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import small, words
from tomeflow.session import cut

#: Longest stretch of an item that has to agree, and the share of its words that must be equal, as a fraction.
WINDOW = 20
EQUAL, OF = 4, 5
SMALL_ROWS = 200_000


def needed(n: int) -> int:
    """Equal words that a stretch of ``n`` needs."""
    return -(-EQUAL * n // OF)


def mask(n: int) -> str:
    """The mask for items of ``n`` words: it hits every stretch of min(n, ``WINDOW``) words with enough equal ones."""
    width = min(n, WINDOW)
    step = width - needed(width) + 1
    ones = width // step
    return "".join("1" if k % step == 0 else "0" for k in range((ones - 1) * step + 1))


def _seeds(hashes: Column, n: Column, masks: dict[int, str]) -> Column:
    """Array of one hash per place, mask (by number) after mask, from the words' hashes."""

    def of(k: int, m: str) -> Column:
        at = [i for i, bit in enumerate(m) if bit == "1"]
        hashed = F.transform(F.sequence(F.lit(0), n - len(m)), lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + o) for o in at)))
        return F.when(n >= len(m), hashed).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*(of(k, m) for k, m in masks.items()))


def _place(pos: Column, n: Column, masks: dict[int, str]) -> Column:
    """Place in the text of the ``pos``-th seed."""
    out, start = pos, F.lit(0)
    for m in list(masks.values())[:-1]:
        start = start + F.greatest(n - len(m) + 1, F.lit(0))
        out = F.when(pos >= start, pos - start).otherwise(out)
    return out


def _hashed(w: str) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def overlaps(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Texts that hold a benchmark item: rows (row_key, doc_id, item_id, similarity, n_matched, start_word), one per row and item.

    An item of n words is held where, along one alignment, at least four fifths (``EQUAL`` of ``OF``) of some min(n, ``WINDOW``)
    consecutive words of it are equal, lower-cased, words split at white space; so items under 5 words are held word for word.
    similarity is the best such share, n_matched the equal words of the whole item there, start_word where the item's first word
    falls (negative if the text starts inside it); ties go to the earliest place. Null and empty texts hold nothing; null and
    empty items are never held; repeated items with one id count once; rows with a null id are searched too, and ``row_key`` (a
    hash of id and text) names them. Empty tables give an empty result."""
    read = bench.select(F.col(item_id).alias("item_id"), words(F.lower(F.col(item_text))).alias("v")).withColumn("m", F.size("v"))
    items = cut(read.where("m > 0").distinct())
    # at most WINDOW different lengths count; items of one length share a mask
    lengths = sorted(r[0] for r in items.select(F.least("m", F.lit(WINDOW)).alias("m")).distinct().collect())
    masks = dict(enumerate(sorted({mask(n) for n in lengths})))
    if not masks:
        kind = docs.schema[doc_id].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"row_key long, doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, similarity double, n_matched long, start_word long")
    hashed = cut(items.select("item_id", "m", _hashed("v").alias("hashes")))
    seeds = None
    for k, m in masks.items():
        mine = hashed.where(F.least("m", F.lit(WINDOW)).isin([n for n in lengths if mask(n) == m]))
        part = mine.select("item_id", F.posexplode(_seeds(F.col("hashes"), F.col("m"), {k: m})).alias("j", "h"))
        seeds = part if seeds is None else seeds.union(part)
    seeds = cut(seeds)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), words(F.lower(F.col(text))).alias("w")).withColumn("n", F.size("w"))
    at = keyed.select("row_key", "n", _hashed("w").alias("hashes")).select("row_key", "n", F.posexplode(_seeds(F.col("hashes"), F.col("n"), masks)).alias("pos", "h"))
    met = at.join(small(seeds, SMALL_ROWS), "h").select("row_key", "item_id", (_place(F.col("pos"), F.col("n"), masks) - F.col("j")).alias("diagonal"))
    hits = cut(met.distinct())
    held = keyed.join(small(hits, SMALL_ROWS), "row_key").join(small(items, SMALL_ROWS // 20), "item_id")
    equal = F.transform(F.col("v"), lambda x, j: F.coalesce((F.get(F.col("w"), F.col("diagonal") + j) == x).cast("int"), F.lit(0)))
    width = F.least(F.col("m"), F.lit(WINDOW))
    held = held.select("row_key", "doc_id", "item_id", "diagonal", "m", equal.alias("equal"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("m") - width + 1), lambda s: F.aggregate(F.slice("equal", s, width), F.lit(0), lambda a, x: a + x)))
    scored = held.select(
        "row_key", "doc_id", "item_id", (best * OF >= width * EQUAL).alias("enough"), (best / width).alias("similarity"), F.aggregate("equal", F.lit(0), lambda a, x: a + x).cast("long").alias("n_matched"), F.col("diagonal").cast("long").alias("start_word")
    )
    kept = scored.where("enough")
    top = kept.groupBy("row_key", "doc_id", "item_id").agg(F.max(F.struct("similarity", "n_matched", (-F.col("start_word")).alias("before"))).alias("t"))
    return top.select("row_key", "doc_id", "item_id", "t.similarity", "t.n_matched", (-F.col("t.before")).alias("start_word"))


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns and repeated clean rows are kept."""
    held = cut(overlaps(docs, bench, text, doc_id).select("row_key").distinct())
    marked = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))
    return marked.join(small(held.withColumnRenamed("row_key", "__key"), SMALL_ROWS), "__key", "left_anti").drop("__key")


def _sql() -> str:
    w = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id AS id, {w} AS w FROM documents), b AS (SELECT DISTINCT item_id AS id, {w} AS v FROM benchmark WHERE len({w}) > 0),
dw AS (SELECT id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d), bw AS (SELECT id, least(len(v), {WINDOW}) AS width, unnest(v) AS x, unnest(range(len(v))) AS j FROM b),
met AS (SELECT dw.id AS doc_id, bw.id AS item_id, i - j AS diagonal FROM dw JOIN bw USING (x) GROUP BY ALL HAVING count(*) * {OF} >= any_value(width) * {EQUAL}),
eq AS (SELECT doc_id, item_id, diagonal, least(len(v), {WINDOW}) AS width,
  list_transform(range(0, len(v)), lambda j: CASE WHEN diagonal + j >= 0 AND diagonal + j < len(w) AND w[diagonal + j + 1] = v[j + 1] THEN 1 ELSE 0 END) AS e
  FROM met JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
sc AS (SELECT doc_id, item_id, diagonal, width, list_max(list_transform(range(1, len(e) - width + 2), lambda k: list_sum(e[k:k + width - 1]))) AS best, CAST(list_sum(e) AS BIGINT) AS n_matched FROM eq),
r AS (SELECT *, best / width AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, n_matched DESC, diagonal) AS k FROM sc WHERE best * {OF} >= width * {EQUAL})
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, n_matched, CAST(diagonal AS BIGINT) AS start_word, TRUE AS contaminated FROM r WHERE k = 1"""


SQL = _sql()
