"""Secret scan with a random forest for false-positive removal, with DataFrame functions and Spark ML only.

Candidates are runs of key-like characters with a digit in them, values after key words, passwords in addresses and known key
formats (``VALUES``). Their labelled findings come from formats that leave no doubt
(``CERTAIN``; a caller can give its own, hand-labelled ones instead). The forest never sees those formats: its features are the
length, the transitions between kinds of characters, how much of the candidate the corpus itself uses as words (dictionary
coverage over all texts), marks of paths, and the words around. It then judges every candidate. The fit uses a bounded sample of
the labelled findings of either label (``SAMPLE``); candidates, dictionary counts and scores cover all texts."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import small, smallest_hashes, words
from tomeflow.session import cut

LEAST = 16
#: Key formats that need no digit.
KNOWN = r"AKIA[A-Z2-7]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,}"
#: A candidate: at least ``LEAST`` key characters in a row, one of them a digit, or a known format.
CANDIDATE = rf"(?<![A-Za-z0-9+/_.@:-])(?=[A-Za-z+/_.@:-]*[0-9]|{KNOWN})[A-Za-z0-9+/_.@:-]{{{LEAST},}}=*"
#: Least characters of a value after a key word with = or :, or of a password in user:password@host; these need no digit.
SHORT = 8
KEYED = r"(?:pass(?:word|wd)?|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*[:=]\s*[\"']?"
#: Values that are candidates wherever they begin, tried on a word after the two words before it (the value is in the last word).
ADDRESS = rf"[^\s/:@](?<!mail|mailto):([^\s/:@\"']{{{SHORT},}})@[A-Za-z0-9]"
VALUES = (
    rf"(?i){KEYED}([A-Za-z0-9+/_.@:!#$%^&*?~-]{{{SHORT},}}=*)(?=\S*$)",
    rf"{ADDRESS}(?=\S*$)",
    rf"(?<![A-Za-z0-9])({KNOWN})(?=\S*$)",
)
#: Any of them in a whole text, without regard to words.
ANY_VALUE = "|".join(v.replace("(?i)", "").replace(r"(?=\S*$)", "").join(("(?i:", ")") if v.startswith("(?i)") else ("(?:", ")")) for v in VALUES)
#: A name before a colon, which is cut off a candidate whose rest is one too; not a scheme.
NAME = r"^[A-Za-z][A-Za-z_-]{2,}:(?![:/])"
#: Formats that leave no doubt, tried in order on the candidate (c), the words before it (before) and its own word (word).
CERTAIN = (
    (True, r"^AKIA[A-Z2-7]{16}$", None),
    (True, r"^gh[pousr]_[A-Za-z0-9]{36,}$", None),
    (True, r"^(sk|rk)_(live|test)_[A-Za-z0-9]{16,}$", None),
    (True, r"^xox[abprs]-[A-Za-z0-9-]{10,}$", None),
    (True, r"^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None),
    (True, r"[0-9]", r"[^\s/:@]+://[^\s/:@]+:$"),
    (False, r"^(?!.*[^/:@](?<!mail|mailto):[^/:@]+@).*@[A-Za-z0-9-]+\.", None),
    (False, r"^[0-9 .:+/-]+$", None),
    (False, r"^(?!.*[^/:@](?<!mail|mailto):[^/:@]+@)((https?:)?//|www\.)", None),
    (False, r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),
    (True, r"[0-9]", r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*[:=]\s*[\"']?$"),
    (False, r"^[A-Za-z]+[.:/-]?[0-9]{1,4}[.:]?$", None),
)
KEYWORD = r"(?i)pass|secret|token|key|auth|credential|bearer|login"
#: Labelled findings of each label in the fit, and to how many rows a label with fewer is repeated.
SAMPLE = 20_000
FEW = 20
TREES = 20
DEPTH = 6
THRESHOLD = 0.5
DICTIONARY_ROWS = 500_000
FEATURES = ("length", "upper", "lower", "digits", "marks", "changes", "vowels", "hexadecimal", "distinct", "dictionary", "slashes", "extension", "source_path", "key_before", "key_near", "assigned", "quoted")


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source") -> DataFrame:
    """One row per candidate: row_key, doc_id, source, word_no, part, candidate, before (the two words before it and what
    precedes it in its own word), after (the next word)."""
    w = words(F.col(text))
    src = F.coalesce(F.col(source).cast("string"), F.lit("")) if source and source in docs.columns else F.lit("")
    read = docs.where(F.col(text).rlike(CANDIDATE) | F.col(text).rlike(ANY_VALUE)).select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).alias("doc_id"), src.alias("source"), w.alias("w"))
    numbered = F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("word_no"), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("left")))
    said = lambda x: F.concat_ws(" ", x["left"], x["word"])
    wanted = lambda x: (F.length(x["word"]) >= SHORT) & (x["word"].rlike(CANDIDATE) | reduce(or_, (said(x).rlike(v) for v in VALUES)))
    rows = read.select("row_key", "doc_id", "source", "w", F.explode(F.filter(numbered, wanted)).alias("n"))
    rows = rows.select("row_key", "doc_id", "source", "n.*", F.coalesce(F.get("w", F.col("n.word_no") + 1), F.lit("")).alias("after"))
    bare = lambda c: F.regexp_replace(c, r"[.:,-]+$", "")
    # a lookahead to the end lets a value be in the last word only
    whole = F.concat_ws(" ", "left", "word")
    values = F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all(whole, F.lit(v), 1) for v in VALUES)), bare))
    rows = rows.withColumn("values", F.filter(values, lambda c: F.length(c) >= SHORT))
    runs = F.transform(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1), bare)
    rest = lambda c: F.regexp_replace(c, NAME, "")
    stands = lambda c: (F.length(rest(c)) >= LEAST) & rest(c).rlike("[0-9]") & ~c.rlike(r":[^/:@]+@")
    runs = F.transform(runs, lambda c: F.when((F.length(c) >= LEAST) & (stands(c) | F.array_contains("values", rest(c))), rest(c)).otherwise(c))
    # runs too short keep their number; a run that is a piece of a value, or the same, is given once
    more = F.filter("values", lambda v: ~F.exists("runs", lambda c: c == v))
    # an address with a password in it is no candidate, its password is
    held = F.filter(F.transform("runs", lambda c, i: F.struct(i.alias("part"), c.alias("candidate"))), lambda p: ((F.length(p["candidate"]) >= LEAST) & ~p["candidate"].rlike(ADDRESS)) | F.array_contains("values", p["candidate"]))
    added = F.transform(more, lambda c, i: F.struct((F.size("runs") + i).alias("part"), c.alias("candidate")))
    rows = rows.withColumn("runs", runs).withColumn("p", F.explode(F.concat(held, added))).select("*", "p.part", "p.candidate")
    before = F.concat_ws(" ", "left", F.expr("left(word, instr(word, candidate) - 1)"))
    return rows.select("row_key", "doc_id", "source", "word_no", "part", "candidate", before.alias("before"), "after")


def certain(candidate: Column, before: Column) -> Column:
    """1 or 0 where a format leaves no doubt, else null."""
    out = None
    for secret, pattern, context in CERTAIN:
        hit = candidate.rlike(pattern) if context is None else candidate.rlike(pattern) & before.rlike(context)
        out = F.when(hit, int(secret)) if out is None else out.when(hit, int(secret))
    return out.otherwise(F.lit(None).cast("int"))


def _share(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(kind)) / F.length(c)


def features(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with the columns ``FEATURES``. Dictionary coverage is the share of the candidate's characters that lie in runs of
    three or more letters which occur, lower-cased, as words of the corpus at least twice; occurrences are counted over all texts."""
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), 1)
    sought = cut(found.select(F.explode(runs(F.col("candidate"))).alias("run")).distinct())
    # counted before the join: a frequent word is one row per task, and at most the sought words come out
    said = docs.select(F.explode(words(F.lower(F.col(text)))).alias("run")).where(F.length("run") >= 3)
    counts = said.groupBy("run").count().where("count >= 2").select("run", F.length("run").alias("len"))
    known = cut(counts.join(small(sought, DICTIONARY_ROWS), "run", "left_semi"))
    each = found.select("candidate").distinct().select("candidate", F.explode(runs(F.col("candidate"))).alias("run"))
    covered = each.join(known, "run").groupBy("candidate").agg(F.sum("len").alias("covered"))
    c, b = F.col("candidate"), F.col("before")
    changes = F.regexp_count(c, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])")) / F.length(c)
    measured = {
        "length": F.length(c), "upper": _share(c, "[A-Z]"), "lower": _share(c, "[a-z]"), "digits": _share(c, "[0-9]"), "marks": _share(c, "[^A-Za-z0-9]"),
        "changes": changes, "vowels": _share(c, "(?i)[aeiou]"), "hexadecimal": _share(c, "[0-9a-f]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "dictionary": F.coalesce(F.col("covered"), F.lit(0)) / F.length(c), "slashes": _share(c, "[/.]"), "extension": c.rlike(r"\.[a-z]{2,5}$"),
        "source_path": F.col("source").rlike("(?i)test|example|sample|doc|mock"), "key_before": F.substring(b, -24, 24).rlike(KEYWORD), "key_near": F.concat_ws(" ", b, "after").rlike(KEYWORD),
        "assigned": b.rlike(r"[:=]\s*[\"']?$"), "quoted": b.rlike(r"[\"']$"),
    }
    return found.join(covered, "candidate", "left").select(*found.columns, *(measured[f].cast("double").alias(f) for f in FEATURES))


def score(measured: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``measured`` (with ``label`` 1, 0 or null) and ``score``, the forest's share for "secret". The fit takes, of each label, the
    ``sample`` labelled rows with the smallest hash; weights bring both labels to equal shares, as all labelled rows would have
    them. Labels with few rows are repeated up to ``FEW``, so that hardly a tree draws none. Without labelled rows of both kinds
    there is no forest: the score is the label, and 0 where there is none."""
    own = [c for c in measured.columns if c not in FEATURES]
    told = cut(measured.where("label is not null").select("candidate", F.col("label").cast("double").alias("label"), *FEATURES).distinct())
    train = cut(reduce(DataFrame.union, (smallest_hashes(told.where(F.col("label") == k), sample, "candidate", "label", *FEATURES) for k in (0, 1))))
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return measured.select(*own, F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("score"))
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    copies = {1: max(1, math.ceil(FEW / ones)), 0: max(1, math.ceil(FEW / (n - ones)))}
    weight = F.when(F.col("label") == 1, n / (2 * ones * copies[1])).otherwise(n / (2 * (n - ones) * copies[0]))
    repeats = F.explode(F.array_repeat(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0])))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt", weightCol="weight")
    model = forest.fit(gather.transform(train.withColumn("weight", weight).withColumn("copy", repeats)).coalesce(2))
    return model.transform(gather.transform(measured)).select(*own, vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate with its ``score`` and ``is_secret`` (score at least ``THRESHOLD``): row_key (hash of id and text), doc_id,
    word_no, part, candidate, label, score, is_secret.

    ``labelled`` (candidate, label) replaces the formats of ``CERTAIN`` as the source of labels. Null and empty texts have no
    candidates; equal candidates in equal surroundings get equal scores; a repeated row repeats its findings; a null id keeps its
    findings; very long texts are searched whole; an empty table gives an empty result; other columns are ignored."""
    found = cut(candidates(docs, text, doc_id, source))
    if labelled is None:
        known = found.withColumn("label", certain(F.col("candidate"), F.col("before")))
    else:
        known = found.join(labelled.groupBy("candidate").agg(F.max("label").alias("label")), "candidate", "left")
    judged = score(features(known, docs, text))
    return judged.select("row_key", "doc_id", "word_no", "part", "candidate", "label", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret found in a text replaced by ``mark`` wherever it stands in that text; n_chars, if there, is
    brought up to date. All rows and columns stay. A row's secrets are bounded by its own text."""
    hits = scan(docs, text, doc_id, source).where("is_secret").select("row_key", "candidate").distinct()
    longest = F.array_sort(F.collect_list(F.struct((-F.length("candidate")).alias("k"), "candidate")))
    per_row = cut(hits.groupBy(F.col("row_key").alias("__key")).agg(longest.alias("__secrets")))
    joined = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text))).join(small(per_row, 100_000), "__key", "left")
    masked = F.aggregate("__secrets", F.col(text), lambda t, s: F.replace(t, s["candidate"], F.lit(mark)))
    out = joined.withColumn(text, F.coalesce(masked, F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__secrets").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
