"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. The lengths of its tokens give every token's span of characters, and an interval join of these
spans with the document's sections (both sorted, within one row) attributes each token; a token that crosses a boundary goes by an
explicit rule. Counting each section on its own would cut tokens at the boundaries and count too many.

The vocabulary is read once on the driver (about a megabyte, whatever the input) and sent to the tasks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: first: the section of the token's first character; most: the section with most of its characters, the earlier on ties.
RULES = ("first", "most")
OUTSIDE = -1

Batches = Iterator[pa.RecordBatch]
_encoders: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the bytes of every token; built once per worker."""
    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encoders[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[key]


def token_spans(text: str, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of every token of ``text`` and one past its last. Tokens that share a character's bytes share it."""
    encoding, sizes = encoder(vocabulary)
    stop = np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text), np.int64)])
    start = np.concatenate(([0], stop[:-1])).astype(np.int64)
    if len(text) == (stop[-1] if len(stop) else 0):
        return start, stop
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[start], char[stop - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines of ``text`` as sections; a line feed belongs to the line it ends."""
    sizes = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    stop = np.cumsum(sizes)
    stop[-1] -= 1
    return np.concatenate(([0], stop[:-1])), stop


def tidy(start: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sections within the text and apart from each other: what two share belongs to the one that starts first."""
    start, stop = np.clip(start, 0, n), np.clip(stop, 0, n)
    order = np.lexsort((stop, start))
    ahead = np.maximum.accumulate(np.concatenate(([0], stop[order][:-1]))) if len(order) else stop
    out = start.copy()
    out[order] = np.maximum(start[order], ahead)
    return out, np.maximum(out, stop)


def attribute(begin: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of every section and those outside all. Sections are apart from each other, in any order."""
    order = np.lexsort((stop, start))
    order = order[start[order] < stop[order]]
    s, e, counts = start[order], stop[order], np.zeros(len(start), np.int64)
    if not len(order):
        return counts, len(begin)
    low = np.searchsorted(e, begin, side="right")  # the first section that ends after the token begins
    low_in = np.minimum(low, len(order) - 1)
    touch = (low < len(order)) & (s[low_in] < end)
    pick = low_in.copy()
    if rule == "first":
        touch &= s[low_in] <= begin
    else:
        best = np.minimum(e[low_in], end) - np.maximum(s[low_in], begin)
        high = np.searchsorted(s, end, side="left")  # one past the last section that starts before the token ends
        for step in range(1, int((high - low).max(initial=0))):
            later = low + step
            k = np.minimum(later, len(order) - 1)
            share = np.where(later < high, np.minimum(e[k], end) - np.maximum(s[k], begin), 0)
            pick = np.where(share > best, k, pick)
            best = np.maximum(best, share)
    np.add.at(counts, order[pick[touch]], 1)
    return counts, int((~touch).sum())


def _count(vocabulary: bytes, rule: str, given: bool):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            owner, number, starts, stops, counts = [], [], [], [], []
            spans = batch.column("sections").to_pylist() if given else None
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                if given:
                    rows = [(x["start"], x["stop"]) for x in spans[i] or [] if x and x["start"] is not None and x["stop"] is not None]
                    start, stop = tidy(*(np.array([r[k] for r in rows], np.int64) for k in (0, 1)), len(text))
                else:
                    start, stop = line_sections(text)
                n, outside = attribute(*token_spans(text, vocabulary), start, stop, rule)
                extra = [OUTSIDE] if outside else []
                owner.append(np.full(len(n) + len(extra), i))
                number.append(np.concatenate((np.arange(len(n)), np.array(extra, np.int64))))
                starts.append(np.concatenate((start, np.zeros(len(extra), np.int64))))
                stops.append(np.concatenate((stop, np.full(len(extra), len(text)))))
                counts.append(np.concatenate((n, np.array([outside] * len(extra), np.int64))))
            if owner:
                flat = [pa.array(np.concatenate(x).astype(np.int64)) for x in (number, starts, stops, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(owner).astype(np.int64))), *flat], ["doc_id", "section", "start", "stop", "n_tokens"])

    return work


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sections: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs`` and section: doc_id, section (0, 1, ...), start and stop (characters), n_tokens.

    ``sections`` names an array column of (start, stop); without it the sections are the lines of the text. Sections are cut to
    the text; where two overlap, the one that starts first keeps what they share; sections with a null bound are left out.
    ``rule`` is one of ``RULES``. Tokens outside all sections are counted in a row with section ``OUTSIDE``, so a document's rows
    add up to its tokens. Null and empty texts have no tokens (as lines: one empty section); repeated rows and null ids keep
    their rows; an empty table gives an empty result; other columns are ignored. ``vocabulary`` is the path of a rank file."""
    if rule not in RULES:
        raise ValueError(f"rule is {rule!r}, not one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    own = [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    kind, given = docs.schema[doc_id].dataType.simpleString(), sections is not None
    return docs.select(*own).mapInArrow(lambda b: _count(ranks.value, rule, given)(b), f"doc_id {kind}, section long, start long, stop long, n_tokens long")


def gathered(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the array column ``sections`` from ``spans`` (doc_id, start, stop), ordered by start and stop; documents
    without any have null. A document's sections are bounded by the document."""
    per_doc = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("sections"))
    return docs.drop("sections").withColumn("__id", F.col(doc_id)).join(per_doc, "__id", "left").drop("__id")
