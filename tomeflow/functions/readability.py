"""Per-row text counts behind the readability metrics.

Rules of this package: a sentence ends in . ! or ?; a word is a run of letters, digits or apostrophes; a syllable is
a run of vowels once accents are folded, at least one per word; a sentence is passive when a form of *to be* is
followed by a word in -ed or -en. Formulas: Flesch 1948 and Kincaid et al. 1975.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeflow.functions.text import ACCENTED, PLAIN

WORD = r"[\p{L}\p{N}']+"
SENTENCE_END = r"[.!?]+(?:\s|\z)"
PARAGRAPH = r"\S[^\n]*"
PASSIVE = r"(?:\A|[^\p{L}\p{N}])(?:is|are|was|were|be|been|being)\s+[a-z]+(?:ed|en)(?:\z|[.!?]|[^\p{L}\p{N}.!?][^.!?]*)"


def counts(text: Column) -> dict[str, Column]:
    low = F.translate(F.lower(text), ACCENTED, PLAIN)
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    return {
        "words": F.size(words).cast("bigint"),
        "sentences": F.regexp_count(text, F.lit(SENTENCE_END)).cast("bigint"),
        "paragraphs": F.regexp_count(text, F.lit(PARAGRAPH)).cast("bigint"),
        "syllables": (F.regexp_count(low, F.lit("[aeiouy]+")) + F.size(F.filter(words, lambda w: ~w.rlike("[aeiouy]")))).cast("bigint"),
        "passive": F.regexp_count(low, F.lit(PASSIVE)).cast("bigint"),
    }


def metrics(words: Column, sentences: Column, paragraphs: Column, syllables: Column, passive: Column) -> dict[str, Column]:
    s = F.greatest(sentences, F.lit(1))
    per_sentence, per_word = words / s, syllables / F.greatest(words, F.lit(1))
    return {
        "word_count": words.cast("double"),
        "words_per_sentence": F.round(per_sentence, 4),
        "sentences_per_paragraph": F.round(s / F.greatest(paragraphs, F.lit(1)), 4),
        "flesch_reading_ease": F.round(206.835 - 1.015 * per_sentence - 84.6 * per_word, 4),
        "flesch_kincaid_grade_level": F.round(0.39 * per_sentence + 11.8 * per_word - 15.59, 4),
        "passive_sentence_percentage": F.round(100.0 * passive / s, 4),
    }
