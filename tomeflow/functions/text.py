"""Text functions as Spark columns. All run inside generated JVM code; none is a Python UDF."""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def squeeze(c: Column) -> Column:
    """Collapse whitespace and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(c: Column, sep: str = "-") -> Column:
    """Lower-case ASCII slug; accents folded, other characters become one separator."""
    folded = F.translate(F.lower(c), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def literal(text: str) -> str:
    """Quote text for a Java regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replacement(text: str) -> str:
    """Quote text for the replacement side of ``regexp_replace``."""
    return re.sub(r"([\\$])", r"\\\1", text)


def strip_md_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\]\([^)]*\)", "]")


MARK_OPEN, MARK_CLOSE = '<strong><mark class="bg-yellow">', "</mark></strong>"
_CUT = "\u0001cut\u0001"


def match_context(body: Column, term: str, context: int = 100, distance: int = 200) -> Column:
    """Array of highlighted snippets around the matches of a literal, ignoring case; empty without a match.

    Matches closer than ``distance`` (at least ``context``) share a snippet; an ellipsis marks a cut side. The text is
    cut at the matches, each stretch between two matches is kept or shortened, and the pieces are joined again, so the
    work is linear in the text however many matches it holds.
    """
    pattern = f"(?iu){literal(term)}"
    parts = F.split(body, pattern, -1)
    marks = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    last = F.size(marks)

    def head(p: Column) -> Column:
        return F.substring(p, 1, context)

    def tail(p: Column) -> Column:
        return F.right(p, F.lit(context))

    def stretch(p: Column, i: Column) -> Column:
        n = F.length(p)
        first = F.concat(F.when(n > context, "…").otherwise(""), tail(p))
        final = F.concat(head(p), F.when(n > context, "…").otherwise(""))
        between = F.when(n < distance, p).otherwise(F.concat(head(p), F.lit("…" + _CUT + "…"), tail(p)))
        return F.when(i == 0, first).when(i == last, final).otherwise(between)

    pieces = F.zip_with(
        F.transform(parts, stretch), marks,
        lambda p, m: F.concat(p, F.coalesce(F.concat(F.lit(MARK_OPEN), m, F.lit(MARK_CLOSE)), F.lit(""))),
    )
    return F.when(last > 0, F.split(F.array_join(pieces, ""), _CUT)).otherwise(F.array().cast("array<string>"))


LINK = r"\[.*?\]\([^)]+\)"


def replace_text(text: Column, old: str, new: str, whole: bool | None = None) -> Column:
    """Replace a literal ignoring case. Link targets are left alone unless the term is itself a link."""
    pattern, to = f"(?iu){literal(old)}", replacement(new)
    plain = F.regexp_replace(text, pattern, to)
    if whole if whole is not None else old.lower().startswith(("http", "#")):
        return plain
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){LINK}|(?:[^\[]|\[(?!.*?\]\([^)]+\)))++"), F.lit(0))

    def one(t: Column) -> Column:
        head = F.regexp_extract(t, r"(?s)^(.*?\]\()", 1)
        kept = F.concat(F.regexp_replace(head, pattern, to), F.substring(t, F.length(head) + 1, F.length(t)))
        return F.when(t.rlike(rf"(?s)^{LINK}$"), kept).otherwise(F.regexp_replace(t, pattern, to))

    return F.when(text.contains("]("), F.array_join(F.transform(tokens, one), "")).otherwise(plain)


def normalize_chars(c: Column) -> Column:
    """No-break spaces become spaces; three characters used as tick boxes become one."""
    return F.translate(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), "\u00a0\u2610\u00a8\u007f", " \u25fb\u25fb\u25fb")


def rewrite_links(c: Column, mapping: dict[str, str]) -> Column:
    for old, new in mapping.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def emphasize(c: Column, term: str) -> Column:
    return F.regexp_replace(c, f"(?i)(?<!<em>)({literal(term)})(?!</em>)", "<em>$1</em>")


def looks_like_label(c: Column) -> Column:
    """``Label: value`` with a label of at most 80 characters."""
    return squeeze(F.regexp_replace(c, r"[\p{C}&&[^\s]]", "")).rlike(r"^\s*[^:\n]{1,80}:\s*\S*")


def is_placeholder_acronym(c: Column) -> Column:
    return F.upper(squeeze(c)).isin("N/A", "NA", "NONE", "TBD", "UNKNOWN")


def remove_page_breaks(html_class: Column, body: Column) -> tuple[Column, Column]:
    kept = F.filter(F.split(html_class, " "), lambda c: (c != "") & ~c.startswith("page-break"))
    return F.array_join(kept, " "), F.replace(body, F.lit("page-break"), F.lit(""))


def page_break_context(body: Column, html_class: Column) -> Column:
    top = F.exists(F.split(html_class, " "), lambda c: c.startswith("page-break"))
    found = match_context(strip_md_links(body), "page-break")
    head = F.when(top, '<strong><mark class="bg-yellow">Page break at top of section found.</mark></strong>').otherwise("")
    rest = F.array_join(F.transform(found, lambda s: F.concat(F.lit("<p>"), s, F.lit("</p>"))), "")
    none = F.lit("<p><em>Page break found in CSS classes or other locations</em></p>")
    return F.when(~top & (F.size(found) == 0), none).otherwise(F.concat(head, rest))


def mark_modified(body: Column) -> Column:
    for kind in ("version", "type"):
        body = F.regexp_replace(body, rf"(?i)Announcement {kind}:\s*(?:New|Initial)", f"Announcement {kind}: Modified")
    return body


def step_parts(name: Column) -> tuple[Column, Column]:
    """("2", " Title") for "Step 2: Title"; (null, name) otherwise."""
    is_step = F.lower(name).startswith("step") & name.contains(":")
    number = F.when(is_step, F.split_part(F.split_part(name, F.lit(":"), F.lit(1)), F.lit(" "), F.lit(2)))
    return number, F.when(is_step, F.split_part(name, F.lit(":"), F.lit(2))).otherwise(name)


def is_numbered_item(text: Column) -> Column:
    return text.rlike(r"^\d+(\s?(-|—|to|through)\s?\d+)?\.\s")


def is_footnote_ref(text: Column) -> Column:
    t = F.trim(text)
    return (t == "↑") | t.rlike(r"^\[\d+\]$")


def footnote_kind(href: Column) -> Column:
    h = F.trim(href)
    return F.when(h.startswith("#ref") | h.startswith("#ftnt"), "html").when(h.startswith("#footnote") | h.startswith("#endnote"), "docx")


def footnote_id_href(text: Column, href: Column) -> tuple[Column, Column]:
    number = F.regexp_extract(F.trim(text), r"^.(.*).$", 1)
    back = F.trim(href).startswith("#ftnt_")
    new_id = F.when(back, F.concat(F.lit("ftnt"), number)).otherwise(F.concat(F.lit("ftnt_ref"), number))
    return new_id, F.when(back, href).otherwise(F.concat(F.lit("#ftnt"), number))


ID_LIMIT = 40


def truncate_id(c: Column) -> Column:
    """Ids of the form ``12--name`` are cut to what a word processor accepts; others stay."""
    return F.when(c.rlike(r"^\d+--"), F.substring(c, 1, ID_LIMIT)).otherwise(c)


def truncate_anchor_links(html: Column) -> Column:
    return F.regexp_replace(html, rf'(<a\s[^>]*href="#(?=\d+--)[^"]{{{ID_LIMIT}}})[^"]*"', '$1"')


def split_labels(c: Column, sep: str = "|") -> Column:
    return F.transform(F.split(c, literal(sep)), lambda x: F.trim(x))


def strip_break_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)</?(br\s*/?|ins|del)>", "")


def strip_whitespace(c: Column) -> Column:
    """Collapse runs of whitespace and drop those next to tag edges and quotes."""
    return F.regexp_replace(F.regexp_replace(c, r"\s{2,}|\n+", " "), r'\s(?=[<>"])|(?<==")\s|(?<=[<>])\s', "")


def name_or_placeholder(name: Column, body: Column) -> Column:
    """The name, else the first three words of the body up to the first punctuation mark."""
    plain = F.regexp_replace(F.regexp_replace(body, r"(\*\*|__)(.*?)\1", "$2"), r"(\*|_)(.*?)\1", "$2")
    words = F.array_join(F.slice(F.split(squeeze(plain), " "), 1, 3), " ")
    cut = F.regexp_extract(words, r"^(.*?)([.,;:!?]|$)", 1)
    return F.when(name != "", name).when(words.rlike("[.,;:!?]"), cut).otherwise(F.concat(cut, F.lit("...")))


def date_display(ts: Column, today: Column) -> Column:
    day = F.date_format(ts, "MMM d")
    return F.when(F.to_date(ts) != today, day).otherwise(F.concat(day, F.lit(", "), F.date_format(ts, "h:mm a")))


def size_display(size: Column) -> Column:
    def unit(n: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", F.bround(size / n, 1))

    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, unit(1024, "KB")).otherwise(unit(1024 * 1024, "MB"))


def theme_parts(theme: Column) -> list[Column]:
    """orientation, owner, colour"""
    return [F.split_part(theme, F.lit("-"), F.lit(i)) for i in (1, 2, 3)]


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9!\-_.*'()]", "-"), "-+", "-"), "^-+|-+$", "")


def without_suffix(c: Column) -> Column:
    """Drop the last extension; a leading dot is not one."""
    return F.regexp_replace(c, r"(?<=[^./])\.[^./]*$", "")


def cover_path(c: Column, default: str = "img/cover.jpg") -> Column:
    rooted = F.replace(F.replace(c, F.lit("/static/"), F.lit("")), F.lit("/img/"), F.lit("img/"))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", default)
        .when(c.startswith("http"), c)
        .when(c.startswith("/"), rooted)
        .when(~c.contains("/"), F.concat(F.lit("img/cover-img/"), c))
        .otherwise(c)
    )


def metadata_value(c: Column) -> Column:
    """A whole-field ``{placeholder}`` or blank reads as empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.trim(c).rlike(r"^(\{[^{}]+\})?$"), "").otherwise(c)


def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def sanitize(c: Column) -> Column:
    """NFKC, without control and format characters, whitespace collapsed. Call on rows that need it, see ``sanitize_text``."""
    return squeeze(F.regexp_replace(F.arrow_udf(_nfkc, StringType())(c), r"[\p{C}]", ""))
