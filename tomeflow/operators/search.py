"""Find and replace over a corpus, and text clean-up jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.functions import text as X

MIN_TERM = 3


def find_text(tree: DataFrame, term: str, include_name: bool = False) -> DataFrame:
    """Subsections whose body (or name) holds the term, with highlighted context.

    A plain ``contains`` drops the rows without a match before any snippet is cut.
    """
    if len(term.strip()) < MIN_TERM:
        return tree.limit(0)
    linky = term.lower().startswith(("http", "#"))
    body = F.col("body") if linky else X.strip_md_links(F.col("body"))
    in_body = F.lower(body).contains(term.lower())
    in_name = F.lower("name").contains(term.lower()) if include_name else F.lit(False)
    first = (F.lower("name") == "basic information") & (F.col("order") == 1) & (F.col("section_order") == 1)
    rows = tree.filter(~first & (in_body | in_name))
    wrap = lambda c, tag: F.array_join(F.transform(c, lambda s: F.concat(F.lit(f"<{tag}>"), s, F.lit(f"</{tag}>"))), "")
    out = rows.withColumn("body_matches", F.when(in_body, wrap(X.match_context(body, term), "div")))
    return out.withColumn("name_matches", F.when(in_name, wrap(X.match_context(F.col("name"), term), "span")))


def replace_in_subsections(subsections: DataFrame, chosen: DataFrame, old: str, new: str, include_name: bool = False) -> DataFrame:
    """Changed rows among the chosen ids; bodies and (optionally) names."""
    if not old or not new:
        return subsections.limit(0)
    rows = subsections.join(chosen.select("id").distinct(), "id", "left_semi")
    body = X.replace_text(F.col("body"), old, new)
    name = X.replace_text(F.col("name"), old, new, whole=True) if include_name else F.col("name")
    return rows.withColumn("new_body", body).withColumn("new_name", name).filter(
        (F.col("new_body") != F.col("body")) | (F.col("new_name") != F.col("name"))
    )


def sanitize_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """NFKC and clean-up in one pass. Plain ASCII is its own NFKC form, so such rows send a null to Python in place of their text."""
    text = F.coalesce(F.col(column), F.lit(""))
    plain = text.rlike(r"^\p{ASCII}*$")
    return df.withColumn(out, F.when(plain, X.squeeze(F.regexp_replace(text, r"\p{C}", ""))).otherwise(X.sanitize(F.when(~plain, text))))


def mark_modified(subsections: DataFrame) -> DataFrame:
    """Rows whose announcement wording changes to "Modified"."""
    return subsections.withColumn("new_body", X.mark_modified(F.col("body"))).filter("new_body <> body")
