"""Attributes and character references of HTML, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeflow import fixed_values as V


#: A whole tag; ">" in a quoted attribute does not end it.
TAG = r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def attribute(attrs: Column | str, *names: str) -> Column:
    """Value of the first attribute with one of ``names``, in double, single or no quotes, any case; "" if there is none."""
    pattern = rf"""(?is)(?:^|[\s"'])(?:{"|".join(names)})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))"""
    return F.concat(*(F.coalesce(F.regexp_extract(attrs, pattern, k), F.lit("")) for k in (1, 2, 3)))


def decoded(text: Column) -> Column:
    """``text`` with named (``fixed_values.ENTITIES``) and numeric character references replaced; ``&amp;`` last, so that a
    reference that was itself escaped stays text. Numbers beyond four hex digits stay as they are."""
    out = text
    for pattern, base in (("&#([0-9]{1,5});", 10), ("(?i)&#x([0-9a-f]{1,4});", 16)):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        lead = "&#" if base == 10 else "&#x"

        def swap(acc: Column, n: Column, base: int, lead: str) -> Column:
            digits = F.lpad(F.conv(n, base, 16), 4, "0")
            return F.replace(acc, F.concat(F.lit(lead), n, F.lit(";")), F.decode(F.unhex(digits), "UTF-16BE"))

        out = F.aggregate(found, out, (lambda base, lead: lambda acc, n: swap(acc, n, base, lead))(base, lead))
    for name, char in V.ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return F.when(text.contains("&"), out).otherwise(text)
