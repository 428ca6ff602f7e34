"""Links inside markdown bodies that may hold inline HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeflow.functions.markup import TAG, attribute

#: [text](url "title"): brackets in the text may nest once, the url may stand in angle brackets, the title in any quotes.
MARKDOWN = r"""!?\[((?:[^\[\]]|\[[^\[\]]*+\])*+)\]\(\s*<?([^)\s>]*)>?(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)"""
AUTOLINK = r"<(https?://[^>\s]+)>"
ANCHOR = r"""(?is:<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?</a>)"""
BROKEN_STARTS = ["/", "#", "https://docs.google.com", "bookmark", "file://"]


def found(body: Column) -> Column:
    """Array of (url, link_text) in reading order: markdown links with or without titles, bare links in angle brackets, and
    anchors with an href in any quotes and markup inside. Images are not links; an anchor's text is what is left without tags."""
    whole = F.regexp_extract_all(body, F.lit(f"{MARKDOWN}|{AUTOLINK}|{ANCHOR}"), F.lit(0))
    links = F.filter(whole, lambda m: ~m.startswith("!"))

    def read(m: Column) -> Column:
        opening = F.regexp_extract(m, r"""(?is)^<a(\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", 1)
        bare = F.regexp_extract(m, f"^{AUTOLINK}$", 1)
        url = F.when(m.startswith("["), F.regexp_extract(m, MARKDOWN, 2)).when(bare != "", bare).otherwise(attribute(opening, "href"))
        inner = F.regexp_replace(m, TAG, "")
        return F.struct(url.alias("url"), F.when(m.startswith("["), F.regexp_extract(m, MARKDOWN, 1)).when(bare != "", bare).otherwise(inner).alias("link_text"))

    anchored = F.transform(links, read)
    return F.filter(anchored, lambda x: (x["url"] != "") | (x["link_text"] == ""))


def external(url: Column, own_domain: str) -> Column:
    return url.startswith("http") & ~url.contains(own_domain)


def looks_broken(url: Column) -> Column:
    hit = url == "about:blank"
    for start in BROKEN_STARTS:
        hit = hit | url.startswith(start)
    return hit
