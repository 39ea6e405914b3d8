"""HTML to text with regular expressions inside the JVM, and a parser-based variant."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import replaced, strip

#: Subtrees that are dropped, and start tags that begin a line (fixed values).
DROPPED = ("script", "style", "table")
BREAKS = ("p", "div", "br", "tr")
ENTITIES = [("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
NESTED_TABLES = 3


def is_html(raw: Column) -> Column:
    return F.lower(raw).rlike("<html|<body|<div")


def tidy(text: Column) -> Column:
    """Collapse blank lines first, then blanks, then blanks before a line's end."""
    for pattern, new in ((r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (" \n", "\n")):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def html_to_text(html: Column) -> Column:
    """Text nodes joined by blanks, with a line end before each paragraph-like tag.

    Only the order of text and start tags matters, so no tree is needed.  Tables inside tables go from
    the innermost outwards, ``NESTED_TABLES`` levels deep.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<![^>]*>", " ")
    for tag in DROPPED[:2]:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    for _ in range(NESTED_TABLES):
        text = F.regexp_replace(text, rf"(?is)<{DROPPED[2]}\b(?:(?!<{DROPPED[2]}\b).)*?</{DROPPED[2]}\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)<({'|'.join(BREAKS)})(\s[^>]*)?/?>", " \n ")
    text = F.regexp_replace(text, r"</?[a-zA-Z][^>]*>", " ")
    return tidy(replaced(text, ENTITIES))


def document_text(raw: Column) -> Column:
    """HTML is converted; anything else stays as it is, uncleaned."""
    return F.when(is_html(raw), html_to_text(raw)).otherwise(raw)


def links(html: Column) -> Column:
    """Hrefs of HTML pages; without any, hrefs of plain text files."""
    pages = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+\.html?)"'), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+\.txt)"'), F.lit(1))
    return F.when(F.size(pages) > 0, pages).otherwise(texts)


class _Walk(HTMLParser):
    """Text of a document node by node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag in DROPPED
        if tag in BREAKS and not self.inside:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in BREAKS and not self.inside:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.inside = max(0, self.inside - (tag in DROPPED))

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def _walked(html: str | None) -> str | None:
    if html is None:
        return None
    walk = _Walk()
    walk.feed(html)
    walk.close()
    return " ".join(walk.parts)


def html_to_text_parsed(html: Column) -> Column:
    """The same by a parser: all entities, and tables nested to any depth."""

    @F.pandas_udf("string")
    def nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield part.map(_walked, na_action="ignore")

    return tidy(nodes(html))
