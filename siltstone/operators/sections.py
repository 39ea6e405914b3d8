"""Named sections of long documents: starts, order, ends, slices.

The sections of a specification are few and known, so everything about a document is computed
in its own row; only the surviving sections are exploded.  Nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_wide, match_start, once, strip


@dataclass(frozen=True)
class Section:
    name: str
    patterns: tuple[str, ...]
    limit: int = 80_000


#: Sections of annual reports in document order: header patterns on lower-cased text, and the
#: longest slice in characters (fixed values).
ANNUAL_REPORT = [
    Section("business", (r"item\s*1(?![\.\s]*\d)[\.\s\-]{1,10}business", r"item\s*1(?![\.\s]*\d)[^\n]{0,20}\n\s{0,10}business"), 80_000),
    Section("risk_factors", (r"item\s*1a[\.\s]+risk\s*factors", r"item\s*1\s*a[\.\s]+risk\s*factors", r"risk\s*factors"), 120_000),
    Section("mda", (r"item\s*7[\.\s]+management.{0,10}discussion", r"management.{0,10}discussion\s*and\s*analysis"), 120_000),
    Section("market_risk", (r"item\s*7a[\.\s]+quantitative", r"item\s*7\s*a[\.\s]+quantitative", r"quantitative\s*and\s*qualitative\s*disclosures\s*about\s*market\s*risk"), 40_000),
    Section("financial_statements", (r"item\s*8[\.\s]+financial\s*statements", r"financial\s*statements\s*and\s*supplementary\s*data"), 60_000),
]
#: Sections must be longer than this once stripped.
MIN_CHARS = 200
#: A header in the first twentieth of a text stands in its table of contents.
SKIPPED_SHARE = 20
ANY_ITEM = r"\n\s*item\s+\d+[a-c]?\b"


def section_starts(text: Column, spec: list[Section]) -> Column:
    """An array: for each section the earliest match of any of its patterns after the skipped share."""
    skip = F.floor(F.length(text) / SKIPPED_SHARE).cast("int")
    rest = F.substring(F.lower(text), skip + 1, F.length(text))

    def starts(r: Column) -> Column:
        found = [[match_start(r["rest"], p, r["wide"]) + r["skip"] for p in s.patterns] for s in spec]
        return F.array(*(F.least(*f) if len(f) > 1 else f[0] for f in found))

    return once(F.struct(rest.alias("rest"), skip.alias("skip")), lambda r: once(F.struct(r["rest"], r["skip"], is_wide(r["rest"]).alias("wide")), starts))


def with_boundaries(docs: DataFrame, spec: list[Section], text: str = "text", end_at_any_item: bool = False) -> DataFrame:
    """Add ``sections``: an array of (section_no, section, start, end) of the kept sections.

    A start that is not beyond every earlier section's start is dropped; a section ends where the next
    kept one starts.  ``end_at_any_item`` ends it at the next numbered item header instead, where
    one comes first.  Each pattern is searched once a text.
    """

    def kept(starts: Column) -> Column:
        each = [F.get(starts, F.lit(i)) for i in range(len(spec))]
        before = [F.greatest(F.lit(-1), *each[:i], F.lit(-1)) for i in range(len(spec))]
        return F.array(*(F.when(start > most, start) for start, most in zip(each, before)))

    def bounds(starts: Column) -> Column:
        rows, later = [], F.length(text)
        for i in reversed(range(len(spec))):
            start, end = F.get(starts, F.lit(i)), later
            if end_at_any_item:
                body = F.substring(F.lower(F.col(text)), start + 2, end - start - 1)
                end = F.least(end, match_start(body, ANY_ITEM) + start + 1)
            row = F.struct(F.lit(i).alias("section_no"), F.lit(spec[i].name).alias("section"), start.cast("int").alias("start"), end.cast("int").alias("end"))
            rows.append(F.when(start.isNotNull(), row))
            later = F.coalesce(start, later)
        return F.filter(F.array(*rows[::-1]), lambda x: x.isNotNull())

    return docs.withColumn("sections", once(section_starts(F.col(text), spec), lambda s: once(kept(s), bounds)))


def section_bounds(docs: DataFrame, spec: list[Section], key: str = "doc_id", **options) -> DataFrame:
    """``key, section, start, end`` of every kept section."""
    found = with_boundaries(docs, spec, **options)
    # An inner explode would test the array's size before, and so compute it twice.
    return found.select(key, F.explode_outer("sections").alias("s")).where("s is not null").select(key, "s.section_no", "s.section", "s.start", "s.end")


def extract_sections(docs: DataFrame, spec: list[Section], keys: tuple[str, ...] = ("doc_id",), text: str = "text", **options) -> DataFrame:
    """``keys, section_no, section, body``: slices cut to their limit, stripped, and long enough."""
    limits = F.element_at(F.array(*(F.lit(s.limit) for s in spec)), F.col("s.section_no") + 1)
    size = F.least(F.col("s.end") - F.col("s.start"), limits)
    found = with_boundaries(docs, spec, text=text, **options).select(*keys, text, F.explode_outer("sections").alias("s")).where("s is not null")
    body = strip(F.substring(F.col(text), F.col("s.start") + 1, size))
    return found.select(*keys, "s.section_no", "s.section", body.alias("body")).where(F.length("body") > MIN_CHARS)


def filing_summary(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections found, in order, and their characters, for each document."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section"))), lambda x: x["section"])
    return sections.groupBy(key).agg(ordered.alias("sections_found"), F.sum(F.length("body")).alias("total_chars"))


def without_page_headers(text: Column) -> Column:
    """Drop lines that hold only a running header or a page number."""
    return F.regexp_replace(text, r"(?im)^[ \t]*(table of contents|\d{1,4})[ \t]*\n", "")
