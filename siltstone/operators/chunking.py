"""Sentences and overlapping chunks, as array expressions inside each row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE, once, strip

#: Literals whose full stop ends no sentence; no word boundary is asked for (fixed values).
ABBREVIATIONS = [
    "U.S.", "U.K.", "Inc.", "Corp.", "Ltd.", "Co.", "No.", "Sec.", "Dept.", "i.e.", "e.g.", "vs.", "approx.", "est.",
    "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec.",
]
DOT = "__DOT__"
SIZE, OVERLAP, MIN_SIZE = 800, 150, 100


def protected() -> str:
    """A pattern for an abbreviation that ends where it is tested.

    Abbreviations are protected one after the other, so one whose inner full stop ends an earlier one of the list is
    none (``e.g.`` in ``i.e.g.``).
    """
    out = []
    for n, a in enumerate(ABBREVIATIONS):
        heads = [a[: p + 1] for p, c in enumerate(a[:-1]) if c == "."]
        before = "".join(f"(?<!{re.escape(b.removesuffix(h))})" for b in ABBREVIATIONS[:n] for h in heads if b.endswith(h))
        out.append(before + re.escape(a))
    return "|".join(out)


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences: cut before capitals after a stop that ends no abbreviation, and at blank lines."""
    cut = F.split(text, rf"(?<=[.!?])(?={SPACE})(?<!{protected()}){SPACE}+(?=[A-Z])|(?<=\n)\n+")
    return F.filter(F.transform(cut, lambda s: strip(F.replace(s, F.lit(DOT), F.lit(".")))), lambda s: s != "")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_SIZE) -> Column:
    """A long text cut at fixed steps, stripped; short pieces go."""
    _positive_step(size, overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size)))), lambda x: F.length(x) >= least)


def _positive_step(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under the chunk size")


def pack(found: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_SIZE) -> Column:
    """Sentences packed into chunks of about ``size`` characters.

    A full chunk is emitted and the sentences at its end that fit into ``overlap`` are carried over;
    the length then counts from ``overlap``, whatever was carried.  A sentence beyond ``size`` empties the
    chunk and is cut into windows.  Chunks under ``least`` are lost.
    """
    _positive_step(size, overlap)
    none = F.array().cast("array<string>")

    def flushed(state: Column) -> Column:
        text = strip(F.array_join(state["cur"], " "))
        return F.concat(state["out"], once(text, lambda t: F.when(F.length(t) >= least, F.array(t)).otherwise(none)))

    def carried(cur: Column) -> Column:
        start = F.struct(none.alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))

        def step(s: Column, x: Column) -> Column:
            more = s["used"] + F.length(x) + 1
            fits = s["open"] & (more <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(fits, more).otherwise(s["used"]).alias("used"), fits.alias("open"))

        return F.aggregate(F.reverse(cur), start, step, lambda s: s["kept"])

    def state(out: Column, cur: Column, used: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), used.cast("int").alias("used"))

    def merge(s: Column, x: Column) -> Column:
        n = F.length(x)
        long = state(F.concat(F.when(F.size(s["cur"]) > 0, flushed(s)).otherwise(s["out"]), windows(x, size, overlap, least)), none, F.lit(0))
        full = state(flushed(s), F.concat(carried(s["cur"]), F.array(x)), overlap + n + 1)
        room = state(s["out"], F.concat(s["cur"], F.array(x)), s["used"] + n + 1)
        return F.when(n > size, long).when((s["used"] + n + 1 > size) & (F.size(s["cur"]) > 0), full).otherwise(room)

    return F.aggregate(found, state(none, none, F.lit(0)), merge, flushed)


def chunks(sections: DataFrame, keys: tuple[str, ...], text: str = "body", **sizes) -> DataFrame:
    """One row a chunk: id from its content and place, index, total, text and length.

    ``keys`` name the section a chunk belongs to.  Ids depend on nothing but the row, so a second run
    replaces chunks instead of adding them.
    """
    cut = sections.withColumn("_sentences", sentences(F.col(text))).withColumn("_chunks", pack(F.col("_sentences"), **sizes))
    each = cut.select(*keys, F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", "text"))
    each = each.where("text is not null")  # an inner explode would test the array's size before, and so pack twice
    named = F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("chunk_index").cast("string"), "text"), 256)
    return each.select(named.alias("chunk_id"), *keys, "chunk_index", "total_chunks", "text", F.length("text").alias("char_count"))


def chunk_stats(chunked: DataFrame, company: str = "company", section: str = "section") -> DataFrame:
    """Counts by (company, section), by company, and in all, in one pass."""
    return chunked.rollup(company, section).agg(F.count("*").alias("total_chunks"))


def stats_by_company(chunked: DataFrame, company: str = "company", section: str = "section") -> DataFrame:
    """One row a company: chunks, and a map of chunks by section."""
    counts = chunked.groupBy(company, section).agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(section, F.lit("")), "n"))))
    return counts.groupBy(company).agg(F.sum("n").alias("total_chunks"), entries.alias("by_section"))
