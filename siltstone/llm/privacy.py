"""Personal data: patterns, then terms that disclose them by co-occurrence.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  Every different value
is a protected entity.  A term outside all values co-occurs with each value of its document; over the whole
corpus, term and entity have the pointwise mutual information
log2(n(t, e) N / (n(t) n(e))) in documents, and the entity the information log2(N / n(e)).
A term that carries at least ``share`` of the entity's information discloses it, however many documents
hold the entity: all its occurrences outside values, in every document, become spans of kind ``term``.
``sanitise`` replaces values by their kind, generalises disclosing terms to their shape, and removes terms
that never occur without the entity.

Counts are aggregated by key before they are joined.  As n(t, e) is at most n(e), a disclosing term is in at most
N^(1 - share) n(e)^share documents, so pairs are made only of terms under that bound, which loses nothing.
Candidate terms are told to all tasks only if there are at most ``BROADCAST_TERMS``; beyond, the counts of all terms are
joined with them.  Occurrences are found by a bitmap of fixed size and settled by a join on the term.

Defined results: null and empty texts have no spans; repeated rows give equal rows; in each kind
matches are leftmost and do not overlap, and failing ones are dropped without another try.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Memo, Workspace, map_rows

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
BROADCAST_TERMS = 200_000
#: Bits of the map of disclosing terms; a term sets the bits of the low and of the high 26 bits of its CRC.
MARK_BITS = 1 << 26
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: A match that fails where a number begins fails inside the number too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'`*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from their ``@``, so long runs of other characters cost no retries."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)) and m.end() > at:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of all pattern matches, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(found)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def entity_of(kind: int, value: str) -> str:
    """One name for a value however it is written."""
    return f"{KINDS[kind]}:{''.join(_DIGITS.findall(value)) if kind >= 2 else value.lower()}"


def term_of(word: str) -> str | None:
    """A word without punctuation around it, lower-cased; none if it says too little."""
    bare = word.strip(_EDGE).lower()
    return bare if len(bare) >= 3 else None


def contexts(text: str, spans, near: int) -> list[tuple[str, str, int, int, int]]:
    """``entity, term, start, end, context`` for the words within ``near`` of each span, outside all spans; a view of a text, no part of ``find``."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    from bisect import bisect_left, bisect_right

    inside: set[int] = set()
    bounds = []
    for start, _, end in spans:
        low, high = max(bisect_right(starts, start) - 1, 0), bisect_left(starts, end)
        bounds.append((low, high))
        inside.update(range(low, high))
    out = []
    for (start, kind, end), (low, high) in zip(spans, bounds):
        entity = entity_of(kind, text[start:end])
        beside = [i for i in (*range(max(low - near, 0), low), *range(high, min(high + near, len(words)))) if i not in inside]
        terms = [(term_of(text[slice(*words[i])]), words[i]) for i in beside]
        context = int.from_bytes(hashlib.blake2b(" ".join(t or "" for t, _ in terms).encode(), digest_size=8).digest(), "little", signed=True)
        for term, (a, b) in terms:
            if term:
                lead = len(text[a:b]) - len(text[a:b].lstrip(_EDGE))
                out.append((entity, term, a + lead, a + len(text[a:b].rstrip(_EDGE)), context))
    return out


def outside(text: str, spans) -> Iterator[tuple[str, int, int]]:
    """``term, start, end`` of every word of the text that no span touches."""
    at, ordered, end = 0, sorted((a, b) for a, _, b in spans), 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(ordered) and ordered[at][0] < b:
            end = max(end, ordered[at][1])
            at += 1
        if end <= a and (term := term_of(m.group())):
            word = m.group()
            yield term, a + len(word) - len(word.lstrip(_EDGE)), a + len(word.rstrip(_EDGE))


def found_spans(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: base counts, digest, spans, entities and, beside entities, the document's terms."""

    def start():
        def run(rows):
            for doc_id, version, text in rows:
                text = text or ""
                spans = base_spans(text)
                counts = Counter(kind for _, kind, _ in spans)
                entities = sorted({entity_of(kind, text[a:b]) for a, kind, b in spans})
                terms = sorted({t for t, _, _ in outside(text, spans)}) if spans else []
                own = [{"start": a, "kind": kind, "end": b} for a, kind, b in spans]
                yield doc_id, version, *(counts[k] for k in range(4)), hashlib.sha256(span_text(spans).encode()).hexdigest(), own, entities, terms

        return run

    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    arrow = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("base", pa.list_(span)), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))])
    schema = "doc_id long, version long, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base_sha256 string, base array<struct<start:int,kind:int,end:int>>, entities array<string>, terms array<string>"
    return map_rows(docs, schema, arrow, ("doc_id", "version", "text"), start)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n_term``: documents that hold each of ``terms``, counted in all of ``docs``."""
    few = terms.limit(BROADCAST_TERMS + 1).toArrow()["term"].to_pylist()
    wanted = docs.sparkSession.sparkContext.broadcast(set(few) if len(few) <= BROADCAST_TERMS else None)

    def start():
        memo = Memo(lambda w: term_of(w.decode(errors="replace")))
        only = wanted.value

        def run(rows):
            counts: Counter[str] = Counter()
            for (text,) in rows:
                here = set(map(memo.__getitem__, set((text or "").encode().split())))
                counts.update(here & only if only is not None else here - {None})
                if len(counts) > 500_000:
                    yield from counts.items()
                    counts.clear()
            yield from counts.items()

        return run

    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])
    counted = map_rows(docs, "word string, n long", arrow, ("text",), start).groupBy("word").agg(F.sum("n").alias("n_term"))
    return counted.join(terms, F.col("word") == F.col("term"), "left_semi").withColumnRenamed("word", "of_term")


def disclosing(found: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    """``of_term, carried``: terms that carry at least ``share`` of some entity's information, and the most they carry."""
    ws = Workspace(docs.sparkSession, "privacy")
    total = found.count()
    named = found.where(F.size("entities") > 0).select(F.monotonically_increasing_id().alias("row"), "entities", "terms")
    named = ws.write(named, "named")
    entities = named.select(F.explode("entities").alias("of_entity")).groupBy("of_entity").agg(F.count("*").alias("n_entity"))
    held = named.select("row", F.explode("entities").alias("entity")).join(entities, F.col("entity") == F.col("of_entity")).drop("of_entity")
    terms = named.select("row", F.explode("terms").alias("term"))
    counted = ws.write(term_counts(docs, terms.select("term").distinct()), "counted")
    terms = terms.join(counted, F.col("term") == F.col("of_term")).drop("of_term")
    most = F.pow(F.lit(float(total)), F.lit(1 - share)) * F.pow("n_entity", F.lit(share)) * (1 + 1e-9)
    both = held.join(terms, "row").where(F.col("n_term") <= most).groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    known = F.log2(total / F.col("n_entity"))
    told = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    both = both.withColumn("carried", F.when(known > 0, told / known).otherwise(F.lit(0.0)))
    return ws.write(both.where(F.col("carried") >= share).groupBy(F.col("term").alias("of_term")).agg(F.max("carried").alias("carried")), "terms")


def marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``of, of_version, added, disclosing``: every occurrence of ``terms`` outside values, by text."""
    codes = terms.select(F.crc32(F.encode("of_term", "utf-8")).alias("code")).distinct().toArrow()["code"].to_numpy()
    bits = np.zeros(MARK_BITS // 8, dtype=np.uint8)
    for at in (codes & (MARK_BITS - 1), codes >> 6):
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    wanted = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def start():
        only = wanted.value

        def held(term: str | None) -> bool:
            if term is None:
                return False
            code = zlib.crc32(term.encode())
            low, high = code & (MARK_BITS - 1), code >> 6
            return bool(only[low >> 3] >> (low & 7) & only[high >> 3] >> (high & 7) & 1)

        def maybe(word: bytes) -> bool:
            return held(term_of(word.decode(errors="replace")))

        memo = Memo(maybe)

        def run(rows):
            for doc_id, version, text in rows:
                if text and any(map(memo.__getitem__, set(text.encode().split()))):
                    for term, a, b in outside(text, base_spans(text)):
                        if held(term):
                            yield doc_id, version, term, a, b

        return run

    arrow = pa.schema([("of", pa.int64()), ("of_version", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    words = map_rows(docs, "of long, of_version long, term string, start int, end int", arrow, ("doc_id", "version", "text"), start)
    words = words.join(terms, F.col("term") == F.col("of_term"))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")
    return words.groupBy("of", "of_version").agg(F.collect_set(span).alias("added"), F.collect_set(F.struct("start", "end", "carried")).alias("disclosing"))


def find(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """Counts, digest of the base spans, all spans as text, and the disclosing spans as an array."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    ws = Workspace(docs.sparkSession, "privacy")
    found = ws.write(found_spans(docs), "found")
    added = marked(docs, disclosing(found, docs, share))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return joined.select(
        "doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", text.alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_term"),
        F.array_sort(F.coalesce("disclosing", F.array().cast("array<struct<start:int,end:int,carried:double>>"))).alias("disclosing"), every.alias("all_spans"), "version",
    )


def sanitised(text: str | None, spans, disclosing) -> str | None:
    """The text with values named by kind, certain terms removed and others reduced to their shape.

    ``spans`` are (start, kind, end); ``disclosing`` are (start, end, carried).
    """
    if text is None:
        return None
    carried = {(a, b): c for a, b, c in disclosing}
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start < at:
            continue
        out.append(text[at:start])
        if KINDS[kind] != "term":
            out.append(f"[{KINDS[kind]}]")
        elif carried.get((start, end), 0.0) < 1 - 1e-9:
            out.append("[number]" if text[start:end].isdigit() else "[word]")
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` with personal data replaced; rows with the same id and text are treated alike."""
    spans = find(docs, **options).select(F.col("doc_id").alias("of"), "version", "all_spans", "disclosing").where(F.size("all_spans") > 0)
    spans = spans.dropDuplicates(["of", "version"])
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("version")), "left")
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def start():
        def run(rows):
            for doc_id, text, spans, terms in rows:
                if spans is None:
                    yield doc_id, text
                else:
                    yield doc_id, sanitised(text, [(s["start"], s["kind"], s["end"]) for s in spans], [(d["start"], d["end"], d["carried"]) for d in terms])

        return run

    return map_rows(joined, "doc_id long, text string", arrow, ("doc_id", "text", "all_spans", "disclosing"), start)
