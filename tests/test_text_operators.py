"""Text, HTML, sections and chunks against plain Python, one trap each."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, html, sections

FILLER = "Plain words of a long filing body that say nothing. " * 12


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_white_space_is_unicodes(spark):
    odd = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, f"{odd}a{odd}b{odd}", T.strip) == f"{odd}a{odd}b{odd}".strip()
    assert one(spark, f"A{odd}b  C.", T.tokens) == f"A{odd}b  C.".lower().split()


def test_slug_and_padding(spark):
    assert one(spark, "Block (Square)", T.slug) == "block_square"
    assert [one(spark, v, T.zero_padded) for v in ("123", "0000000001", "12345678901")] == ["123".zfill(10), "1".zfill(10), "12345678901"]
    assert one(spark, "a\nb" * 200, T.preview) == ("a\nb" * 200)[:300].replace("\n", " ")


def test_match_positions_are_code_points(spark):
    assert one(spark, "\U0001f600\U0001f600 item\xa01a", lambda c: T.match_start(c, r"item\s*1a")) == 3
    assert one(spark, "x item 1a", lambda c: T.match_start(c, r"item\s*1a")) == 2
    assert one(spark, "nothing", lambda c: T.match_start(c, "item")) is None


PAGE = "<html><!-- c --><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) x='</p>'</script></head><body><table><tr><td>gone<table><tr><td>in</td></tr></table></td></tr></table><p>One<br>two<div class='a'>three  \t four</div>&nbsp;</body></html>"


def test_html_to_text(spark):
    got = one(spark, PAGE, html.html_to_text)
    assert got == "T & t \n One\n two\n three four".replace("t \n", "t\n")
    assert one(spark, PAGE, html.html_to_text_parsed) == got
    assert one(spark, "plain  text\n\n\n\nkept", html.document_text) == "plain  text\n\n\n\nkept"
    assert one(spark, None, html.html_to_text) is None


def test_links_prefer_pages_over_texts(spark):
    assert one(spark, '<a HREF="a.HTM"><a href="b.txt"><a href="c.html">', html.links) == ["a.HTM", "c.html"]
    assert one(spark, '<a href="b.txt">', html.links) == ["b.txt"]


def plain_sections(text, spec):
    low, skip, starts = text.lower(), len(text) // 20, {}
    for s in spec:
        found = [m.start() for p in s.patterns for m in re.finditer(p, low, re.DOTALL) if m.start() >= skip]
        if found:
            starts[s.name] = min(found)
    kept, top = [], -1
    for s in spec:
        if s.name in starts:
            if starts[s.name] > top:
                kept.append((s, starts[s.name]))
            top = max(top, starts[s.name])
    out = []
    for i, (s, at) in enumerate(kept):
        end = kept[i + 1][1] if i + 1 < len(kept) else len(text)
        body = text[at : at + min(end - at, s.limit)].strip()
        if len(body) > 200:
            out.append((s.name, body))
    return out


HEADERS = {
    "business": ["Item 1. Business", "ITEM 1 — \nBusiness", "Item\xa01.  Business"],
    "risk_factors": ["Item 1A. Risk Factors", "ITEM\xa01 A. RISK\xa0FACTORS", "Risk Factors"],
    "mda": ["Item 7. Management's Discussion", "Management’s Discussion and Analysis"],
    "market_risk": ["Item 7A. Quantitative", "Item 7 A. quantitative"],
    "financial_statements": ["Item 8. Financial Statements", "Financial Statements and Supplementary Data"],
}


def test_sections_by_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        names = [n for n in HEADERS if r.random() < 0.8]
        if r.random() < 0.3:
            r.shuffle(names)
        parts = ["Contents: " + ", ".join(r.choice(HEADERS[n]) for n in names) + "\n" if r.random() < 0.5 else r.choice(["\U0001f600 ", ""])]
        for n in names:
            parts.append(f"\n{r.choice(HEADERS[n])}\n" + FILLER[: r.choice([50, 300, 620])] + r.choice(["", "\xa0\n"]))
        rows.append((i, FILLER * r.randrange(2) + "".join(parts)))
    small = [sections.Section(s.name, s.patterns, 400) for s in sections.ANNUAL_REPORT]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for spec in (sections.ANNUAL_REPORT, small):
        got = sorted(sections.extract_sections(docs, spec).collect(), key=lambda x: (x.doc_id, x.section_no))
        want = [(i, n, b) for i, t in rows for n, b in plain_sections(t, spec)]
        assert [(x.doc_id, x.section, x.body) for x in got] == want
    summary = {x.doc_id: (x.sections_found, x.total_chars) for x in sections.filing_summary(sections.extract_sections(docs, small)).collect()}
    assert summary == {i: ([n for n, _ in p], sum(len(b) for _, b in p)) for i, t in rows if (p := plain_sections(t, small))}


def test_sections_can_end_at_any_item(spark):
    text = FILLER + "\nItem 1A. Risk Factors\n" + FILLER + "\nItem 1B. Unresolved\n" + FILLER
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    body = sections.extract_sections(docs, sections.ANNUAL_REPORT, end_at_any_item=True).first().body
    assert body.endswith("nothing.") and "1B" not in body
    assert "1B" in sections.extract_sections(docs, sections.ANNUAL_REPORT).first().body


def test_page_headers(spark):
    assert one(spark, "a\nTable of Contents\n12\nb\n", sections.without_page_headers) == "a\nb\n"


def plain_sentences(text):
    for a in chunking.ABBREVIATIONS:
        text = text.replace(a, a.replace(".", "__DOT__"))
    return [x for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\n+", text) if (x := s.replace("__DOT__", ".").strip())]


def plain_pack(ss, size, overlap, least):
    out, cur, used = [], [], 0

    def flush():
        t = " ".join(cur).strip()
        if len(t) >= least:
            out.append(t)

    for s in ss:
        if len(s) > size:
            if cur:
                flush()
            cur, used = [], 0
            out.extend(x for i in range(0, len(s), size - overlap) if len(x := s[i : i + size].strip()) >= least)
            continue
        if used + len(s) + 1 > size and cur:
            flush()
            kept, room = [], 0
            for x in reversed(cur):
                if room + len(x) + 1 > overlap:
                    break
                kept.insert(0, x)
                room += len(x) + 1
            cur, used = kept, overlap
        cur.append(s)
        used += len(s) + 1
    flush()
    return out


def test_sentences_and_chunks_by_brute_force(spark):
    r = random.Random(5)
    pieces = ["Apple Inc. grew. ", "The interest. Then it fell! ", "Why? Because", "\n\n", "\n", " in the U.S. And", "\xa0", "word " * 30, "x" * 900 + ". ", "Y" * 1310 + ". ", "No. 5 is. Next "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(150)] + [("A" + "b" * 598 + ". ") + ("C" + "d" * 118 + ". ") + ("E" + "f" * 788 + ".")]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for sizes in ({}, {"size": 120, "overlap": 40, "least": 10}):
        got = {x.i: (x.s, x.c) for x in docs.select("i", chunking.sentences(F.col("t")).alias("s")).select("i", "s", chunking.pack(F.col("s"), **sizes).alias("c")).collect()}
        size, overlap, least = sizes.get("size", 800), sizes.get("overlap", 150), sizes.get("least", 100)
        for i, t in enumerate(texts):
            assert got[i] == (plain_sentences(t), plain_pack(plain_sentences(t), size, overlap, least))
            assert all(len(c) <= size + overlap for c in got[i][1])
    assert len(got) == len(texts)


def test_overlap_must_leave_a_step(spark):
    with pytest.raises(ValueError):
        chunking.pack(F.array(F.lit("a")), size=100, overlap=100)


def test_chunk_rows_and_stats(spark):
    rows = [("A", "x", FILLER), ("A", "y", FILLER * 2), ("B", "x", "short")]
    df = spark.createDataFrame(rows, "company string, section string, body string")
    got = chunking.chunks(df, ("company", "section")).collect()
    again = chunking.chunks(df, ("company", "section")).collect()
    assert {x.chunk_id for x in got} == {x.chunk_id for x in again} and len({x.chunk_id for x in got}) == len(got)
    assert all(x.char_count == len(x.text) and 0 <= x.chunk_index < x.total_chunks for x in got)
    stats = {(x.company, x.section): x.total_chunks for x in chunking.chunk_stats(chunking.chunks(df, ("company", "section"))).collect()}
    assert stats[None, None] == len(got) == stats["A", None]


def test_strip_is_linear_in_blanks_inside(spark):
    began = time.perf_counter()
    row = spark.createDataFrame([(" \u3000a" + " " * 300_000 + "b\t\x1f ",)], "t string").select(F.length(T.strip(F.col("t"))).alias("n")).first()
    assert row.n == 300_002 and time.perf_counter() - began < 20
