"""Sentences against literal replacements done one after the other, as the abbreviations are defined."""

import random
import re

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking
from tests.test_plans import plan


def plain(text):
    for a in chunking.ABBREVIATIONS:
        text = text.replace(a, a.replace(".", chunking.DOT))
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\n+", text)
    return [p for p in (x.replace(chunking.DOT, ".").strip() for x in parts) if p]


def test_sentences_of_awkward_texts(spark):
    r = random.Random(7)
    pieces = [*chunking.ABBREVIATIONS, "i.", "e.", "g.", "U.", "S.", "A", "word", ".", "!", "?", " ", " ", "  ", "\n", "\n\n", " ", "\x1c", "é", "Z", "__DOT__", "\U0001f600"]
    texts = ["i.e.g. The end. Next", "xNo. Yes", "e.g. The", "U.S. U.K. Z", "", " "] + ["".join(r.choices(pieces, k=r.randint(1, 25))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.sentences(F.col("t")).alias("s")).collect()
    assert {x.i: x.s for x in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_strip_of_awkward_texts(spark):
    r = random.Random(8)
    pieces = ["a", "!", "~", "é", " ", " ", " ", "\n", "\x1c", "\x7f", "\U0001f600"]
    texts = ["", *("".join(r.choices(pieces, k=r.randint(1, 6))) for _ in range(2000))]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", T.strip(F.col("t")).alias("s")).collect()
    assert {x.i: x.s for x in rows} == {-1: None} | {i: t.strip() for i, t in enumerate(texts)}


def test_texts_are_not_copied_for_each_abbreviation(spark):
    docs = spark.createDataFrame([("a",)], "t string")
    assert "replace(replace(" not in plan(docs.select(chunking.sentences(F.col("t"))))
