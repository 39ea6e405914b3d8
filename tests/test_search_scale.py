"""Searches whose tasks keep their best rows only, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import best, evaluation, lexical, prompting, vector
from tests.test_plans import plan


@pytest.mark.parametrize("high", [True, False])
def test_best_of_batches_is_the_best_of_all(high):
    r = np.random.default_rng(3)
    scores, ids = np.round(r.normal(size=(300, 6)), 1), [None, *(f"é{i:03}" for i in r.permutation(299))]
    scores[5, 2] = np.nan
    own = best.Best(6, 7, high=high, last=high)
    for low in range(0, 300, 40):
        own.add(scores[low : low + 40, :3], pa.array(ids[low : low + 40], pa.string()), np.array([0, 1, 2]))
        own.add(scores[low : low + 40, 3:], pa.array(ids[low : low + 40], pa.string()), np.array([3, 4, 5]))
    query, found, _ = own.found()
    sign = -1 if high else 1
    for q in range(6):
        rank = {i: n for n, i in enumerate(sorted(ids, key=lambda i: i or "", reverse=high))}
        want = sorted(range(300), key=lambda d: (np.isnan(scores[d, q]), sign * np.nan_to_num(scores[d, q]), rank[ids[d]]))[:7]
        assert sorted(map(str, found.filter(pa.array(query == q)).to_pylist())) == sorted(str(ids[d]) for d in want)


def test_bm25_in_blocks_and_by_string_ids(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"d{i:02}", " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(60)] + [("null", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", " ".join(r.choices(words, k=i))) for i in range(6)] + [("none", None)], "query_id string, query string")
    whole = {(x.query_id, x.rank): (x.doc_id, round(x.score, 9)) for x in lexical.search(docs, asked, 8).collect()}
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    monkeypatch.setattr(lexical, "CELLS", 40)
    monkeypatch.setattr(lexical.Asked, "COMMON", 1)
    found = lexical.search(docs, asked, 8)
    assert "MapInArrow" in plan(found) and "Join" not in plan(found)
    assert {(x.query_id, x.rank): (x.doc_id, round(x.score, 9)) for x in found.collect()} == whole and len(whole) == 7 * 8
    assert [whole["none", k][0] for k in (1, 2, 3)] == ["null", "d59", "d58"]


def test_probed_cells_are_searched_without_a_join(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(5)
    m = r.normal(size=(400, 6))
    m[200:] = m[:200]  # ties
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    index = vector.CellIndex.build(vectors, str(tmp_path / "cells"), lists=8)
    asked = vectors.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(vector, "CELLS", 30)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    found = index.search(asked, 5, probes=3)
    assert "MapInArrow" in plan(found) and "Join" not in plan(found)
    cells = {x.vec_id: (x.cell, x.embedding) for x in index.cells.collect()}
    for q in range(9):
        own = set(index.probed(np.array(cells[q][1]), 3))
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        far = sorted((round(1 - float(unit(v) @ unit(cells[q][1])), 9), i) for i, (c, v) in cells.items() if c in own)[:5]
        assert [x.doc_id for x in found.where(f"query_id = {q}").orderBy("rank").collect()] == [i for _, i in far]


def test_passages_are_found_by_their_words(spark):
    texts = ["a bb ccc dd e f", "xa bb ccc dd ex", "a bb\nccc dd e", "bb bb bb bb bb bb", "", None, "e f g hh i j", "zz a bb ccc dd ef"]
    docs = spark.createDataFrame([(i, f"c{i}", "s", t) for i, t in enumerate(texts)], "doc_id long, company string, section string, text string")
    asked = ["a bb ccc dd e", "bb bb bb bb bb", "bb\nccc", "", None, "f g hh i j", " bb ccc dd ", "no such words are there", "e"]
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(x.query_id, x.doc_id) for x in evaluation.held_passages(passages, docs).collect()}
    assert got == {(q, d) for q, p in enumerate(asked) for d, t in enumerate(texts) if p is not None and t is not None and p in t}
    long = evaluation.held_passages(passages.where("query_id in (0, 1, 5, 7)"), docs)
    assert "NestedLoop" not in plan(long) and long.distinct().count() == 5
    assert {x.query_id: x.target_company for x in evaluation.gold_from_passages(passages, docs).collect()} == {0: "c0", 1: "c3", 2: "c2", 3: "c0", 4: None, 5: "c6", 6: "c0", 7: None, 8: "c0"}


def test_contexts_do_not_shuffle_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source company", "lang section", "text")
    asked = spark.createDataFrame([(1, "the of")], "query_id long, query string")
    text = plan(prompting.contexts(lexical.search(docs, asked, 3), docs))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_white_space_is_that_of_python(spark):
    every = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").where(F.col("c").rlike(T.SPACE)).collect()
    assert {x.c for x in rows} == {c for c in every if re.fullmatch(r"\s", c)}
