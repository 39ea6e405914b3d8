"""Ranking, fusion, evaluation, sources, stores and streams on small fixtures."""

import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.operators import evaluation, fusion, lexical, prompting, vector
from siltstone.sources import fetch, filings, store
from siltstone.streaming import ingest

TEXTS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "the the the", "birds fly", "", "the cat sat on the mat"]
RANKED = "query_id long, doc_id long, rank int, score double"


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def plain_bm25(query, k):
    split = [t.lower().split() for t in TEXTS]
    n, avg = len(split), sum(map(len, split)) / len(split)
    df = Counter(w for s in split for w in set(s))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = []
    for i, s in enumerate(split):
        tf = Counter(s)
        out.append((round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(s) / avg)) for w in query.lower().split()), 9), i))
    return sorted(out, reverse=True)[:k]


@pytest.mark.parametrize("query", ["cat sat", "the the dog", "unknown words", "BIRDS unknown", ""])
def test_bm25_fills_up_and_breaks_ties_by_id(spark, query):
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    got = sorted(lexical.search(docs(spark), asked, k=5).collect(), key=lambda r: r.rank)
    assert [(r.doc_id, r.rank) for r in got] == [(i, k + 1) for k, (_, i) in enumerate(plain_bm25(query, 5))]
    assert [r.score for r in got] == pytest.approx([s for s, _ in plain_bm25(query, 5)])


def test_vector_searches_agree(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)] + [(300, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(x.query_id, x.rank): x.doc_id for x in vector.search(vectors, asked, k=7).collect()}
    m = np.array([v for _, v in rows[:300]], dtype=float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        assert [got[q, k + 1] for k in range(7)] == np.argsort(1 - unit @ unit[q], kind="stable")[:7].tolist()
    assert [x.doc_id for x in vector.nearest(vectors.where("embedding is not null"), rows[3][1], 7).collect()] == [got[3, k + 1] for k in range(7)]
    assert vector.list_count(10) == 16 and vector.list_count(32_000) == 32


def test_cells_with_all_probes_are_exact(spark, tmp_path):
    r = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(200)], "vec_id long, embedding array<float>")
    index = vector.CellIndex.build(vectors, str(tmp_path / "cells"), lists=8)
    asked = vectors.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda rows: sorted((x.query_id, x.rank, x.doc_id) for x in rows)
    assert key(index.search(asked, 5, probes=8).collect()) == key(vector.search(vectors, asked, 5).collect())
    one = index.nearest(asked.first().embedding, 5, probes=2)
    assert one.count() <= 5 and "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() or "cell" in one._jdf.queryExecution().toString()


def test_embedding_hook(spark):
    out = vector.embed(docs(spark), vector.hashed_embedder(16), batch=2).collect()
    assert all(len(x.embedding) == 16 for x in out)
    assert all(abs(np.linalg.norm(x.embedding) - 1) < 1e-5 for x in out if x.text)


def test_fusion_order_is_that_of_a_stable_sort(spark):
    r = random.Random(4)
    for _ in range(4):
        bm25, near = (r.sample(range(30), 20) for _ in range(2))
        seen = {}
        for names, channel in ((bm25, 0), (near, 1)):
            for k, d in enumerate(names):
                seen[d] = seen.get(d, 0) + 1 / (k + 1 + 60)
        want = sorted(seen, key=lambda d: -seen[d])[:10]
        frames = [spark.createDataFrame([(1, d, k + 1, 0.5) for k, d in enumerate(names)], RANKED) for names in (bm25, near)]
        got = sorted(fusion.reciprocal_rank_fusion(*frames, k=10).collect(), key=lambda x: x.rank)
        assert [x.doc_id for x in got] == want and [x.rrf_score for x in got] == pytest.approx([seen[d] for d in want], abs=1e-6)


def test_weights_and_scores(spark):
    bm25 = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 1.0)], RANKED)
    near = spark.createDataFrame([(1, 11, 1, 0.1), (1, 12, 2, 0.9)], RANKED)
    assert fusion.reciprocal_rank_fusion(bm25, near, 1, (1.0, 0.0)).first().doc_id == 10
    assert {x.doc_id: x.fused_score for x in fusion.score_fusion(bm25, near, 3).collect()} == {10: 0.5, 11: 0.5, 12: 0.0}


def test_evaluation(spark):
    chunks = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", "x")], "doc_id long, company string, section string")
    gold = spark.createDataFrame([(1, "A", "y", "normal"), (2, None, None, "retrieval-impossible"), (3, "B", "x", "normal")], "query_id long, target_company string, target_section string, tag string")
    lists = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 0.5), (2, 1, 1, 1.0), (3, 1, 1, 1.0)], RANKED)
    out = evaluation.evaluate(lists, lists.where("rank = 1"), gold, chunks, k=1)
    rows = {x.query_id: x for x in out.collect()}
    assert (rows[1].rank_bm25, rows[1].hit_bm25, rows[1].rank_vector) == (2, 0, None) and rows[3].rank_fused is None
    assert evaluation.summary(out).first().normal_bm25 == 0.0
    assert evaluation.summary(out.limit(0)).first().all_fused == 0.0
    stored = json.loads(evaluation.summary_json(out, k=1).first().value)
    assert stored["run_meta"]["k"] == 1 and len(stored["per_question"]) == 3 and stored["all"]["bm25"] == 0.0
    assert {x.tag: x.n for x in evaluation.by_tag(out).collect()} == {None: 3, "normal": 2, "retrieval-impossible": 1}
    rates = {x.doc_id: (x.wrong, x.others) for x in evaluation.false_positive_rate(lists, gold, chunks).collect()}
    assert rates == {1: (3, 3), 2: (0, 2)}


def test_prompts(spark):
    chunks = spark.createDataFrame([(1, "A", "x", "t1", 0), (2, "B", "", "t2", 4)], "doc_id long, company string, section string, text string, chunk_index int")
    found = spark.createDataFrame([(9, 2, 1, 0.1), (9, 1, 2, 0.2)], "query_id long, doc_id long, rank int, rrf_score double")
    assert prompting.contexts(found, chunks).first().context == "[1] B\nt2\n\n[2] A — x\nt1"
    assert [s.chunk_id for s in prompting.sources(found, chunks).first().sources] == ["2", "1"]
    p = prompting.contexts(found, chunks).select(prompting.prompt(F.col("context"), F.lit("why?")).alias("prompt"))
    assert p.first().prompt.startswith(prompting.INSTRUCTION) and p.first().prompt.endswith("Question: why?\n\nAnswer:")
    assert prompting.generate(p, prompting.extractive_stand_in).first().answer is not None
    q = spark.createDataFrame([("",), (None,), ("x" * 2000,), ("x" * 2001,)], "q string").select(prompting.valid_question(F.col("q")).alias("v"))
    assert [x.v for x in q.collect()] == [False, False, True, False]


def test_filings(spark):
    rows = spark.createDataFrame([(200, "x" * 10_001), (200, "x" * 10_000), (404, "x" * 20_000), (200, None)], "s int, t string")
    assert [x.u for x in rows.select(filings.usable_document(F.col("s"), F.col("t")).alias("u")).collect()] == [True, False, False, False]
    assert len(filings.COMPANIES) == 7


def test_fetching_falls_back_to_the_index(tmp_path):
    recent = {"form": ["10-K/A", "10-K"], "accessionNumber": ["0-1", "0-2"], "filingDate": ["2025", "2024"], "primaryDocument": ["a.htm", "b.htm"]}
    folder = f"{fetch.ARCHIVE}/Archives/edgar/data/0000000007/02"
    pages = {
        fetch.SUBMISSIONS.format(cik="0000000007"): json.dumps({"filings": {"recent": recent}}),
        f"{folder}/b.htm": "stub",
        f"{folder}/": '<a HREF="/x/short.htm"><a href="https://other/long.html"><a href="/c.txt">',
        f"{fetch.ARCHIVE}/x/short.htm": "short",
        "https://other/long.html": "L" * 10_001,
    }
    got = fetch.fetch_companies(lambda url: (200, pages[url]), str(tmp_path), {"A (Co)": "7", "None": "8"}, pause=0)
    assert [(m["company"], m["accession_flat"], m["size_bytes"]) for m in got] == [("A (Co)", "02", 10_001)]
    assert (tmp_path / "raw" / "a_co_2024.html").exists() and len(json.loads((tmp_path / "manifest.json").read_text())) == 1


def chunk(i, text, section="x"):
    return {"chunk_id": i, "company": "A", "section": section, "chunk_index": 0, "total_chunks": 1, "text": text, "char_count": len(text)}


def test_upserts_keep_the_oldest_metadata(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    frame = lambda rows: spark.createDataFrame([tuple(r.get(f.name) for f in store.CHUNKS) for r in rows], store.CHUNKS)
    table.upsert(frame([chunk("1", "one"), chunk("2", "two")]))
    late = frame([chunk("2", "newer", "y")]).withColumn("arrival", F.lit(2)).unionByName(frame([chunk("2", "new", "z"), chunk("3", "three")]).withColumn("arrival", F.lit(1)))
    table.upsert(late)
    assert {x.chunk_id: (x.section, x.text) for x in table.read().collect()} == {"1": ("x", "one"), "2": ("x", "newer"), "3": ("x", "three")}


def test_stream_upserts(spark, tmp_path):
    source, table = tmp_path / "in", store.VersionedTable(spark, str(tmp_path / "t"))
    source.mkdir()
    for name, rows in (("a", [chunk("1", "one")]), ("b", [chunk("1", "uno"), chunk("2", "two")])):
        (source / f"{name}.json").write_text("\n\n".join(map(json.dumps, rows)))
        ingest.upsert_stream(spark, str(source), table, str(tmp_path / "c")).awaitTermination()
    assert {x.chunk_id: x.text for x in table.read().collect()} == {"1": "uno", "2": "two"}


def test_windowed_counts(spark, sf_dir, tmp_path):
    os.symlink(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    stream = ingest.counts_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_command_line_builds_a_table(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    body = "The company earns money. " * 40
    (raw / "a_co.html").write_bytes(b"<html><body><p>Start " + body.encode() * 2 + b"\xff</p><p>Item 1. Business</p><p>" + body.encode() * 3 + b"</p></body></html>")
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps([{"company": "A Co", "filing_date": "2024", "local_file": str(raw / "a_co.html")}, {"company": "B", "filing_date": "2024", "local_file": str(raw / "none.html")}]))
    cli.main(["all", "--skip-fetch", "--manifest", str(manifest), "--out", str(tmp_path)])
    rows = store.VersionedTable(spark, f"{tmp_path}/table").read().collect()
    assert rows and {x.company for x in rows} == {"A Co"} and {x.section for x in rows} == {"business"}
    assert all(len(x.embedding) == 384 for x in rows)


def test_gold_file(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"_meta": {}, "questions": [{"id": "Q1", "question": "why?"}, {"id": "Q2", "question": "how?"}]}))
    assert [x.id for x in store.read_gold(spark, str(tmp_path / "gold.json")).collect()] == ["Q1", "Q2"]
