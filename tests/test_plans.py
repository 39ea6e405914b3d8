"""The physical plans that the operators are written for."""

from pyspark.sql import functions as F

from siltstone.operators import chunking, html, sections, vector
from siltstone.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_and_chunks_shuffle_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bodies = sections.extract_sections(docs, catalog.WORD_SECTIONS, ("doc_id", "source"))
    chunks = chunking.chunks(bodies, ("doc_id", "source", "section"))
    assert "Exchange" not in plan(chunks) and "Python" not in plan(chunks)
    assert "lang" not in plan(chunks).split("ReadSchema")[-1]


def test_each_section_pattern_is_searched_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = sections.extract_sections(docs, catalog.WORD_SECTIONS)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_instr(") == sum(len(s.patterns) for s in catalog.WORD_SECTIONS)


def test_html_stays_in_the_jvm(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = plan(pages.select("page_id", html.document_text(F.col("html"))))
    assert "Python" not in text and "Exchange" not in text and "url" not in text.split("ReadSchema")[-1]


def test_one_vector_query_is_a_sorted_limit(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = plan(vector.nearest(vectors, [1.0] * 64))
    assert "TakeOrderedAndProject" in text and "label" not in text.split("ReadSchema")[-1]


def test_cells_are_pruned(spark, sf_dir, tmp_path):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector.CellIndex.build(vectors, str(tmp_path / "cells"))
    text = plan(index.nearest([1.0] * 64, probes=2))
    assert "PartitionFilters: [cell" in text.replace("isnotnull(cell#", "cell#") or "PartitionFilters: [" in text and "cell" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_ranking_prunes_before_it_shuffles(spark, sf_dir):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["bm25_batch_topk"](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 7")
    assert "EqualTo(vec_id,7)" in plan(vector.nearest(vectors, [1.0] * 64))
