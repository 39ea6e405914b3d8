"""Every retrieval operator as a query over the driver's tables.

``documents`` stand for chunks (company := source, section := lang), ``embeddings`` for their
vectors (vec_id = doc_id), ``benchmark`` passages for questions (their vector is that of the same number), ``pages``
for raw HTML.  ``siltstone.plans.sql`` holds the same results in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, evaluation, fusion, html, lexical, prompting, retrieval, sections, vector
from siltstone.sources import filings, store
from siltstone.sources.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Sections by words that the documents do hold.
WORD_SECTIONS = [
    sections.Section("opening", (r"the\s+of", r"de\s+la", r"und\s+der"), 400),
    sections.Section("middle", (r"and\s+th", r"que\s+", r"ein"), 600),
    sections.Section("closing", (r"\sto\s+[a-z]+\.", r"\.\s+la\s"), 5000),
]
QUESTION = "the of and thand THE ing the unheardofword"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks; the index counts within company and section."""
    docs = table(spark, d, "documents")
    return docs.withColumnRenamed("source", "company").withColumnRenamed("lang", "section")


def indexed(docs: DataFrame) -> DataFrame:
    place = W.partitionBy("company", "section").orderBy("doc_id")
    return docs.select("doc_id", "company", "section", (F.row_number().over(place) - 1).alias("chunk_index"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages with the embedding of the same number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(vectors, "query_id", "left")


def channels(spark: SparkSession, d: str, where=None, candidate_k: int = 20) -> tuple[DataFrame, DataFrame]:
    own = retrieval.HybridRetriever(documents(spark, d), table(spark, d, "embeddings"), candidate_k)
    bm25, near = own.channels(questions(spark, d), where)
    ws = Workspace(spark, "channels")
    return ws.write(bm25, "bm25"), ws.write(near, "vector")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


# Lexical


@query
def tokenize_counts(spark, d):
    words = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


@query
def term_stats(spark, d):
    return rounded(lexical.term_stats(table(spark, d, "documents")), "idf")


@query
def corpus_stats(spark, d):
    return rounded(lexical.corpus_stats(table(spark, d, "documents")), "avg_dl")


@query
def bm25_topk(spark, d):
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUESTION).alias("query"))
    return rounded(lexical.search(table(spark, d, "documents"), asked), "score")


@query
def bm25_batch_topk(spark, d):
    return rounded(lexical.search(table(spark, d, "documents"), questions(spark, d)), "score")


@query
def metadata_lookup(spark, d):
    found = lexical.search(table(spark, d, "documents"), questions(spark, d), 5).select("query_id", "doc_id", "rank")
    return retrieval.with_metadata(found, documents(spark, d), "company", "section")


# Vectors


@query
def l2_normalize(spark, d):
    unit = vector.normalised(F.col("embedding"))
    return rounded(table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), vector.norm(F.col("embedding")).alias("norm"), vector.norm(unit).alias("unit_norm"), unit[0].alias("first")), "norm", "unit_norm", "first")


@query
def vector_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    one = vectors.where("vec_id = 0").select("embedding").first()
    return rounded(vector.nearest(vectors, one[0]), "score")


@query
def vector_batch_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vector.search(vectors, asked), "score")


@query
def ivf_lists(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n")).select("n", F.greatest(F.lit(vector.MIN_LISTS), F.expr(f"n div {vector.ROWS_A_LIST}")).cast("long").alias("lists"))


@query
def ivf_probe_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    index = vector.CellIndex.build(vectors, Workspace(spark, "cells").path("cells"))
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(index.search(asked, probes=4), "score")


@query
def ivf_all_probes_topk(spark, d):
    """With every cell probed the index is exact."""
    vectors = table(spark, d, "embeddings")
    index = vector.CellIndex.build(vectors, Workspace(spark, "cells").path("cells"))
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(index.search(asked, probes=len(index.centroids)), "score")


# Fusion and hybrid search


@query
def rrf_fuse(spark, d):
    bm25, near = channels(spark, d)
    both = bm25.withColumn("channel", F.lit("bm25")).unionByName(near.withColumn("channel", F.lit("vector")))
    return fusion.fuse_lists(both, k=20)


@query
def hybrid_search(spark, d):
    out = fusion.reciprocal_rank_fusion(*channels(spark, d))
    return rounded(retrieval.with_metadata(out, documents(spark, d), "company", "section"), "score")


@query
def weighted_rrf(spark, d):
    return fusion.reciprocal_rank_fusion(*channels(spark, d, candidate_k=30), k=5, weights=(0.3, 0.7)).drop("score")


@query
def normalized_score_fusion(spark, d):
    return fusion.score_fusion(*channels(spark, d))


@query
def filtered_search(spark, d):
    return fusion.reciprocal_rank_fusion(*channels(spark, d, where=F.col("section") == "en")).drop("score")


# Evaluation


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    gold = evaluation.gold_from_passages(questions(spark, d), docs)
    return evaluation.evaluate(*channels(spark, d), gold, docs)


@query
def first_hit_rank(spark, d):
    return _evaluated(spark, d)


@query
def hit_at_k_summary(spark, d):
    return evaluation.summary(_evaluated(spark, d))


@query
def hit_at_k_by_tag(spark, d):
    return evaluation.by_tag(_evaluated(spark, d))


@query
def generic_chunk_fp_rate(spark, d):
    docs = documents(spark, d)
    gold = evaluation.gold_from_passages(questions(spark, d), docs)
    return evaluation.false_positive_rate(fusion.reciprocal_rank_fusion(*channels(spark, d)), gold, docs)


@query
def channel_diagnostic(spark, d):
    docs = documents(spark, d)
    gold = evaluation.gold_from_passages(questions(spark, d), docs)
    bm25, near = channels(spark, d)
    return evaluation.diagnostic({"bm25": bm25, "vector": near, "fused": fusion.reciprocal_rank_fusion(bm25, near, 20)}, gold, docs)


@query
def config_comparison(spark, d):
    """With 5 and with 20 candidates: the shorter lists are the heads of the longer ones."""
    docs, lists = documents(spark, d), channels(spark, d, candidate_k=20)
    gold = evaluation.gold_from_passages(questions(spark, d), docs)
    return evaluation.comparison(*(evaluation.evaluate(*(c.where(F.col("rank") <= k) for c in lists), gold, docs, candidate_k=k) for k in (5, 20)))


# Statements over chunks


@query
def section_counts(spark, d):
    return documents(spark, d).groupBy("company", "section").agg(F.count("*").alias("n")).orderBy("company", "section")


@query
def section_rollup(spark, d):
    return chunking.chunk_stats(documents(spark, d))


@query
def target_samples(spark, d):
    """The first two chunks of each company and section, and how many there are."""
    docs = documents(spark, d)
    place = W.partitionBy("company", "section").orderBy("doc_id")
    rows = docs.select("company", "section", "doc_id", F.left("text", F.lit(220)).alias("sample"), F.row_number().over(place).alias("place"))
    counts = docs.groupBy("company", "section").agg(F.count("*").alias("n"))
    return rows.where("place <= 2").join(counts, ["company", "section"])


@query
def tail_samples(spark, d):
    place = W.partitionBy("company", "section").orderBy(F.col("chunk_index").desc())
    return indexed(documents(spark, d)).withColumn("place", F.row_number().over(place)).where("place <= 3").drop("place")


@query
def ilike_bounds(spark, d):
    docs = documents(spark, d)
    held = docs.where(F.col("text").ilike("%THE OF%")).select("doc_id")
    return indexed(docs).join(held, "doc_id", "left_semi").groupBy("company").agg(F.min("chunk_index").alias("first_index"), (F.max("chunk_index") + 1).alias("total"))


@query
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query
def safe_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.slug(F.concat("c_name", F.lit(" (Ltd)"))).alias("slug"))


# HTML and sections


@query
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query
def html_detect(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("raw"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("text").alias("raw"))
    return pages.unionByName(docs).select("id", "kind", html.is_html(F.col("raw")).alias("is_html"), filings.usable_document(F.lit(200), F.col("raw")).alias("usable"))


@query
def page_links(spark, d):
    """Pages with links added: to a page and a text for even numbers, to a text only for odd ones."""
    page = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a HREF="/p'), "page_id", F.lit('.html">p</a>'))).otherwise(F.lit(""))
    raw = F.concat("html", page, F.lit('<a href="/t'), "page_id", F.lit('.txt">t</a>'))
    return table(spark, d, "pages").select("page_id", F.posexplode(html.links(raw)).alias("place", "link"))


@query
def section_bounds(spark, d):
    return sections.section_bounds(table(spark, d, "documents"), WORD_SECTIONS)


@query
def section_extract(spark, d):
    return sections.extract_sections(table(spark, d, "documents"), WORD_SECTIONS)


@query
def filing_summary(spark, d):
    return sections.filing_summary(sections.extract_sections(table(spark, d, "documents"), WORD_SECTIONS))


@query
def section_bounds_any_item(spark, d):
    """Sections that end at the next numbered header, in texts with headers added."""
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" and "), F.lit("\n item 7a and ")).alias("text"))
    return sections.section_bounds(docs, WORD_SECTIONS, end_at_any_item=True)


@query
def page_headers(spark, d):
    """Texts with running headers and page numbers added, and without them."""
    text = F.concat(F.lit("Table of Contents\n"), F.replace("text", F.lit(". "), F.lit(".\n  12 \n")))
    return table(spark, d, "documents").select("doc_id", sections.without_page_headers(text).alias("text"))


# Sentences and chunks


@query
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("place", "sentence"))


@query
def hard_split_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("place", "piece"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(documents(spark, d), ("company", "section", "doc_id"), text="text")


@query
def chunk_pack(spark, d):
    return _chunks(spark, d)


@query
def chunk_stats(spark, d):
    return chunking.chunk_stats(_chunks(spark, d))


@query
def chunk_stats_by_company(spark, d):
    stats = chunking.stats_by_company(_chunks(spark, d))
    return stats.select("company", "total_chunks", F.to_json("by_section").alias("by_section"))


# Sources and stores

SUBMISSIONS = """VALUES
  ('Alpha Co', '19617', array('8-K', '10-K/A', '10-K', '10-K'), array('0-0', '0-1', '0001-24-7', '0001-23-6'), array('2025-01-01', '2024-06-01', '2024-02-01', '2023-02-01'), array('a.htm', 'b.htm', 'c.htm', 'd.htm')),
  ('Beta', '0001633917', array('10-Q'), array('9-9'), array('2024-03-03'), array('q.htm')),
  ('Gamma (X)', '12345678901', array('10-K'), array('7-7-7'), array('2022-03-03'), array('g.htm'))"""


@query
def latest_filing(spark, d):
    rows = spark.sql(f"SELECT * FROM {SUBMISSIONS} AS s(company, cik, form, accessionNumber, filingDate, primaryDocument)")
    return filings.latest_filings(rows)


@query
def manifest_parse(spark, d):
    """Pages as raw files, listed by a manifest in which some are missing."""
    listed = table(spark, d, "pages").select(F.concat(F.lit("Site "), "page_id").alias("company"), F.lit("2024").alias("filing_date"), (F.col("page_id") + 3).alias("n"))
    raw = table(spark, d, "pages").select(F.concat(F.lit("raw/site_"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("raw"))
    manifest = listed.select(F.concat(F.lit("Site "), "n").alias("company"), "filing_date")
    return filings.parse_manifest(filings.with_local_file(manifest, "raw"), raw)


@query
def upsert_chunks(spark, d):
    """New texts for every third document and further ones beside the old."""
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "company", "section", "text", "doc_id")
    new = docs.where("doc_id % 3 = 0 or doc_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), "text")).withColumn("section", F.lit("moved"))
    return store.upsert(docs.where("doc_id % 5 <> 0"), new, metadata=("company", "section"), replaced=("text",))


@query
def json_round_trip(spark, d):
    """Chunks written as JSON lines by company and together, and read again."""
    folder = Workspace(spark, "json").path("chunks")
    docs = documents(spark, d)
    rows = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "company", F.lit(None).cast("string").alias("filing_date"), "section", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), "text", F.length("text").alias("char_count"))
    store.write_chunks(rows, folder)
    together, split = store.read_jsonl(spark, f"{folder}/all"), store.read_jsonl(spark, f"{folder}/by_company")
    counts = split.groupBy("company").agg(F.count("*").alias("in_own_file"))
    return together.groupBy("company").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("characters")).join(counts, "company")


# Prompts and answers


@query
def context_format(spark, d):
    docs = documents(spark, d)
    found = lexical.search(docs, questions(spark, d), 3)
    return prompting.contexts(found, docs)


@query
def prompt_assembly(spark, d):
    docs, asked = documents(spark, d), questions(spark, d)
    joined = prompting.contexts(lexical.search(docs, asked, 2), docs).join(asked, "query_id")
    text = prompting.prompt(F.col("context"), F.col("query"))
    return joined.select("query_id", F.sha2(text, 256).alias("prompt_sha256"), F.length(text).alias("prompt_chars"))


@query
def valid_questions(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", prompting.valid_question(F.col("text")).alias("valid"))


@query
def ask_projection(spark, d):
    docs = documents(spark, d)
    found = prompting.sources(fusion.reciprocal_rank_fusion(*channels(spark, d)), indexed(docs))
    return found.select("query_id", F.posexplode("sources").alias("place", "s")).select("query_id", "place", "s.*")
