"""Context, prompts, answers and what an API shows of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.workspace import Workspace

#: Instruction and layout of the prompt (fixed values).
INSTRUCTION = "You are a financial analyst assistant. Answer the question using ONLY the context from SEC 10-K filings provided below. If the context does not contain the answer, say you cannot find it in the provided filings. Cite the company name when stating a fact. Be concise and factual."
LAYOUT = "%s\n\nContext from SEC 10-K filings:\n%s\n\nQuestion: %s\n\nAnswer:"
#: Shown where a chunk has no company field (fixed value, spelling included).
NO_COMPANY = "Unkown"
MAX_QUESTION = 2000


def context_block(number: Column, company: Column, section: Column, text: Column) -> Column:
    """A numbered header without trailing dashes, and the chunk's text below."""
    header = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(company, F.lit(NO_COMPANY)), F.lit(" — "), F.coalesce(section, F.lit("")))
    return F.concat(F.regexp_replace(header, "[ —]+$", ""), F.lit("\n"), F.coalesce(text, F.lit("")))


def contexts(results: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, context``: the ranked chunks of each query as one text."""
    # Stored, so that Spark sees its size before the texts are shuffled.
    ranked = Workspace(docs.sparkSession, "contexts").write(results.select("query_id", "doc_id", "rank"), "ranked")
    joined = ranked.join(docs.select("doc_id", "company", "section", "text"), "doc_id")
    block = context_block(F.col("rank"), F.col("company"), F.col("section"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])
    return joined.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"))


def prompt(context: Column, question: Column, instruction: str = INSTRUCTION) -> Column:
    return F.format_string(LAYOUT, F.lit(instruction), context, question)


def valid_question(question: Column) -> Column:
    return F.coalesce(F.length(question).between(1, MAX_QUESTION), F.lit(False))


def sources(results: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, sources``: what an answer shows of its chunks, without text and score."""
    joined = results.join(docs.select("doc_id", "company", "section", "chunk_index"), "doc_id")
    item = F.struct("rank", F.col("doc_id").cast("string").alias("chunk_id"), "company", "section", "chunk_index", "rrf_score")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["company"].alias("company"), x["section"].alias("section"), x["chunk_index"].alias("chunk_index"), x["rrf_score"].alias("rrf_score")))
    return joined.groupBy("query_id").agg(ordered.alias("sources"))


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """Add ``answer`` from any function of a list of prompts; a model is loaded where that function loads it."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for low in range(0, len(part), batch):
                out += model(part.iloc[low : low + batch].tolist())
            yield pd.Series(out, index=part.index)

    return prompts.withColumn("answer", run(F.col("prompt")))


def extractive_stand_in(prompts: list[str]) -> list[str]:
    """Offline stand-in for a language model: the first line of the context's first block."""
    return [p.split("\n\n")[1].split("\n")[2][:200] if p.count("\n") > 4 else "" for p in prompts]
