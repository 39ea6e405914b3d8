"""Hybrid search for a batch of queries, and what is read about its results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import fusion, lexical, vector

CANDIDATES = 20


@dataclass
class HybridRetriever:
    """``docs(doc_id, text)`` with ``vectors(vec_id, embedding)``, searched by text and by vector."""

    docs: DataFrame
    vectors: DataFrame
    candidate_k: int = CANDIDATES

    def channels(self, queries: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Ranked candidates of both channels for ``queries(query_id, query, embedding)``.

        ``where`` restricts the documents of both before anything is ranked.
        """
        docs, vectors = self.docs, self.vectors
        if where is not None:
            docs = docs.where(where)
            vectors = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        return lexical.search(docs, queries, self.candidate_k), vector.search(vectors, queries, self.candidate_k)

    def search(self, queries: DataFrame, k: int = 5, weights: tuple[float, float] = (1.0, 1.0), where: Column | None = None) -> DataFrame:
        bm25, near = self.channels(queries, where)
        return fusion.reciprocal_rank_fusion(bm25, near, k, weights)


def with_metadata(results: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Read columns of the few ranked documents."""
    return results.join(docs.select("doc_id", *columns), "doc_id", "left")
