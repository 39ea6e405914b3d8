"""Fusing ranked lists: reciprocal ranks, weights, and normalised scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to a rank before it is inverted.
RRF_K = 60


def _share(rank: Column, weight: float) -> Column:
    return F.coalesce(F.lit(float(weight)) / (rank + RRF_K), F.lit(0.0))


def _cut(fused: DataFrame, score: str, k: int) -> DataFrame:
    """Best first; ties by lexical rank, then vector rank, lists without a rank last."""
    order = W.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def paired(bm25: DataFrame, vector: DataFrame) -> DataFrame:
    """Both lists side by side: ``query_id, doc_id, bm25_rank, bm25_score, vector_rank, vector_score``."""
    left = bm25.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    right = vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    return left.join(right, ["query_id", "doc_id"], "full_outer")


def reciprocal_rank_fusion(bm25: DataFrame, vector: DataFrame, k: int = 5, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Top k by summed reciprocal ranks; ``score`` is the lexical one where there is one.

    The order is that of the unrounded sums; ``rrf_score`` is rounded for output only.
    """
    both = paired(bm25, vector)
    both = both.withColumn("fused", _share(F.col("bm25_rank"), weights[0]) + _share(F.col("vector_rank"), weights[1]))
    out = _cut(both, "fused", k)
    return out.select("query_id", "doc_id", "rank", F.round("fused", 6).alias("rrf_score"), F.coalesce("bm25_score", "vector_score").alias("score"), "bm25_rank", "vector_rank")


def fuse_lists(lists: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of any number of channels in one table ``query_id, channel, doc_id, rank``.

    ``weight`` is read if there is such a column.
    """
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    summed = lists.groupBy("query_id", "doc_id").agg(F.sum(weight / (F.col("rank") + RRF_K)).alias("fused"), F.min("rank").alias("best"))
    order = W.partitionBy("query_id").orderBy(F.col("fused").desc(), "best", "doc_id")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", F.round("fused", 6).alias("rrf_score"))


def score_fusion(bm25: DataFrame, vector: DataFrame, k: int = 5, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Top k by min-max normalised scores of each query (distances count as closeness)."""
    both = paired(bm25, vector)
    every = W.partitionBy("query_id")

    def scaled(c: str, high_is_good: bool) -> Column:
        low, high = F.min(c).over(every), F.max(c).over(every)
        share = (F.col(c) - low) / (high - low) if high_is_good else (high - F.col(c)) / (high - low)
        return F.coalesce(F.when(high > low, share).otherwise(F.when(F.col(c).isNotNull(), F.lit(1.0))), F.lit(0.0))

    both = both.withColumn("fused", F.round(weights[0] * scaled("bm25_score", True) + weights[1] * scaled("vector_score", False), 9))
    return _cut(both, "fused", k).select("query_id", "doc_id", "rank", F.round("fused", 6).alias("fused_score"), "bm25_rank", "vector_rank")
