"""Connected components as a loop of DataFrame joins (large-star and small-star rounds).

Each round hangs every node's larger neighbours, then its smaller ones, under the smallest node
seen; the edges end as stars whose centres are the components' smallest nodes, and rounds end
as soon as they are.  Earlier components' stars can stand for the edges behind them.  Edges are
written to the shared folder after each step, so nothing is collected and no lineage grows;
minima are pre-aggregated, and tables are joined from storage so that Spark can split hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace


#: Edges of one task, at least: small tables are not spread over all shuffle partitions.
EDGES_A_TASK = 50_000


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a centre or hangs under one: then the centres are the components' smallest nodes."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") + F.col("down") > 1).cast("int"))).first()[0]


def stars(labels: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join what ``components`` has joined."""
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node."""
    parts = edges.count() // EDGES_A_TASK + 1

    def write(df: DataFrame, table: str) -> DataFrame:
        return ws.write(df.coalesce(parts), table)

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = write(pairs, f"{name}-0")
    step = 0
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), f"{name}-{step}-large")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = write(large.where("a <> b").distinct(), f"{name}-{step}-l")
        lowest = write(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-{step}-small")
        moved = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = write(moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct(), f"{name}-{step + 1}")
        for old in ("large", "l", "small"):
            ws.drop(f"{name}-{step}-{old}")
        ws.drop(f"{name}-{step}")
        pairs, step = small, step + 1
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
