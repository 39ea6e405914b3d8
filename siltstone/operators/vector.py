"""Cosine search over embedding columns: exact in batches, and by cells of a k-means index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.best import CELLS, Best
from siltstone.operators.lexical import top_k
from siltstone.sources.workspace import reachable

#: Query vectors told to all tasks, at most; more are searched in further passes.
QUERY_BLOCK = 4096
MIN_LISTS, ROWS_A_LIST = 16, 1000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], k: int = 20, id_column: str = "vec_id") -> DataFrame:
    """Exact top k of one query by expressions: a sorted limit, no shuffle of vectors."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(F.col(id_column).alias("doc_id"), cosine_distance(F.col("embedding"), literal).alias("score"))
    return scored.orderBy(F.round("score", 9), "doc_id").limit(k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id") -> DataFrame:
    """``query_id, doc_id, score, rank``: exact top k of each row of ``queries(query_id, embedding)``.

    Queries are told to all tasks in blocks of a fixed size; each task keeps its own k best for a query, so only
    those are shuffled.
    """
    found = None
    for block in query_blocks(queries):
        part = _search_block(vectors, block, k, id_column)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(found, k, ascending=True, id_descending=False)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the query set, a block at a time."""
    ids, rows = [], []
    for row in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        v = np.array(row.embedding, dtype=np.float64)
        ids.append(row.query_id)
        rows.append(v / np.linalg.norm(v))
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows)


def distances(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine distances ``[vector, query]`` to unit vectors."""
    return np.round(1 - (vectors @ queries.T) / np.linalg.norm(vectors, axis=1)[:, None], 12)


def as_matrix(embeddings: pa.Array) -> np.ndarray:
    return embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embeddings), -1)


def found_rows(best: Best, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    if out := best.found():
        yield pa.RecordBatch.from_arrays([pa.array(ids[out[0]]), out[1], pa.array(out[2])], names=["query_id", "doc_id", "score"])


def _search_block(vectors: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int, id_column: str) -> DataFrame:
    reachable(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        ids, queries = shared.value
        best, step = Best(len(ids), k, high=False, last=False), max(1, CELLS // len(ids))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                best.add(distances(as_matrix(part.column(1)), queries), part.column(0))
        yield from found_rows(best, ids)

    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == block[1].shape[1])).select(F.col(id_column).cast("long"), "embedding")
    return usable.mapInArrow(run, "query_id long, doc_id long, score double")


def list_count(rows: int) -> int:
    """Cells of an index over so many rows."""
    return max(MIN_LISTS, rows // ROWS_A_LIST)


class CellIndex:
    """Vectors stored by the k-means cell of their direction; queries read the nearest cells only."""

    def __init__(self, cells: DataFrame, centroids: np.ndarray):
        self.cells, self.centroids = cells, centroids

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, seed: int = 1, id_column: str = "vec_id") -> CellIndex:
        """Cluster, write partitioned by ``cell``, and keep the centroids (``lists`` rows) on the driver."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        usable = vectors.where("embedding is not null").select(F.col(id_column).alias("vec_id"), "embedding")
        lists = lists or list_count(usable.count())
        points = usable.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
        model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10, predictionCol="cell").fit(points)
        # Dealt by cell, so that a cell is a few files and not one of every task; a large cell is split.
        model.transform(points).select("vec_id", "embedding", "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        centres = np.array(model.clusterCenters())
        return cls(vectors.sparkSession.read.parquet(path), centres / np.linalg.norm(centres, axis=1, keepdims=True))

    def probed(self, query: np.ndarray, probes: int) -> list[int]:
        """The cells nearest to a query."""
        return np.argsort(1 - self.centroids @ (query / np.linalg.norm(query)), kind="stable")[:probes].tolist()

    def nearest(self, query: list[float], k: int = 20, probes: int = 4) -> DataFrame:
        """Top k within the probed cells; other cells' files are not read."""
        return nearest(self.cells.where(F.col("cell").isin(self.probed(np.array(query), probes))), query, k)

    def search(self, queries: DataFrame, k: int = 20, probes: int = 4) -> DataFrame:
        """The same for many queries: each meets the vectors of its cells only, and tasks keep their k best of each."""
        found = None
        for ids, vectors in query_blocks(queries):
            cells = np.argsort(1 - vectors @ self.centroids.T, axis=1, kind="stable")[:, :probes]
            part = self._search_block((ids, vectors, cells), k)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.cells.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        return top_k(found, k, ascending=True, id_descending=False)

    def _search_block(self, block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
        reachable(self.cells.sparkSession)
        shared = self.cells.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            ids, queries, cells = shared.value
            best, asking = Best(len(ids), k, high=False, last=False), {}
            for batch in batches:
                own = batch.column(0).to_numpy()
                for cell in np.unique(own):
                    if cell not in asking:
                        asking[cell] = np.nonzero((cells == cell).any(axis=1))[0]
                    columns, rows = asking[cell], np.nonzero(own == cell)[0]
                    step = max(1, CELLS // max(1, len(columns)))
                    for low in range(0, len(rows) if len(columns) else 0, step):
                        part = batch.take(pa.array(rows[low : low + step]))
                        best.add(distances(as_matrix(part.column(2)), queries[columns]), part.column(1), columns)
            yield from found_rows(best, ids)

        usable = self.cells.where(F.size("embedding") == block[1].shape[1]).select(F.col("cell").cast("int"), F.col("vec_id").cast("long"), "embedding")
        return usable.mapInArrow(run, "query_id long, doc_id long, score double")


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 64) -> DataFrame:
    """Add ``embedding``: unit vectors from any function of a list of texts, ``batch`` at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = []
            for low in range(0, len(part), batch):
                v = np.asarray(embedder(part.iloc[low : low + batch].fillna("").tolist()), dtype=np.float32)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                rows += list(np.divide(v, length, out=np.zeros_like(v), where=length > 0))
            yield pd.Series(rows, index=part.index)

    return texts.withColumn("embedding", run(F.col(text)))


def hashed_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """An offline stand-in for a sentence model: signed hashed word counts."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        return out

    return run


def ranked(scored: DataFrame, ascending: bool) -> DataFrame:
    """Ranks within each query for scores from elsewhere."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, "doc_id")))
