"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

*Word vectors.*  Words are hashed to a fixed number of buckets.  Each bucket has a sparse random index vector of
a few +1 and -1; a bucket's context vector is the sum of the index vectors around its
occurrences in all documents.  Tasks add integers and send a row a bucket; the sums are of a
fixed size whatever the corpus and are exact, so reruns agree.

*Documents.*  The unit context vectors of a text's words are pooled: mean, deviation, and mean product of
neighbours (large where words repeat), with the logarithm of the length.

*Network.*  Two numpy layers, fitted on at most ``sample`` labelled rows (those with the smallest hashes
of their ids; a fifth is held back to fit the temperature that scales the logits).

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1, and labels, language, source and
id are no inputs of a score.

Defined results: null and empty texts have zero features and get the network's answer to them; without
labels of both kinds every score is the share of label 1 (0.5 without any); several labels of a
document count as the lowest; rows without an id are scored and never learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Memo, map_rows, reachable, release

BUCKETS = 1 << 14
DIM = 32
NONZERO = 2
NEAR = 2
FEATURES = 3 * DIM + 1
_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]")


def words_of(text: str | None) -> list[bytes]:
    """Words and single punctuation marks, case kept."""
    return _PUNCTUATION.sub(rb" \g<0> ", (text or "").encode()).split()


def bucket_memo() -> Memo:
    return Memo(lambda w: zlib.crc32(w) % BUCKETS, 100_000)


def bucket_ids(text: str | None, memo: Memo) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's nonzero entries; the last row stands for no word."""
    rng = np.random.default_rng(20)
    at = np.argsort(rng.random((BUCKETS + 1, DIM)), axis=1)[:, :NONZERO]
    sign = rng.choice([-1.0, 1.0], size=(BUCKETS + 1, NONZERO))
    sign[BUCKETS] = 0
    return at, sign


def add_contexts(total: np.ndarray, ids: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Add the index vectors of the neighbours of each word to its row."""
    for step in range(1, NEAR + 1):
        for here, there in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
            for k in range(NONZERO):
                cells = here * DIM + at[there, k]
                total += np.bincount(cells, weights=sign[there, k], minlength=len(total)).astype(np.int64)


def context_sums(docs: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """``bucket, v0, v1, ...``: context vectors of the whole corpus, one row a bucket that occurs."""
    names = [f"v{i}" for i in range(DIM)]
    arrow = pa.schema([("bucket", pa.int32()), *((n, pa.int64()) for n in names)])

    def start():
        memo, (at, sign) = bucket_memo(), index_vectors()
        gap = np.full(NEAR, BUCKETS, dtype=np.int64)

        def run(rows):
            total, held, size = np.zeros((BUCKETS + 1) * DIM, dtype=np.int64), [], 0
            for (text,) in rows:
                ids = bucket_ids(text, memo)
                held += [ids, gap]
                size += len(ids)
                if size >= chunk:
                    add_contexts(total, np.concatenate(held), at, sign)
                    held, size = [], 0
            if held:
                add_contexts(total, np.concatenate(held), at, sign)
            total = total.reshape(-1, DIM)[:BUCKETS]
            for b in np.flatnonzero(total.any(axis=1)):
                yield (int(b), *total[b].tolist())

        return run

    rows = map_rows(docs, "bucket int, " + ", ".join(f"{n} long" for n in names), arrow, ("text",), start)
    return rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors, a row a bucket (zero where nothing was seen)."""
    sums = context_sums(docs).toArrow()  # at most BUCKETS rows
    vectors = np.zeros((BUCKETS, DIM), dtype=np.float64)
    if sums.num_rows:
        vectors[sums["bucket"].to_numpy()] = np.column_stack([sums[f"v{i}"].to_numpy() for i in range(DIM)])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Features of a text; long ones are read in blocks."""
    out = np.zeros(FEATURES)
    n = len(ids)
    if not n:
        return out
    first, second, near = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for low in range(0, n, block):
        v = vectors[ids[low : low + block + 1]]
        own = v[:block]
        first += own.sum(axis=0, dtype=np.float64)
        second += np.einsum("ij,ij->j", own, own, dtype=np.float64)
        near += np.einsum("ij,ij->j", v[1:], v[:-1], dtype=np.float64)
    mean = first / n
    out[:DIM] = mean
    out[DIM : 2 * DIM] = np.sqrt(np.maximum(second / n - mean * mean, 0))
    out[2 * DIM : 3 * DIM] = near / max(n - 1, 1)
    out[-1] = np.log1p(n)
    return out


class Network:
    """Two layers over standardised features, and a temperature for its logits."""

    def __init__(self, hidden: int = 32, seed: int = 3):
        self.hidden, self.seed, self.prior, self.layers, self.temperature = hidden, seed, 0.5, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> None:
        if not len(y):
            return
        self.prior = float(y.mean())
        if self.prior in (0.0, 1.0):
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        held = np.arange(len(y)) % 5 == 4
        z, rng = self._standard(x), np.random.default_rng(self.seed)
        own, target = (z[~held], y[~held]) if held.any() and 0 < y[~held].mean() < 1 else (z, y)
        layers = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, (self.hidden, 1)), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for low in range(0, len(order), batch):
                at = order[low : low + batch]
                h = np.maximum(own[at] @ layers[0] + layers[1], 0)
                error = (_sigmoid(h @ layers[2] + layers[3]) - target[at, None]) / len(at)
                back = (error @ layers[2].T) * (h > 0)
                grads = [own[at].T @ back + decay * layers[0], back.sum(axis=0), h.T @ error + decay * layers[2], error.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(layers, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.layers = layers
        if held.any():
            logits, truth = self._logits(z[held]), y[held]
            loss = lambda t: float(np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t).mean())
            self.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 101)), key=loss)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        return (np.maximum(z @ w + b, 0) @ u + c)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self._logits(self._standard(x)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(column: str = "doc_id"):
    """Rows that labels are not learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class QualityModel:
    """Word vectors and a network; ``fit`` then ``score``."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> QualityModel:
        vectors = word_vectors(docs)
        shared = docs.sparkSession.sparkContext.broadcast(vectors)
        order = F.xxhash64("id")
        marks = labels.where("quality is not null and doc_id is not null").where(~held_out())
        marks = marks.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("mark")).orderBy(order, "id").limit(sample)
        texts = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("id"))  # at most ``sample`` rows
        arrow = pa.schema([("id", pa.int64()), ("mark", pa.int32()), ("x", pa.list_(pa.float64()))])

        def start():
            memo = bucket_memo()

            def run(rows: Iterator[tuple]) -> Iterator[tuple]:
                for doc, mark, text in rows:
                    yield doc, mark, pooled(bucket_ids(text, memo), shared.value).tolist()

            return run

        rows = map_rows(texts, "id long, mark int, x array<double>", arrow, ("id", "mark", "text"), start)
        rows = rows.orderBy(order, "id", "x").limit(sample).toArrow()
        network = Network()
        x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
        network.fit(x, np.array(rows["mark"].to_pylist(), dtype=np.float64))
        return cls(vectors, network)

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """Add the probability of label 1; other columns stay as they are."""
        shared = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network))
        reachable(docs.sparkSession)

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vectors, network = shared.value
            memo = bucket_memo()
            for texts in batches:  # one text at a time is a Python object
                x = np.array([pooled(bucket_ids(t.as_py(), memo), vectors) for t in texts]).reshape(-1, FEATURES)
                yield pa.array(network.scores(x))
            release()

        return docs.withColumn(column, scored(F.col("text")))
