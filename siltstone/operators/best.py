"""The best documents of each query within a task, so that only those are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of one array that a task computes at once (16 MB of doubles).
CELLS = 2_000_000
_UNIT = 1e9


class Best:
    """The k best documents of each query among all that were added.

    Scores are compared to nine decimals and ties go by id, as in ``lexical.top_k``; ids are of any type that Arrow orders.
    """

    def __init__(self, queries: int, k: int, high: bool = True, last: bool = True):
        self.k, self.sign, self.last = k, 1 if high else -1, last
        self.bound = np.full(queries, -np.inf)
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, ids: pa.Array, columns: np.ndarray | None = None) -> None:
        """``scores[document, query]`` of the documents ``ids``; ``columns`` are the numbers of the queries, if not all."""
        good, bound = self.sign * scores, self.bound if columns is None else self.bound[columns]
        near = ~(good < bound)  # with those that are not a number, which come last
        if len(good) > self.k and np.count_nonzero(near) > 4 * self.k * len(bound):
            least = np.partition(good, len(good) - self.k, axis=0)[len(good) - self.k]
            near = ~(good < np.maximum(bound, least - 2 / _UNIT))
        document, query = np.nonzero(near)
        if not len(document):
            return
        own = ids.take(pa.array(document))
        score = np.concatenate([self.score, scores[document, query]])
        query = np.concatenate([self.query, query if columns is None else columns[query]])
        own = own if self.ids is None else pa.concat_arrays([self.ids, own])
        place = pc.rank(own, sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)
        key = self.sign * np.sign(score) * np.floor(np.abs(score) * _UNIT + 0.5)
        order = np.lexsort((-place if self.last else place, -key, query))
        each, at = query[order], np.arange(len(order))
        nth = at - np.maximum.accumulate(np.where(np.r_[True, each[1:] != each[:-1]], at, 0))
        kth, kept = order[nth == self.k - 1], order[nth < self.k]
        self.bound[query[kth]] = (key[kth] - 1) / _UNIT
        self.query, self.score, self.ids = query[kept], score[kept], own.take(pa.array(kept))

    def found(self) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        """Numbers of queries, ids and scores; none if nothing was added."""
        return None if self.ids is None else (self.query, self.ids, self.score)
