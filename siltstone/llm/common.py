"""Helpers shared by the training-data operators: shared storage, word pattern, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.workspace import Workspace, reachable, shared_root

__all__ = ["WORD", "Memo", "Workspace", "batched", "lower_ascii", "map_rows", "reachable", "release", "rows_of", "shared_root", "table"]

#: A word is a run of anything but ASCII white space.  ``bytes.split()`` cuts UTF-8 text the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time, so that only one text is a Python object at once."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches of at most ``limit`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def release() -> None:
    """Give freed memory back: a worker that waits for its next task shares its machine with other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, schema: str, arrow: pa.Schema, names: tuple[str, ...], start: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]]) -> DataFrame:
    """Stream rows through Python.  ``start`` runs once a task and gives the function over its rows."""

    def run(batches):
        yield from batched(start()(rows_of(batches, *names)), arrow)
        release()

    reachable(df.sparkSession)
    return df.select(*names).mapInArrow(run, schema)


class Memo(dict):
    """A mapping that computes missing values and forgets everything when it holds ``most`` of them."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
