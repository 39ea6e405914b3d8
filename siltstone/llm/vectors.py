"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated by a random orthonormal map into ``bands * bits`` dimensions D; its code is the sign of each
coordinate (D at least the vector's own length), c = sign / sqrt(D), and its correction factor is f = <c, o>.  For another unit vector q,
<c, q> / f is an unbiased estimate of <o, q> whose error stays within ``sigmas`` times
sqrt((1 - f^2) / f^2 / (D - 1)) but for rare cases.  As the other side q is stored as bytes too, whose distance from q
is stored as ``gap``, another gap / f is allowed.

1. D is at least ``WIDE``.  ``codes`` holds, once for every different vector, its sign bits, factor, bytes, their scale and the gap.
2. Candidates share a band of ``bits`` code bits.  Bits grow with the logarithm of the number of vectors and
   bands so that a pair at the threshold is met with probability ``recall``; closer pairs are met more often.
3. A bucket of any size is cut into tiles of ``TILE`` vectors.  A task reads the codes of two tiles and
   names the vectors for which some estimate plus bound reaches the threshold: never pairs.
4. Only these vectors' components are read, for these tiles, and compared in double precision.  A pair counts in the first band
   that it shares only, by the stored bits.  A task adds up links and hands on one row a vector (its links there and the
   smallest vector it hangs together with).

Equal vectors are folded into one node with a number of copies.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link; a null vec_id counts only for lack of another
id in its component; one row per input row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace, map_rows, reachable
from siltstone.llm.components import components

TILE = 1024
#: Sign bits of a code, at least, so that estimates of a few bands are narrow too.
WIDE = 256


def rotation(dim: int, least: int, seed: int = 11) -> np.ndarray:
    """A random map of ``dim`` into at least ``least`` dimensions (and ``dim``) that keeps lengths and angles."""
    wide = max(dim, least)
    q, _ = np.linalg.qr(np.random.default_rng((seed, dim, wide)).normal(size=(wide, dim)))
    return q.astype(np.float32)


def band_codes(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The first ``bits * bands`` signs (0 or 1) of each row as one number a band."""
    return signs[:, : bits * bands].reshape(len(signs), bands, bits).astype(np.int64) @ (1 << np.arange(bits))


def plan(nodes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    bits = min(24, max(6, round(math.log2(max(nodes, 2))) - 6))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def encoded(raw: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Packed sign bits, factor, bytes, scale and gap of each row."""
    unit = raw.astype(np.float64)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit.astype(np.float32) @ rotation_of(raw.shape[1], least).T
    factor = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1]), 1e-6).astype(np.float32)
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    small = np.rint(unit / scale[:, None]).clip(-127, 127).astype(np.int8)
    gap = np.linalg.norm(unit - small * scale[:, None].astype(np.float64), axis=1).astype(np.float32)
    return np.packbits(turned > 0, axis=1), factor, small, scale, gap


def signs_of(packed, dim: int, least: int) -> np.ndarray:
    """Stored sign bits as 0 and 1, a row a vector."""
    wide = max(dim, least)
    return np.unpackbits(np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1), axis=1, count=wide)


def together(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share no band before ``band``."""
    return ~(left[i, :band] == right[j, :band]).any(axis=1)


class Codes:
    """Stored codes of one tile."""

    def __init__(self, signs, factor: np.ndarray, small, scale: np.ndarray, gap: np.ndarray, bits: int, bands: int, least: int):
        low = np.frombuffer(b"".join(small), dtype=np.int8).reshape(len(small), -1).astype(np.float32) * scale[:, None]
        held = signs_of(signs, low.shape[1], least)
        self.code = (held * np.float32(2) - np.float32(1)) / np.float32(math.sqrt(held.shape[1]))
        self.turned = low @ rotation_of(low.shape[1], least).T
        self.factor, self.gap, self.bands = factor, gap, band_codes(held, bits, bands)

    def estimates(self, other: Codes, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of each vector here with each of ``other``, and their bounds."""
        wide = self.code.shape[1]
        spread = sigmas * np.sqrt(np.maximum(1 / self.factor**2 - 1, 0) / max(wide - 1, 1)) + 1e-5
        return (self.code @ other.turned.T) / self.factor[:, None], spread[:, None] + other.gap[None, :] / self.factor[:, None]

    def close(self, other: Codes, threshold: float, sigmas: float, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each vector here, and each of ``other``, may reach the threshold with one of the other side."""
        estimate, bound = self.estimates(other, sigmas)
        i, j = np.nonzero(estimate + bound >= threshold)
        keep = i < j if self is other else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        here, there = np.zeros(len(self.factor), dtype=bool), np.zeros(len(other.factor), dtype=bool)
        for low in range(0, len(i), 1 << 16):  # bounded memory in dense tiles
            a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            new = together(self.bands, other.bands, a, b, band)
            here[a[new]] = there[b[new]] = True
        return here, there


class Tile:
    """Exact vectors of one tile, with the bands of their stored codes."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, raw: np.ndarray, bands: np.ndarray):
        self.node, self.copies, self.bands = node, copies, bands
        exact = raw.astype(np.float64)
        self.unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)

    def near(self, other: Tile, threshold: float, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs at or over the threshold that share no earlier band."""
        i, j = np.nonzero(self.unit @ other.unit.T >= threshold - 1e-9)
        keep = i < j if self is other else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        close = []
        for low in range(0, len(i), 1 << 16):
            a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            # A sum that doesn't depend on the tile's shape settles pairs at the threshold.
            exact = np.einsum("ij,ij->i", self.unit[a], other.unit[b]) >= threshold
            exact &= together(self.bands, other.bands, a, b, band)
            close.append((a[exact], b[exact]))
        if not close:
            return np.empty(0, dtype=int), np.empty(0, dtype=int)
        return tuple(map(np.concatenate, zip(*close)))


def hang(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``size`` positions is connected to."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(left: Tile, right: Tile, threshold: float, band: int) -> Iterator[tuple[int, int, int]]:
    """``node, links, root`` for the vectors with a link between the tiles."""
    i, j = left.near(right, threshold, band)
    if not len(i):
        return
    same = left is right
    node = left.node if same else np.concatenate([left.node, right.node])
    order = np.argsort(node, kind="stable")
    place = np.argsort(order, kind="stable")
    i, j = place[i], place[j if same else j + len(left.node)]
    copies = (left.copies if same else np.concatenate([left.copies, right.copies]))[order]
    links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
    root = hang(len(node), i, j)
    for k in np.flatnonzero(links):
        yield int(node[order[k]]), int(links[k]), int(node[order[root[k]]])


class NearVectors:
    """Near duplicates among ``vectors(vec_id, embedding)``."""

    def __init__(self, vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, sigmas: float = 5.0):
        self.vectors = vectors.select("vec_id", "embedding")
        self.threshold, self.recall, self.sigmas = threshold, recall, sigmas
        self.ws = Workspace(vectors.sparkSession, "vectors")
        reachable(vectors.sparkSession)

    def fold(self) -> None:
        """``rows(vec_id, raw)`` and ``nodes(node, raw, copies, first_id)``: different usable vectors."""

        def run(batches):
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # nulls are NaN, -0 is 0
                ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                upto = lambda marks: np.concatenate([[0], np.cumsum(marks)])
                starts = np.concatenate([[0], ends[:-1]])
                bad, used = upto(~np.isfinite(flat)), upto(flat != 0)
                usable = (bad[ends] == bad[starts]) & (used[ends] > used[starts])
                raws = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(starts, ends, usable)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, type=pa.binary())], names=["vec_id", "raw"])

        rows = self.vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, "vec_id long, raw binary")
        self.rows = self.ws.write(rows, "rows")
        nodes = self.rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        self.nodes = self.ws.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def encode(self, bits: int, bands: int, least: int) -> None:
        """``codes(node, dim, signs, factor, small, scale, gap, bands)`` of all nodes."""
        arrow = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("signs", pa.binary()), ("factor", pa.float32()), ("small", pa.binary()), ("scale", pa.float32()), ("gap", pa.float32()), ("bands", pa.list_(pa.int64()))])

        def start():
            def run(rows):
                for node, raw in rows:
                    x = np.frombuffer(raw, dtype=np.float32)[None, :]
                    signs, factor, small, scale, gap = encoded(x, least)
                    cut = band_codes(signs_of([signs.tobytes()], x.shape[1], least), bits, bands)
                    yield node, x.shape[1], signs.tobytes(), factor[0], small.tobytes(), scale[0], gap[0], cut[0]

            return run

        schema = "node long, dim int, signs binary, factor float, small binary, scale float, gap float, bands array<long>"
        self.codes = self.ws.write(map_rows(self.nodes, schema, arrow, ("node", "raw"), start), "codes")

    def partial(self) -> DataFrame:
        """``node, links, root`` rows of all tasks."""
        bits, bands = plan(self.nodes.count(), self.threshold, self.recall)
        threshold, sigmas = self.threshold, self.sigmas
        least = max(bits * bands, WIDE)
        self.encode(bits, bands, least)
        met = self.codes.select("node", "dim", F.posexplode("bands").alias("band", "code"))
        sizes = met.groupBy("band", "dim", "code").agg(F.count("*").alias("size")).where("size > 1")
        sizes = self.ws.write(sizes.select("band", "dim", "code", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "sizes")
        placed = met.join(sizes, ["band", "dim", "code"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        # A tile meets itself and every other tile of its bucket once.
        each = placed.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        keyed = each.select("node", "band", "dim", "code", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
        keys = ["band", "dim", "code", "x", "y"]

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.repartition(*keys).sortWithinPartitions(*keys, "tile", "node")

        def sides(key, tile):
            return (slice(None),) if key[3] == key[4] else (tile == key[3], tile == key[4])

        place = pa.schema([("node", pa.int64()), *((k, pa.int64() if k == "code" else pa.int32()) for k in keys), ("tile", pa.int32())])

        def choose(batches):
            for key, (tile, node, signs, factor, small, scale, gap) in grouped(batches, keys, ("tile", "node", "signs", "factor", "small", "scale", "gap")):
                at = sides(key, tile)
                parts = [Codes(signs[s], factor[s], small[s], scale[s], gap[s], bits, bands, least) for s in at if len(node[s])]
                if len(parts) < len(at):
                    continue
                marks = np.zeros(len(node), dtype=bool)
                for s, near in zip((at[0], at[-1]), parts[0].close(parts[-1], threshold, sigmas, key[0])):
                    marks[s] |= near
                if marks.any():
                    size = int(marks.sum())
                    fixed = [pa.array(np.full(size, k), type=place.field(n).type) for n, k in zip(keys, key)]
                    yield pa.RecordBatch.from_arrays([pa.array(node[marks], type=pa.int64()), *fixed, pa.array(tile[marks], type=pa.int32())], schema=place)

        stored = self.codes.select("node", "signs", "factor", "small", "scale", "gap")
        schema = "node long, band int, dim int, code long, x int, y int, tile int"
        chosen = self.ws.write(dealt(keyed.join(stored, "node")).mapInArrow(choose, schema), "chosen")
        out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

        def run(batches):
            for key, (tile, node, copies, raw, signs) in grouped(batches, keys, ("tile", "node", "copies", "raw", "signs")):
                data = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(node), -1)
                cut = band_codes(signs_of(signs, data.shape[1], least), bits, bands)
                parts = [Tile(node[s], copies[s], data[s], cut[s]) for s in sides(key, tile)]
                found = list(compare(parts[0], parts[-1], threshold, key[0]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found)], schema=out)

        exact = chosen.join(self.nodes.select("node", "copies", "raw"), "node").join(self.codes.select("node", "signs"), "node")
        return self.ws.write(dealt(exact).mapInArrow(run, "node long, links long, root long"), "partial")

    def result(self) -> DataFrame:
        self.fold()
        partial = self.partial()
        links = partial.groupBy("node").agg(F.sum("links").alias("links"))
        hung = components(partial.select(F.col("node").alias("a"), F.col("root").alias("b")), self.ws, "cc")
        named = self.nodes.join(links, "node", "left").join(hung, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = self.ws.write(named.select(F.col("raw").alias("of"), "copies", "links", "component", "first_id"), "named")
        least = named.groupBy(F.col("component").alias("whole")).agg(F.min("first_id").alias("component_id"))
        named = self.ws.write(named.join(least, F.col("component") == F.col("whole")).select("of", "copies", "links", "component_id"), "ids")
        joined = self.rows.join(named, F.col("raw") == F.col("of"), "left")
        component = F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        return joined.select(
            "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
        )


_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation_of(dim: int, least: int) -> np.ndarray:
    """One rotation a process for each shape."""
    if (dim, least) not in _rotations:
        _rotations[dim, least] = rotation(dim, least)
    return _rotations[dim, least]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], values: tuple[str, ...]) -> Iterator[tuple[tuple, tuple]]:
    """Runs of equal keys in sorted batches: the key, then the columns of ``values``."""
    held, held_key = [], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        rest = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in values]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            key = tuple(int(c[low]) for c in columns)
            if key != held_key and held:
                yield held_key, tuple(map(np.concatenate, zip(*held)))
                held = []
            held_key = key
            held.append([c[low:high] for c in rest])
    if held:
        yield held_key, tuple(map(np.concatenate, zip(*held)))


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``; see ``NearVectors``."""
    return NearVectors(vectors, **options).result()
