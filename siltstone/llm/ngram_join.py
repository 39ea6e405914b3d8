"""Exact Jaccard join on word shingles with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles (64-bit hashes; a shorter text is one
shingle).  Two sets of similarity t share at least t of the larger one, so under any common order
of shingles, the first n - ceil(t n) + l shingles of each hold at least l common ones.  The join
uses this twice, with longer prefixes (a larger l) where a short one would cost many candidates:

1. Equal sets are folded by a 128-bit digest; from here on a node is a distinct set.
2. Counting.  In hash order, each set's prefix is lengthened by l = ``lengthen`` of its size.  Prefix
   shingles meet by hash in blocks; a set none of whose partners could hold l of them drops
   out.  A block of documents sends a shingle once, however many of them hold it, so
   common shingles do not gather.
3. Prefixes of what remains, shingles that many nodes hold last.  A document whose prefix still reaches common
   shingles, and so has a high estimated candidate cost, takes a longer prefix and needs as many
   more shared shingles.
4. Leaders.  Every node is verified against one leader, the node that most of its prefix lists name.
   The components of these links stand for large groups of near copies.  In further rounds, nodes outside the
   largest component of a list are verified against one node of it, as long as that closes many pairs.
5. Only pairs of different components are still open.  In each prefix list, nodes outside the
   largest component meet all others, under length and position bounds, a bound of parity maps (sets whose 2048-bit maps
   differ in d bits have at least d shingles that are not in both) and the number of shared shingles;
   distinct pairs are verified.  A group of near copies never meets all-against-all.

Pairs are verified by exact intersection, so every link between different sets is either found or
implied by its component, whatever the sizes of lists and groups.

Defined results: null, empty and blank texts have no shingles and link with nothing; repeated rows are
equal sets; a null doc_id counts only for lack of another id in its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Memo, Workspace, batched, map_rows, reachable, rows_of
from siltstone.llm.components import components, stars

SHINGLE = 5
#: Odd multipliers of the words of a shingle, from the digits of the golden ratio and a fixed generator.
FACTORS = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, SHINGLE)]
#: Shingles of this many nodes are common: they go to the end of the order.
COMMON = 32
#: Tables of at most this many narrow rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 300_000
#: Common shingles told to all tasks, at most (8 bytes each).  Others stay in hash order, which is as exact.
MOST_COMMON = 1 << 20
FLUSH = 2_000_000
#: Words of 64 bits of a parity map, a power of two.
WORDS = 32
#: Rounds of leaders, at most, before open nodes meet; the meeting is exact after any number of them.
ROUNDS = 6


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: Memo) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    parts = (text or "").encode().lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * FACTORS[k]
    return np.unique(mixed(total))


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, 250_000)


def least_overlap(n, percent: int):
    """Shingles that a partner shares at least: ``percent`` of the larger set."""
    return (n * percent + 99) // 100


def prefix_length(n: int, matches: int, percent: int) -> int:
    return min(n, n - int(least_overlap(n, percent)) + matches)


def first_matches(n: int, lengthen: float) -> int:
    """How many common shingles the counting prefix of a set asks for."""
    return max(1, int(lengthen * n))


def least_matches(n: int, lengthen: float, percent: int) -> int:
    """The same for its smallest possible partner, for which the pair's guarantee holds."""
    return first_matches(int(least_overlap(n, percent)), lengthen)


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


_COUNTED = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("short", pa.int64()), ("found", pa.int64()), ("tokens", pa.binary()), ("at", pa.binary()), ("owners", pa.binary())])
_COUNTED_SQL = "block int, doc_id long, version long, n long, digest binary, short long, found long, tokens binary, at binary, owners binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("short", pa.int64()), ("found", pa.int64())])
_FOUND_SQL = "doc_id long, version long, n long, digest binary, short long, found long"


class _Chunk:
    """Prefixes of consecutive documents, sent out together."""

    def __init__(self, blocks: int, lengthen: float, percent: int):
        self.blocks, self.lengthen, self.percent = blocks, lengthen, percent
        self.clear()

    def clear(self) -> None:
        self.docs, self.known, self.prefixes, self.shorts, self.size = [], set(), [], [], 0

    def add(self, doc_id, version: int, tokens: np.ndarray) -> None:
        n = len(tokens)
        digest = digest_of(tokens) if n else b""
        fresh = n > 0 and digest not in self.known
        self.docs.append((doc_id, version, n, digest, len(self.prefixes) if fresh else None))
        self.size += 1
        if fresh:
            self.known.add(digest)
            self.shorts.append(int.from_bytes(digest[:8], "little", signed=True) or 1)
            self.prefixes.append(tokens[: prefix_length(n, first_matches(n, self.lengthen), self.percent)])
            self.size += len(self.prefixes[-1])

    def send(self) -> Iterator[tuple]:
        """Rows of documents with what was found here, and a row for each block of shingles."""
        found = np.zeros(len(self.prefixes), dtype=np.int64)
        shorts = np.array(self.shorts, dtype=np.int64)
        if self.prefixes:
            token = np.concatenate(self.prefixes)
            owner = np.repeat(np.arange(len(self.prefixes), dtype=np.int32), list(map(len, self.prefixes)))
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            times = np.diff(np.r_[first, len(token)])
            found += np.bincount(owner[np.repeat(times > 1, times)], minlength=len(found))
            token, owner = token[first], np.where(times > 1, -1, owner[first])
            block = (token % np.uint64(self.blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            token, owner, block = (token[order] // np.uint64(self.blocks)).astype(np.uint32), owner[order], block[order]
            cuts = np.searchsorted(block, np.arange(self.blocks + 1))
            for b in range(self.blocks):
                low, high = cuts[b], cuts[b + 1]
                if low < high:
                    own = owner[low:high]
                    used, at = np.unique(own[own >= 0], return_inverse=True)
                    place = np.full(high - low, -1, dtype=np.int32)
                    place[own >= 0] = at
                    kind = np.int16 if len(used) < 1 << 15 else np.int32
                    yield b, None, None, kind().itemsize, None, None, None, token[low:high].tobytes(), place.astype(kind).tobytes(), shorts[used].tobytes()
        for i, (doc_id, version, n, digest, at) in enumerate(self.docs):
            yield i % self.blocks, doc_id, version, n, digest, None if at is None else self.shorts[at], 0 if at is None else int(found[at]), None, None, None
        self.clear()


def _meet(group: pa.Table) -> pa.Table:
    """Pass documents on, and credit sets with shingles of this block that another set holds too."""
    whole = group.filter(pc.is_valid(group["digest"])).select(_FOUND.names).cast(_FOUND)
    sent = group.filter(pc.is_valid(group["tokens"]))
    if not sent.num_rows:
        return whole
    tokens, shorts = [], []
    for row in sent.to_pylist():
        tokens.append(np.frombuffer(row["tokens"], dtype=np.uint32))
        place = np.frombuffer(row["at"], dtype=np.int16 if row["n"] == 2 else np.int32).astype(np.int64)
        shorts.append(np.append(np.frombuffer(row["owners"], dtype=np.int64), 0)[place])  # -1: several
    token, short = map(np.concatenate, (tokens, shorts))
    order = np.argsort(token, kind="stable")
    token, short = token[order], short[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    shared = np.minimum.reduceat(short, first) != np.maximum.reduceat(short, first)
    times = np.diff(np.r_[first, len(token)])
    credit, found = np.unique(short[np.repeat(shared, times) & (short != 0)], return_counts=True)
    none = lambda t: pa.nulls(len(credit), t)
    return pa.concat_tables([whole, pa.table([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(credit), pa.array(found)], schema=_FOUND)])


def _common(group: pa.Table) -> pa.Table:
    """Marks of the shingles of a block that ``COMMON`` nodes or more hold."""
    rows = group.to_pylist()
    token = np.concatenate([np.frombuffer(r["tokens"], dtype=np.int64) for r in rows])
    times = np.concatenate([np.frombuffer(r["times"], dtype=np.int32) for r in rows])
    order = np.argsort(token, kind="stable")
    token, times = token[order], times[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    total = np.add.reduceat(times, first)
    often = total >= COMMON
    return pa.table({"common": pa.array(token[first][often]), "nodes": pa.array(total[often].astype(np.int64))})


class NgramJoin:
    """The join of ``docs(doc_id, text)``; ``result()`` has a row a document."""

    def __init__(self, docs: DataFrame, percent: int = 75, lengthen: float = 0.15, block_bytes: int = 16_000_000):
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
        self.percent, self.lengthen = percent, lengthen
        self.spark = docs.sparkSession
        self.ws = Workspace(self.spark, "ngrams")
        total = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = max(16, int(total // block_bytes))

    def small(self, df: DataFrame) -> DataFrame:
        """Broadcast a narrow table of a size counted here, else leave it to a shuffle."""
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def count(self) -> None:
        """Steps 1 and 2: ``rows`` (documents) and ``nodes`` (sets that may have partners)."""
        blocks, lengthen, percent = self.blocks, self.lengthen, self.percent

        def start():
            words = word_hashes()

            def run(rows):
                chunk = _Chunk(blocks, lengthen, percent)
                for doc_id, version, text in rows:
                    chunk.add(doc_id, version, shingles(text, words))
                    if chunk.size >= FLUSH:
                        yield from chunk.send()
                yield from chunk.send()

            return run

        sent = map_rows(self.docs, _COUNTED_SQL, _COUNTED, ("doc_id", "version", "text"), start)
        met = sent.groupBy("block").applyInArrow(_meet, _FOUND_SQL)
        met = self.ws.write(met, "met")
        self.rows = met.where("digest is not null").select("doc_id", "version", "n", "digest")
        sets = met.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.min(F.struct("doc_id", "version")).alias("text_of"), F.max("n").alias("n"), F.max("short").alias("short"))
        found = met.where("short is not null").groupBy(F.col("short").alias("of")).agg(F.sum("found").alias("found"))
        self.sets = self.ws.write(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
        overlap = F.expr(f"(n * {percent} + 99) div 100")
        asked = F.greatest(F.lit(1), F.floor(F.lit(lengthen) * overlap))
        left = self.sets.join(found, F.col("short") == F.col("of")).where(F.col("found") >= asked)
        self.nodes = self.ws.write(left.select("node", "text_of", "digest", "n"), "nodes")

    def fetch(self) -> None:
        """The shingles of the nodes, from the text of one document each."""
        wanted = self.small(self.nodes.select("text_of", "node", "digest"))
        same = F.col("doc_id").eqNullSafe(F.col("text_of.doc_id")) & (F.col("version") == F.col("text_of.version"))
        texts = self.docs.join(wanted, same)

        def start():
            words = word_hashes()

            def run(rows):
                for node, digest, text in rows:
                    tokens = shingles(text, words)
                    if digest_of(tokens) == digest:
                        yield node, len(tokens), tokens.tobytes()

            return run

        arrow = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
        self.tokens = self.ws.write(map_rows(texts, "node long, n long, tokens binary", arrow, ("node", "digest", "text"), start), "tokens")

    def commons(self) -> None:
        """The shingles that many nodes hold, counted over all shingles of all nodes."""
        blocks = self.blocks
        arrow = pa.schema([("block", pa.int32()), ("tokens", pa.binary()), ("times", pa.binary())])
        reachable(self.spark)

        def send(held):
            token, times = np.unique(np.concatenate(held), return_counts=True)
            block = token % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            token, times, block = token[order].view(np.int64), times[order].astype(np.int32), block[order]
            cuts = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
            for b, (low, high) in enumerate(zip(cuts, cuts[1:])):
                if low < high:
                    yield b, token[low:high].tobytes(), times[low:high].tobytes()

        def run(batches):
            def rows():
                held, size = [], 0
                for (data,) in rows_of(batches, "tokens"):
                    held.append(np.frombuffer(data, dtype=np.uint64))
                    size += len(held[-1])
                    if size >= FLUSH:
                        yield from send(held)
                        held, size = [], 0
                if held:
                    yield from send(held)

            yield from batched(rows(), arrow, 64)

        sent = self.tokens.select("tokens").mapInArrow(run, "block int, tokens binary, times binary")
        found = sent.groupBy("block").applyInArrow(_common, "common long, nodes long")
        most = found.orderBy(F.col("nodes").desc(), "common").limit(MOST_COMMON).toArrow()
        table = np.sort(np.array(most["common"], dtype=np.int64))
        self.common = self.spark.sparkContext.broadcast(table)

    def prefixes(self) -> None:
        """Step 3: ``token, node, n, at, matches`` for the prefix of every node."""
        common, percent = self.common, self.percent
        arrow = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("matches", pa.int32())])
        reachable(self.spark)

        def run(batches):
            for node, n, data in rows_of(batches, "node", "n", "tokens"):
                tokens = np.frombuffer(data, dtype=np.uint64)
                signed = tokens.view(np.int64)
                last = np.zeros(n, dtype=bool)
                if len(common.value):
                    where = np.searchsorted(common.value, signed)
                    last = common.value[np.minimum(where, len(common.value) - 1)] == signed
                order = np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)])
                short = prefix_length(n, 1, percent)
                # Common shingles in the shortest prefix make many candidates; ask for more matches.
                reach = max(0, short - int((~last).sum()))
                matches = 1 if not reach else min(8, 1 + reach)
                k = prefix_length(n, matches, percent)
                same = lambda v: pa.array(np.full(k, v, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order[:k]].view(np.int64)), pa.array(np.full(k, node)), same(n), pa.array(np.arange(k, dtype=np.int32)), same(matches)], schema=arrow)

        out = self.tokens.mapInArrow(run, "token long, node long, n int, at int, matches int")
        self.lists = self.ws.write(out, "lists")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Exact links among ``pairs(a, b)``; many pairs may share a ``b``."""
        percent = self.percent
        pairs = self.ws.write(pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(64)).alias("salt")), f"{name}-pairs")
        members = self.tokens.join(self.small(pairs), F.col("node") == F.col("a")).select("b", "salt", "node", "tokens")
        hubs = pairs.select("b", "salt").distinct()
        hubs = self.tokens.join(self.small(hubs), F.col("node") == F.col("b")).select("b", "salt", "node", "tokens")
        both = hubs.withColumn("member", F.lit(False)).unionByName(members.withColumn("member", F.lit(True)))
        both = both.repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
        arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(batches):
            def links():
                hub, own = None, None
                for b, node, data, member in rows_of(batches, "b", "node", "tokens", "member"):
                    tokens = np.frombuffer(data, dtype=np.uint64)
                    if not member:
                        hub, own = b, tokens
                    elif hub == b:
                        where = np.searchsorted(own, tokens)
                        same = int((own[np.minimum(where, len(own) - 1)] == tokens).sum())
                        if 100 * same >= percent * (len(own) + len(tokens) - same):
                            yield node, b

            yield from batched(links(), arrow)

        reachable(self.spark)
        return self.ws.write(both.mapInArrow(run, "a long, b long").distinct(), f"{name}-links")

    def leaders(self) -> DataFrame:
        """One pair for every node that shares a prefix shingle: itself and its leader.

        A list's leader reaches the shingle with the fewest others before it, so it is the least
        edited of its copies.
        """
        best = self.lists.groupBy("token").agg(F.min(F.struct("at", "node")).alias("best"), F.count("*").alias("nodes"))
        best = self.ws.write(best.where("nodes > 1").select("token", F.col("best.node").alias("leader")), "best")
        votes = self.lists.join(best, "token").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
        first = votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader"))
        return first.select(F.col("node").alias("a"), F.col("leader").alias("b"))

    def sides(self, labels: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Prefix lists whose nodes are in several components, and how many pairs are open there."""
        named = self.lists.join(self.small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = self.ws.write(named, f"{name}-named")
        sides = named.groupBy("token", "component").agg(F.count("*").alias("nodes"))
        sides = sides.groupBy("token").agg(F.max_by("component", F.struct("nodes", "component")).alias("main"), F.count("*").alias("sides"), F.sum("nodes").alias("nodes"), F.max("nodes").alias("most"))
        sides = self.ws.write(sides.where("sides > 1"), f"{name}-sides")
        few = F.col("nodes") - F.col("most")
        pairs = sides.agg(F.sum(few * F.col("most") + few * (few - 1) / 2)).first()[0] or 0
        return named.join(sides.select("token", "main"), "token"), pairs

    def closer(self, left: DataFrame, step: int) -> DataFrame:
        """One pair for a node outside the largest components of its lists: a node that most of these lists name, at first the least edited one, then any."""
        rank = F.struct("at", "node", "n") if step == 1 else F.struct(F.xxhash64(F.lit(step), "node").alias("at"), "node", "n")
        best = left.where("component = main").groupBy("token").agg(F.min(rank).alias("best"))
        best = self.ws.write(best.select("token", F.col("best.node").alias("leader"), F.col("best.n").alias("whole")), f"best{step}")
        named = left.where("component <> main").join(best, "token")
        named = named.where(100 * F.least("n", "whole") >= self.percent * F.greatest("n", "whole"))
        votes = named.groupBy("node", "leader").agg(F.count("*").alias("votes"))
        first = votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader"))
        return first.select(F.col("node").alias("a"), F.col("leader").alias("b"))

    def led(self) -> tuple[DataFrame, DataFrame]:
        """Step 4: links of nodes with leaders, and the lists that are still open."""
        links = self.verify(self.leaders(), "links0")
        labels = components(links, self.ws, "c0")
        left, pairs = self.sides(labels, "s0")
        for step in range(1, ROUNDS):
            if not pairs:
                break
            more = self.verify(self.closer(left, step), f"links{step}")
            labels = components(stars(labels).unionByName(more), self.ws, f"c{step}")
            before = pairs
            left, pairs = self.sides(labels, f"s{step}")
            if 5 * pairs > 4 * before:
                break
        return stars(labels), left

    def parity(self) -> DataFrame:
        """``node, map0, ...``: each shingle flips one bit."""
        arrow = pa.schema([("node", pa.int64()), *((f"map{w}", pa.int64()) for w in range(WORDS))])

        def start():
            def run(rows):
                for node, data in rows:
                    at = (np.frombuffer(data, dtype=np.uint64) % np.uint64(64 * WORDS)).astype(np.int64)
                    odd = (np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)
                    yield (node, *np.packbits(odd).view(np.int64).tolist())

            return run

        sql = "node long, " + ", ".join(f"map{w} long" for w in range(WORDS))
        return map_rows(self.tokens, sql, arrow, ("node", "tokens"), start)

    def crossing(self, left: DataFrame) -> DataFrame:
        """Step 5: pairs of nodes of different components that the bounds leave open."""
        maps = self.ws.write(self.parity(), "maps")
        open_lists = self.ws.write(left.join(maps, "node"), "open")
        few = open_lists.where("component <> main").alias("x")
        every = open_lists.alias("y")
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        p = self.percent
        # The first shared shingle of a pair has no shared one before it, so what follows must suffice.
        bound = F.least(x("n") - x("at"), y("n") - y("at"))
        apart = [F.bit_count(x(f"map{w}").bitwiseXOR(y(f"map{w}"))) for w in range(WORDS)]
        fits = (
            (x("token") == y("token"))
            & (x("component") != y("component"))
            & ((y("component") == y("main")) | (x("node") < y("node")))
            & (100 * F.least("x.n", "y.n") >= p * F.greatest("x.n", "y.n"))
            & (bound * (100 + p) >= p * (x("n") + y("n")))
            & (sum(apart[1:], apart[0]) * (100 + p) <= (100 - p) * (x("n") + y("n")))
        )
        met = few.join(every, fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        met = self.ws.write(met.distinct(), "crossing")
        lists = self.lists.select("token", "node", "matches")
        one = self.small(met).join(lists.select(F.col("node").alias("a"), "token", F.col("matches").alias("own")), "a")
        two = one.join(lists.select(F.col("node").alias("b"), "token", "matches"), ["b", "token"])
        counted = two.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("own", "matches")).alias("asked"))
        return counted.where("shared >= asked").select("a", "b")

    def result(self) -> DataFrame:
        self.count()
        self.fetch()
        self.commons()
        self.prefixes()
        first, left = self.led()
        second = self.verify(self.crossing(left), "second")
        final = components(first.unionByName(second), self.ws, "c")
        named = self.sets.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = self.ws.write(named.select(F.col("digest").alias("of"), "first_doc", "component"), "named-sets")
        least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
        joined = self.ws.write(named.join(least, "component").select("of", "component", "component_id"), "ids")
        out = self.rows.join(joined, F.col("digest") == F.col("of"), "left")
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "version", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; see ``NgramJoin``."""
    return NgramJoin(docs, **options).result().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: that with the component's smallest id, of several the one with the least text hash.

    Documents without shingles all stay.  Rows that repeat both id and text count as one document.
    """
    ws = Workspace(docs.sparkSession, "keep")
    found = ws.write(NgramJoin(docs, **options).result(), "found")
    times = found.groupBy("doc_id", "version", "component").agg(F.count("*").alias("times"))
    first = times.where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "version", "times")).alias("f")
    )
    first = ws.write(first.select("f.doc_id", "f.version", "f.times"), "first")
    empty = found.where("n_shingles = 0").select("doc_id", "version").distinct()
    d = docs.alias("d")

    def only(kept: DataFrame) -> DataFrame:
        k = kept.alias("k")
        return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.version")), "left_semi")

    once = only(first.where("times = 1").drop("times").unionByName(empty))
    return once.unionByName(only(first.where("times > 1")).dropDuplicates(["doc_id", "text"]))
