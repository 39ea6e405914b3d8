"""Mixing sources to target weights, with built-in functions only.

The words of each source, its documents in pseudorandom order, are packed into blocks of ``block``
words.  Each source's target is met by a number of block slots.  Their counts over the output shards are a seeded multinomial
draw with the source's total held at its target.  Slots are made from these counts: a shard's slots of a source follow
those of the shards before it.  A slot's number within its source goes through the
source's pseudorandom permutation of block numbers (a swap-or-not shuffle: a bijection for
any number of blocks), once for each pass over the source, and slots are joined with
blocks by that index.  The last slot of a source is cut so that its words meet the target.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share
``ratio`` times all words; none gets more than ``most`` times its own words, and what one cannot
take is shared among the others by weight until all fit.

Scale: documents of a source are numbered in about sqrt(documents) hash chunks, so neither a
hot source nor the table of chunks meets in one task.  Only one row a source is sorted
globally.

Defined results: null and empty texts have size 0 and take nothing; a null source is a
source; one row per input row; the same input gives the same output whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, Workspace

ROUNDS = 12
RANGE = 4096
SLOTS_A_TASK = 65_536
SHARDS_A_CHUNK = 1024
#: What slots need of their source's plan.
PLAN = ["source_no", "blocks", "short", "rest", "slots", "last_take"]
#: One copy of a document in fixed point, so that sums are exact in any order.
ONE = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: int = 2) -> DataFrame:
    """Add ``source_no`` and ``target`` to ``sources(source, source_size)``, one row a source.

    Caps bind in the order of cap over weight.  With the sources before one capped, the level is
    what the whole leaves for each unit of the other weights; it rises up to the first
    source that fits under it and falls from there, so the highest level that fits is the answer.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("source_no", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    every = W.partitionBy()
    whole = F.sum("source_size").over(every) * ratio
    capped_before = F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1))
    weight_from = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    level = (whole - F.coalesce(capped_before, F.lit(0))) / weight_from
    stepped = numbered.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.max(F.when(F.col("free"), F.col("level"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(water * F.col("weight"), F.col("cap").cast("double")))
    return stepped.select("source", "source_size", "source_no", target.alias("target"))


def _round(x: Column, number: Column, source: Column, blocks: Column, seed: int) -> Column:
    """One swap-or-not round; its own inverse."""
    key = F.pmod(F.xxhash64(F.lit(seed), source, number), blocks)
    other = F.pmod(key - x + blocks, blocks)
    coin = F.xxhash64(F.lit(seed), source, number, F.greatest(x, other)).bitwiseAND(1)
    return F.when(coin == 1, other).otherwise(x)


def permuted(index: Column, source: Column, blocks: Column, seed: int, inverse: bool = False) -> Column:
    """The source's permutation of ``[0, blocks)``."""
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), index, lambda x, r: _round(x, r, source, blocks, seed))


def plan_sources(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Add blocks, slots, the words of the last block and the words taken from the last slot."""
    size, need = F.col("source_size"), F.round("target").cast("long")
    # Filters may move: divisors stay positive for sources without words too.
    out = sources.where("source_size > 0").withColumn("source_size", F.greatest(size, F.lit(1))).withColumn("need", need)
    out = out.withColumn("blocks", F.ceil(size / block)).withColumn("short", size - (F.col("blocks") - 1) * block)
    out = out.withColumn("rest", F.col("need") % size).withColumn("passes", F.expr("need div source_size"))
    at = permuted(F.col("blocks") - 1, F.col("source_no"), F.col("blocks"), seed, inverse=True)
    out = out.withColumn("short_at", at)
    before, rest = F.col("short_at") * block, F.col("rest")
    tail = rest - F.col("short")
    more = (
        F.when(rest <= before, F.ceil(rest / block))
        .when(rest <= before + F.col("short"), F.col("short_at") + 1)
        .otherwise(F.ceil(tail / block) + 1)
    )
    out = out.withColumn("more", more)
    last = (
        F.when(rest <= before, rest - (F.col("more") - 1) * block)
        .when(rest <= before + F.col("short"), rest - before)
        .otherwise(tail - (F.col("more") - 2) * block)
    )
    return out.withColumn("last_take", last).withColumn("slots", F.col("passes") * F.col("blocks") + F.col("more"))


def draw(sources: DataFrame, seed: int, per_shard: int = 4096, parts: int = 4) -> DataFrame:
    """The multinomial counts: ``slots_here`` of each source in each output shard, and the source's slots ``before``.

    Of each source as many shards are drawn as it has slots, so a shard gets about ``per_shard`` slots in all.
    """
    ranges = sources.where("slots > 0").withColumn("range", F.explode(F.expr(f"sequence(0, (slots - 1) div {RANGE})")))
    ranges = ranges.repartition(parts, "source_no", "range")
    first = F.col("range") * RANGE
    draws = ranges.withColumn("draw", F.explode(F.sequence(first, F.least(first + RANGE, F.col("slots")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "source_no", "draw"), F.ceil(F.col("all_slots") / per_shard))
    counts = draws.withColumn("shard", shard).groupBy("shard", *PLAN).agg(F.count("*").alias("slots_here"))
    # Running sums in two steps, so that no task sorts all shards of a source.
    counts = counts.withColumn("chunk", F.expr(f"shard div {SHARDS_A_CHUNK}"))
    sums = counts.groupBy("source_no", "chunk").agg(F.sum("slots_here").alias("inside"))
    sums = sums.select(F.col("source_no").alias("of"), F.col("chunk").alias("of_chunk"), running("inside", W.partitionBy("source_no").orderBy("chunk")).alias("start"))
    counts = counts.withColumn("inside", running("slots_here", W.partitionBy("source_no", "chunk").orderBy("shard")))
    counts = counts.join(sums.hint("merge"), (F.col("source_no") == F.col("of")) & (F.col("chunk") == F.col("of_chunk")))
    return counts.select("shard", *PLAN, "slots_here", (F.col("start") + F.col("inside")).alias("before"))


def running(value: str, order) -> Column:
    """The sum of the rows before."""
    return F.coalesce(F.sum(value).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def slots(counts: DataFrame, block: int, seed: int, parts: int = 4) -> DataFrame:
    """One row a slot of the drawn counts: ``source_no, slot, shard, block_no, take, block_size``, made in ``parts`` tasks."""
    each = counts.repartition(parts, "source_no", "shard")
    each = each.withColumn("slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("slots_here") - 1)))
    index = permuted(F.col("slot") % F.col("blocks"), F.col("source_no"), F.col("blocks"), seed)
    each = each.withColumn("block_no", index)
    full = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block))
    cut = (F.col("slot") == F.col("slots") - 1) & (F.col("rest") > 0)
    return each.withColumn("block_size", full).select("source_no", "slot", "shard", "block_no", F.when(cut, F.col("last_take")).otherwise(F.col("block_size")).alias("take"), "block_size")


class Mix:
    """A mix of ``docs``: its sources with targets, its slots, and what each document gives."""

    def __init__(self, docs: DataFrame, block: int = 128, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: int = 2, per_shard: int = 4096):
        self.block, self.seed = block, seed
        ws = Workspace(docs.sparkSession, "mix")
        self.sized = ws.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
        self.chunks = max(1, math.isqrt(self.sized.count()))
        sums = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = ws.write(targets(sums, weights, ratio, most), "sources")
        planned = plan_sources(self.sources, block, seed)
        words = self.sources.agg(F.sum("source_size")).first()[0] or 0
        parts = int(words * ratio / block / SLOTS_A_TASK) + 1
        planned = planned.withColumn("all_slots", F.sum("slots").over(W.partitionBy()))
        self.counts = ws.write(draw(planned, seed, per_shard, parts), "counts")
        self.slots = slots(self.counts, block, seed, parts)

    def positions(self) -> DataFrame:
        """Each document's first word in its source's pseudorandom order."""
        rows = self.sized.withColumn("mixed", F.xxhash64(F.lit(self.seed), "doc_id")).withColumn("chunk", F.pmod("mixed", F.lit(self.chunks)))
        sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
        before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)))
        named = self.sources.withColumnRenamed("source", "of_source")
        sums = sums.join(named, F.col("source").eqNullSafe(F.col("of_source")))
        sums = sums.select("of_source", F.col("chunk").alias("of_chunk"), "chunk_start", "source_no", "source_size", "target")
        order = W.partitionBy("source", "chunk").orderBy("mixed", "doc_id", "size")
        rows = rows.withColumn("row", F.row_number().over(order))
        rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("chunk") == F.col("of_chunk")))
        return rows.withColumn("first", F.col("chunk_start") + F.col("inside"))

    def blocks(self) -> DataFrame:
        """One row for each document and block that holds words of it (an empty one: null block)."""
        spans = F.when(F.col("size") > 0, F.expr(f"sequence(first div {self.block}, (first + size - 1) div {self.block})"))
        rows = self.positions().withColumn("block_no", F.explode_outer(spans))
        start = F.col("block_no") * self.block
        return rows.withColumn("low", F.greatest(F.col("first") - start, F.lit(0))).withColumn("high", F.least(F.col("first") + F.col("size") - start, F.lit(self.block)))

    def taken(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken`` for every document."""
        whole = F.col("take") == F.col("block_size")
        takes = self.slots.groupBy("source_no", "block_no").agg(F.count_if(whole).alias("full"), F.coalesce(F.max(F.when(~whole, F.col("take"))), F.lit(0)).alias("part"))
        # Slots come from a few exploded rows, so Spark takes them for a small table; never broadcast them.
        joined = self.blocks().join(takes.hint("merge"), ["source_no", "block_no"], "left")
        words = F.col("full") * (F.col("high") - F.col("low")) + F.greatest(F.least("high", "part") - F.col("low"), F.lit(0))
        keys = ["source_no", "chunk", "row", "doc_id", "source", "size", "source_size", "target"]
        return joined.groupBy(*keys).agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken")).drop("source_no", "chunk", "row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document; see ``Mix``."""
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The documents of the mix: each as often as it was taken whole, and once more by systematic rounding.

    What is left of ``taken`` over the size is a fraction of a copy.  The fractions of a source are
    added up, documents of like size together in pseudorandom order, and the document whose fraction passes
    the next half is taken once more, so the copies and words of a source stay at what the mix took.
    """
    ws = Workspace(docs.sparkSession, "mixed")
    plan = mix(docs, seed=seed, **options).where("size > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    plan = plan.withColumn("unit", F.greatest(F.col("rows") * F.col("size"), F.lit(1))).withColumn("whole", F.expr("taken div unit"))
    plan = plan.withColumn("part", F.expr(f"((taken - whole * unit) * {ONE}) div unit"))
    plan = plan.withColumn("mixed", F.xxhash64(F.lit(seed), "doc_id")).withColumn("alike", F.floor(F.log2(F.greatest("unit", F.lit(1))) * 8))
    plan = ws.write(plan, "plan")
    chunks = math.isqrt(plan.count()) // 16 + 1
    plan = plan.withColumn("chunk", F.pmod("mixed", F.lit(chunks)))
    sums = plan.groupBy("source", "alike", "chunk").agg(F.sum("part").alias("parts"))
    before = W.partitionBy("source").orderBy("alike", "chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of_source"), F.col("alike").alias("of_alike"), F.col("chunk").alias("of_chunk"), F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("parts_before"))
    order = W.partitionBy("source", "alike", "chunk").orderBy("unit", "mixed", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    plan = plan.withColumn("inside", F.sum("part").over(order))
    plan = plan.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("alike") == F.col("of_alike")) & (F.col("chunk") == F.col("of_chunk")))
    plan = plan.withColumn("upto", F.col("parts_before") + F.col("inside") + ONE // 2)
    plan = plan.withColumn("copies", F.expr(f"cast(whole + upto div {ONE} - (upto - part) div {ONE} as int)"))
    plan = plan.where("copies > 0").select("doc_id", "source", "size", "copies").alias("p")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (word_count(F.col("d.text")) == F.col("p.size"))
    whole = F.struct(*(F.col(f"d.`{c}`") for c in docs.columns))
    return d.join(plan, same).select(F.explode(F.array_repeat(whole, F.col("p.copies"))).alias("row")).select("row.*")
