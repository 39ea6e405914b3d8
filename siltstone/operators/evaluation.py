"""Measuring retrieval: hits, first ranks, means by tag, diagnostics and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE
from siltstone.operators import fusion
from siltstone.sources.workspace import Workspace

NORMAL, IMPOSSIBLE = "normal", "retrieval-impossible"
CHANNELS = ("bm25", "vector", "fused")
#: Words of a run that names the texts to read for a passage.
RUN = 3


def word_runs(df: DataFrame, words: str) -> DataFrame:
    """A row for every ``RUN`` words in a row, with their hash as ``run``; hashed after the explode, where code is generated for it."""
    each = df.where(F.size(words) >= RUN).select("*", F.explode(F.sequence(F.lit(0), F.size(words) - RUN)).alias("at"))
    return each.select("*", F.xxhash64(*(F.get(words, F.col("at") + i) for i in range(RUN))).alias("run"))


def held_passages(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id`` of ``passages(query_id, query)`` beside the documents that hold the passage verbatim.

    The inner words of a passage are whole words of each text that holds it, so a run of them, the longest, names the texts
    that are read for it.  Passages without such a run are looked for in every text.  Rows repeat where runs do.
    """
    words, inner = f"{SPACE}+", F.slice("words", 2, F.greatest(F.lit(0), F.size("words") - 2))
    asked = passages.select("query_id", "query", F.split("query", words).alias("words"))
    length = sum((F.length(F.get("inner", F.col("at") + i)) for i in range(RUN)), F.lit(0))
    runs = word_runs(asked.withColumn("inner", inner), "inner").groupBy("query_id", "query").agg(F.max_by("run", F.struct(length, "run")).alias("run"))
    found = word_runs(docs.withColumn("words", F.split("text", words)), "words").drop("words", "at").join(F.broadcast(runs), "run")
    found = found.where(F.contains("text", "query")).drop("run")
    short = asked.where(F.size("words") < RUN + 2).drop("words")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(F.broadcast(short), F.contains(F.col("text"), F.col("query"))))


def gold_from_passages(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Questions from ``passages(query_id, query)``: the target is the company and section of the first document
    that holds the passage verbatim; without one the question is impossible.  Stored, as evaluations read it several times."""
    held = held_passages(passages, docs.select("doc_id", "company", "section", "text"))
    first = held.groupBy("query_id").agg(F.min_by(F.struct("company", "section"), "doc_id").alias("t"))
    tagged = passages.join(first, "query_id", "left")
    tag = F.when(F.col("t").isNull(), IMPOSSIBLE).otherwise(NORMAL)
    gold = tagged.select("query_id", F.col("t.company").alias("target_company"), F.col("t.section").alias("target_section"), tag.alias("tag"))
    return Workspace(docs.sparkSession, "gold").write(gold, "gold")


def first_hits(results: DataFrame, gold: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, first_rank``: rank of the first result of the target's company and section."""
    found = results.select("query_id", "doc_id", "rank").join(docs.select("doc_id", "company", "section"), "doc_id")
    hit = (F.col("company") == F.col("target_company")) & (F.col("section") == F.col("target_section"))
    return found.join(gold, "query_id").where(hit).groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def evaluate(bm25: DataFrame, vector: DataFrame, gold: DataFrame, docs: DataFrame, k: int = 5, candidate_k: int = 20) -> DataFrame:
    """One row a question: hit flags within k and first ranks of each channel.

    Fusion goes as deep as the candidate lists, so ranks beyond k are seen.
    """
    fused = fusion.reciprocal_rank_fusion(bm25, vector, max(k, candidate_k))
    out = gold
    for name, results in zip(CHANNELS, (bm25, vector, fused)):
        ranks = first_hits(results, gold, docs).withColumnRenamed("first_rank", f"rank_{name}")
        out = out.join(ranks, "query_id", "left").withColumn(f"hit_{name}", F.coalesce((F.col(f"rank_{name}") <= k).cast("int"), F.lit(0)))
    return out


def mean_hit(hit: Column) -> Column:
    return F.coalesce(F.round(F.avg(hit), 4), F.lit(0.0))


def summary(results: DataFrame) -> DataFrame:
    """One row: counts by tag and mean hits by channel for normal, impossible and all questions."""
    out = [F.count("*").alias("n_total"), F.count_if(F.col("tag") == NORMAL).alias("n_normal"), F.count_if(F.col("tag") == IMPOSSIBLE).alias("n_impossible")]
    for part, rows in (("normal", F.col("tag") == NORMAL), ("impossible", F.col("tag") == IMPOSSIBLE), ("all", F.lit(True))):
        out += [mean_hit(F.when(rows, F.col(f"hit_{c}"))).alias(f"{part}_{c}") for c in CHANNELS]
    return results.agg(*out)


def summary_json(results: DataFrame, **settings: int) -> DataFrame:
    """One JSON text: settings and counts, means of each part, and all questions, for a text sink."""
    one = summary(results)
    meta = F.struct(*(F.lit(v).alias(k) for k, v in settings.items()), "n_total", "n_normal", "n_impossible")
    parts = [F.struct(*(F.col(f"{p}_{c}").alias(c) for c in CHANNELS)).alias(p) for p in ("normal", "impossible", "all")]
    rows = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("per_question"))  # a gold set is small
    return one.crossJoin(rows).select(F.to_json(F.struct(meta.alias("run_meta"), *parts, "per_question")).alias("value"))


def by_tag(results: DataFrame) -> DataFrame:
    """Mean hits of each tag and of all (null tag) in one pass."""
    return results.rollup("tag").agg(F.count("*").alias("n"), *(mean_hit(F.col(f"hit_{c}")).alias(c) for c in CHANNELS))


def false_positive_rate(results: DataFrame, gold: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """For each document ever returned: the share of questions it answers wrongly among those it is no answer to."""
    shown = results.where(F.col("rank") <= k).select("query_id", "doc_id").join(docs.select("doc_id", "company", "section"), "doc_id")
    joined = shown.join(gold, "query_id")
    right = F.coalesce((F.col("company") == F.col("target_company")) & (F.col("section") == F.col("target_section")), F.lit(False))
    wrong = joined.groupBy("doc_id", "company", "section").agg(F.count_if(~right).alias("wrong"))
    targets = gold.where("target_company is not null").groupBy("target_company", "target_section").agg(F.count("*").alias("own"))
    total = gold.agg(F.count("*").alias("questions"))
    same = (F.col("company") == F.col("target_company")) & (F.col("section") == F.col("target_section"))
    rated = wrong.join(targets, same, "left").crossJoin(F.broadcast(total))  # one row
    others = F.col("questions") - F.coalesce("own", F.lit(0))
    return rated.select("doc_id", "wrong", others.alias("others"), F.coalesce(F.round(F.col("wrong") / F.when(others > 0, others), 6), F.lit(0.0)).alias("fp_rate"))


def diagnostic(channels: dict[str, DataFrame], gold: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, channel, results, target_ranks``: where each channel has the target."""
    out = None
    for name, results in channels.items():
        found = results.select("query_id", "doc_id", "rank").join(docs.select("doc_id", "company", "section"), "doc_id").join(gold, "query_id")
        hit = F.coalesce((F.col("company") == F.col("target_company")) & (F.col("section") == F.col("target_section")), F.lit(False))
        part = found.groupBy("query_id").agg(F.count("*").alias("results"), F.array_sort(F.collect_list(F.when(hit, F.col("rank")))).alias("target_ranks"))
        part = part.withColumn("channel", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranks and hits of two runs side by side, with the change of each hit."""
    a, b = before.alias("a"), after.alias("b")
    out = [F.col("query_id")]
    for c in CHANNELS:
        out += [F.col(f"a.rank_{c}").alias(f"before_{c}"), F.col(f"b.rank_{c}").alias(f"after_{c}"), (F.col(f"b.hit_{c}") - F.col(f"a.hit_{c}")).alias(f"change_{c}")]
    return a.join(b, "query_id", "full_outer").select(*out)
