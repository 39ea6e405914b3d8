"""URL filters: allow and block rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix.  Each level is a
beta-binomial whose prior is centred on the level above (suffix on the overall rate, domain on its
suffix, host on its domain); the prior's strength is estimated from all groups of the
level by moments.  A host is blocked if even the upper bound of its posterior, the mean
plus ``z`` standard deviations, is under ``floor``.

The suffix of a host is its last label, or its last two where a country's label stands behind one of ``SECOND_LEVEL``; the
registered domain is one label more.  A port isn't part of either.  An address in numbers is its own domain and suffix.

Only built-in functions run.  The counts are aggregated before anything is joined, so a host
with a third of all pages is one row where it is joined; that join can be broadcast or split by Spark.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and
takes the verdict of the empty host; several labels of a page count as the lowest;
a host without labels takes its domain's reputation; rows with the same url get the same verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import lower_ascii

#: (rule, action): the host before the first slash, then the beginning of the path.
Rule = tuple[str, str]

#: Labels under which countries register domains, as in co.uk or com.au.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def split_url(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(after, r"^[^/?#]*", 0))
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def rule_columns(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, both null without one."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, slash, rest = text.partition("/")
        on_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = on_host & F.col("path").startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def suffix_pattern(second: Sequence[str] = SECOND_LEVEL) -> str:
    """A regular expression for the end of a name that nobody registers."""
    return rf"(?:(?:{'|'.join(second)})\.[a-z]{{2}}|[^.]*)"


def name_of(host: Column) -> Column:
    """The host without a port."""
    return F.regexp_replace(host, r":[0-9]*\z", "")


def _ending(name: Column, pattern: str) -> Column:
    found = F.regexp_extract(name, rf"(?:^|\.)({pattern})\z", 1)
    return F.when(name.rlike(r"^[0-9.]+\z") | (found == ""), name).otherwise(found)


def suffix_of(name: Column) -> Column:
    """What follows the registered label."""
    return _ending(name, suffix_pattern())


def domain_of(name: Column) -> Column:
    """The registered domain: the suffix and a label before it."""
    return _ending(name, rf"[^.]+\.{suffix_pattern()}")


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: prior strength of the level by the method of moments, within [1, 1000]."""
    used = groups.where(F.col("n") > 0)
    sums = used.agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum("good").alias("hits"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("within"),
    )
    rate = F.col("hits") / F.col("total")
    excess = (F.col("within") - F.col("hits") * rate) / (rate * (1 - rate)) - (F.col("k") - 1)
    room = F.col("total") - F.col("squares") / F.col("total") - (F.col("k") - 1)
    usable = (F.col("total") > 0) & (F.col("hits") > 0) & (F.col("hits") < F.col("total")) & (room > 0)
    share = F.when(usable, F.when(excess > 0, excess / room).otherwise(F.lit(0.0)))
    strength = F.when(share <= 0, F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / share - 1)))
    return sums.select(F.coalesce(strength, F.lit(10.0)).alias(f"strength_{level}"))


def reputation(pages: DataFrame, labels: DataFrame, z: float = 2.0) -> DataFrame:
    """``host, n, good, posterior, bound`` for every host of ``pages`` (with ``host`` and ``page_id``)."""
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").alias("mark_id")).agg(F.min("quality").alias("mark"))
    counted = pages.select("page_id", "host").join(marks, F.col("page_id") == F.col("mark_id"), "left")
    hosts = counted.groupBy("host").agg(F.count("mark").alias("n"), F.coalesce(F.sum((F.col("mark") == 1).cast("long")), F.lit(0)).alias("good"))
    hosts = hosts.withColumn("domain", domain_of(name_of(F.col("host")))).withColumn("suffix", suffix_of(F.col("domain")))
    up = lambda key: hosts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains, suffixes = up("domain"), up("suffix")
    overall = hosts.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("rate"))
    known = overall.crossJoin(_strength(suffixes, "suffix")).crossJoin(_strength(domains, "domain")).crossJoin(_strength(hosts, "host"))
    top = suffixes.crossJoin(F.broadcast(known)).select(  # one row
        F.col("suffix").alias("of_suffix"), "strength_domain", "strength_host",
        ((F.col("good") + F.col("strength_suffix") * F.col("rate")) / (F.col("n") + F.col("strength_suffix"))).alias("suffix_mean"),
    )
    middle = domains.withColumn("of_suffix", suffix_of(F.col("domain"))).join(top, "of_suffix").select(
        F.col("domain").alias("of_domain"), "strength_host",
        ((F.col("good") + F.col("strength_domain") * F.col("suffix_mean")) / (F.col("n") + F.col("strength_domain"))).alias("domain_mean"),
    )
    weight = F.col("n") + F.col("strength_host")
    mean = (F.col("good") + F.col("strength_host") * F.col("domain_mean")) / weight
    out = hosts.join(middle, F.col("domain") == F.col("of_domain")).withColumn("weight", weight).withColumn("posterior", mean)
    bound = F.col("posterior") + z * F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("weight") + 1))
    return out.select("host", "n", "good", "posterior", bound.alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], floor: float = 0.5, z: float = 2.0) -> DataFrame:
    """Verdict on every row of ``pages(page_id, url)``; ``labels(doc_id, quality)`` judge pages by id."""
    cut = split_url(pages.select("page_id", "url"))
    hosts = reputation(cut, labels, z).withColumnRenamed("host", "of_host")
    rule, action = rule_columns(rules)
    own = F.when(F.col("bound") < floor, F.lit("block")).otherwise(F.lit("allow"))
    return cut.join(hosts, F.col("host") == F.col("of_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
        F.round("posterior", 6).alias("posterior"), F.round("bound", 6).alias("bound"),
    )
