"""The ``opN_*`` queries: every operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from siltstone.llm import bpe, classifier, lines, mixing, ngram_join, privacy, rules, unigram, urls, vectors
from siltstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed rules of the URL query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.QualityModel.fit(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    every = (
        op1_quality_classifier,
        op2_mix_sources,
        op3_bpe_codec,
        op4_personal_data,
        op5_ngram_join,
        op6_line_dedup,
        op7_url_filter,
        op8_token_counts,
        op9_embedding_near_dedup,
        op10_quality_rules,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL}


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
marks AS (SELECT doc_id, min(quality) AS mark FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, regexp_replace(host, ':[0-9]*\z', '') AS name, count(mark) AS n, count(*) FILTER (WHERE mark = 1) AS good
  FROM split LEFT JOIN marks ON page_id = doc_id GROUP BY host),
named AS (
  SELECT host, n, good, CASE WHEN regexp_matches(name, '^[0-9.]+\z') THEN name ELSE coalesce(nullif(
    regexp_extract(name, '(?:^|\.)([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))\z', 1), ''), name) END AS domain FROM counted),
hosts AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+\z') THEN domain ELSE coalesce(nullif(
    regexp_extract(domain, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*)\z', 1), ''), domain) END AS suffix FROM named),
levels AS (
  SELECT 'host' AS level, n, good FROM hosts
  UNION ALL SELECT 'domain', sum(n), sum(good) FROM hosts GROUP BY domain
  UNION ALL SELECT 'suffix', sum(n), sum(good) FROM hosts GROUP BY suffix),
sums AS (
  SELECT level, count(*) AS k, sum(n)::DOUBLE AS t, sum(good)::DOUBLE AS h, sum(n * n)::DOUBLE AS sq, sum(good * good / n) AS w
  FROM levels WHERE n > 0 GROUP BY level),
shares AS (
  SELECT level, CASE WHEN h > 0 AND h < t AND t - sq / t - (k - 1) > 0 THEN
      CASE WHEN (w - h * (h / t)) / ((h / t) * (1 - h / t)) - (k - 1) > 0
        THEN ((w - h * (h / t)) / ((h / t) * (1 - h / t)) - (k - 1)) / (t - sq / t - (k - 1)) ELSE 0 END END AS share
  FROM sums),
strengths AS (
  SELECT l.level, CASE WHEN share IS NULL THEN 10 WHEN share <= 0 THEN 1000 ELSE least(1000, greatest(1, 1 / share - 1)) END AS s
  FROM (VALUES ('host'), ('domain'), ('suffix')) l(level) LEFT JOIN shares USING (level)),
overall AS (
  SELECT (sum(good) + 1) / (sum(n) + 2)::DOUBLE AS rate, (SELECT s FROM strengths WHERE level = 'host') AS s_host,
    (SELECT s FROM strengths WHERE level = 'domain') AS s_domain, (SELECT s FROM strengths WHERE level = 'suffix') AS s_suffix
  FROM hosts),
top AS (
  SELECT suffix, (sum(good) + any_value(s_suffix) * any_value(rate)) / (sum(n) + any_value(s_suffix)) AS suffix_mean
  FROM hosts, overall GROUP BY suffix),
middle AS (
  SELECT domain, (sum(good) + any_value(s_domain) * any_value(suffix_mean)) / (sum(n) + any_value(s_domain)) AS domain_mean
  FROM hosts JOIN top USING (suffix), overall GROUP BY domain),
posteriors AS (
  SELECT host, n + s_host AS weight, (good + s_host * domain_mean) / (n + s_host) AS posterior
  FROM hosts JOIN middle USING (domain), overall),
bounded AS (SELECT *, posterior + 2 * sqrt(posterior * (1 - posterior) / (weight + 1)) AS bound FROM posteriors),
rules(rule, rule_host, rule_path, action) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fits AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(posterior, 6) AS posterior, round(bound, 6) AS bound
FROM split LEFT JOIN bounded USING (host) LEFT JOIN fits USING (host, path)
"""
