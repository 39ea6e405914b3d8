"""Build a chunk table from filings: fetch, parse, chunk, embed, upsert, report.

python -m siltstone.cli all --out data --agent "Name name@example.com"
python -m siltstone.cli all --skip-fetch --manifest manifest.json --out data
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import chunking, sections, vector
from siltstone.sources import fetch, filings, store

STEPS = ("fetch", "parse", "chunk", "ingest", "all")


def parse(spark: SparkSession, manifest: str, out: str) -> DataFrame:
    listed = store.read_json(spark, manifest)
    raw = store.read_raw(spark, f"{out}/raw/*").withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    texts = filings.parse_manifest(listed, raw)
    found = sections.extract_sections(texts, sections.ANNUAL_REPORT, ("company", "filing_date", "source_file"))
    found.write.mode("overwrite").parquet(f"{out}/sections")
    return spark.read.parquet(f"{out}/sections")


def chunk(spark: SparkSession, out: str, size: int, overlap: int) -> DataFrame:
    found = spark.read.parquet(f"{out}/sections")
    chunking.chunks(found, ("company", "filing_date", "section"), size=size, overlap=overlap).write.mode("overwrite").parquet(f"{out}/chunks")
    return spark.read.parquet(f"{out}/chunks")


def ingest(spark: SparkSession, out: str) -> DataFrame:
    chunked = vector.embed(spark.read.parquet(f"{out}/chunks"), vector.hashed_embedder())
    table = store.VersionedTable(spark, f"{out}/table")
    table.upsert(chunked)
    return table.read()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--manifest", help="default: manifest.json in the output folder")
    p.add_argument("--skip-fetch", action="store_true")
    p.add_argument("--agent", default="siltstone", help="how requests name their user")
    p.add_argument("--out", default="data")
    p.add_argument("--chunk-size", type=int, default=chunking.SIZE)
    p.add_argument("--overlap", type=int, default=chunking.OVERLAP)
    own = p.parse_args(args)
    if own.step == "fetch" or own.step == "all" and not own.skip_fetch:
        fetch.fetch_companies(fetch.http_get(own.agent), own.out)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    if own.step in ("parse", "all"):
        parse(spark, own.manifest or f"{own.out}/manifest.json", own.out)
    if own.step in ("chunk", "all"):
        chunking.chunk_stats(chunk(spark, own.out, own.chunk_size, own.overlap)).orderBy("company", "section").show(200)
    if own.step in ("ingest", "all"):
        ingest(spark, own.out).groupBy("company", "section").count().orderBy("company", "section").show(200)


if __name__ == "__main__":
    main()
