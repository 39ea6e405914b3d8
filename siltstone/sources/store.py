"""Chunk tables: schema, files, and upserts by a versioned rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("filing_date", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
METADATA = ("company", "filing_date", "section", "chunk_index", "total_chunks")
REPLACED = ("text", "embedding")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", metadata: tuple[str, ...] = METADATA, replaced: tuple[str, ...] = REPLACED) -> DataFrame:
    """Rows of both; where ids meet, the oldest metadata stays and the newest content counts.

    ``new`` may hold an id several times if it has an ``arrival`` number; old rows come first.
    """
    order = F.col("arrival") if "arrival" in new.columns else F.lit(1)
    columns = [key, *metadata, *replaced]
    both = old.select(*columns, F.lit(0).cast("long").alias("_at")).unionByName(new.select(*columns, order.cast("long").alias("_at")))
    merged = both.groupBy(key).agg(F.min_by(F.struct(*metadata), "_at").alias("m"), F.max_by(F.struct(*replaced), "_at").alias("r"))
    return merged.select(key, *(F.col(f"m.{c}") for c in metadata), *(F.col(f"r.{c}") for c in replaced))


class VersionedTable:
    """A Parquet table whose versions are folders; a version counts once its writing ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def write(self, df: DataFrame) -> None:
        last = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{last[-1] + 1 if last else 0}")

    def upsert(self, new: DataFrame, **options) -> None:
        old = self.read()
        self.write(upsert(new.limit(0) if old is None else old, new, **options))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHUNKS) -> DataFrame:
    """JSON lines with a known schema; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_chunks(chunked: DataFrame, folder: str) -> None:
    """Both layouts: a folder for each company, and all chunks together."""
    chunked.withColumn("_company", F.col("company")).write.partitionBy("_company").json(f"{folder}/by_company")
    chunked.write.json(f"{folder}/all")


def read_raw(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, raw``: files as UTF-8 text without their invalid bytes."""

    @F.udf("string")  # one call a file
    def decoded(content):
        return bytes(content).decode("utf-8", "ignore")

    return spark.read.format("binaryFile").load(pattern).select("path", decoded("content").alias("raw"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a gold file, one row each."""
    return read_json(spark, path).select(F.explode("questions").alias("q")).select("q.*")
