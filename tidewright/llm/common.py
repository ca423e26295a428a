"""Shared plumbing of the text operators: the shared folder, written tables, worker state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by sessions of one machine that name no ``spark.checkpoint.dir`` (tests, notebooks).
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return LOCAL_SHARED


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor
    costs only the tasks that ran on it. ``drop`` frees what no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, part: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{part}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[part] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *parts: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for part in parts:
            if path := self.paths.pop(part, None):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True where labels must not be learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def inline_rows(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """A small driver-side table (size bounded by a parameter) as a literal relation."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")))
