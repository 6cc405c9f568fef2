"""Versioned table folders: each write is a new version, readers take the newest that is complete, old ones are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    jvm = spark.sparkContext._jvm
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def read_latest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version, or an empty table of ``schema``."""
    have = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v{have[-1]}") if have else spark.createDataFrame([], schema)


def write_version(df: DataFrame, root: str, keep: int = 5) -> int:
    """Write ``df`` as the next version and keep the ``keep`` newest; a version that fails leaves the old ones as they are."""
    spark = df.sparkSession
    have = versions(spark, root)
    n = have[-1] + 1 if have else 1
    df.write.mode("overwrite").parquet(f"{root}/v{n}")
    for old in have[: max(0, len(have) + 1 - keep)]:
        fs, at = _fs(spark, f"{root}/v{old}")
        fs.delete(at, True)
    return n
