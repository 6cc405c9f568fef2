"""Session helpers shared by all operators: checkpoints and table loading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session (tests) uses a temporary folder of its own; on a cluster, where no machine's own folder would do, this is refused.
    """
    conf = spark.sparkContext.getConf()
    set_ = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    master = conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        return os.path.join(tempfile.gettempdir(), f"parcelforge-{os.getuid()}")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """``df`` unchanged, behind a node that projections are not merged across: what was computed so far is computed once, not once for every use."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


_written: list[tuple] = []


def _remove_written() -> None:
    """At the end of the session: the tables written by ``cut``."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112 - the session may be gone; the folder is the cluster's to clean
            continue
    _written.clear()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors never force a long recomputation, and readers take only the columns they need."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_remove_written)
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
