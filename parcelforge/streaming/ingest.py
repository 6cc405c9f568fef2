"""The incremental pipeline as a stream: new messages through the ledger, each batch by the same functions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.operators.ledger import unseen, upsert
from parcelforge.sources.versions import read_latest, write_version

LEDGER = "gmail_message_id STRING, status STRING, seq BIGINT"


def ingest_batch(batch: DataFrame, ledger_root: str, seq: int) -> DataFrame:
    """Messages of a batch that the ledger does not hold, each id once; they are entered as processed."""
    spark = batch.sparkSession
    ledger = read_latest(spark, ledger_root, LEDGER)
    new = unseen(batch.dropDuplicates(["gmail_message_id"]), ledger, ["gmail_message_id"])
    entries = new.select("gmail_message_id", F.lit("processed").alias("status"), F.lit(seq).cast("bigint").alias("seq"))
    write_version(upsert(ledger, entries, ["gmail_message_id"]), ledger_root)
    return new


def run_stream(spark: SparkSession, source_dir: str, schema: str, ledger_root: str, out_dir: str, checkpoint: str):
    """A query that reads Parquet files as they arrive and appends the messages that are new; a batch that is run again changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        spark_ = batch.sparkSession
        done = read_latest(spark_, ledger_root, LEDGER)
        if done.where(F.col("seq") == number).limit(1).count():
            return
        new = unseen(batch.dropDuplicates(["gmail_message_id"]), done, ["gmail_message_id"])
        new.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")
        entries = spark_.read.schema(batch.schema).parquet(f"{out_dir}/batch={number}").select("gmail_message_id", F.lit("processed").alias("status"), F.lit(number).cast("bigint").alias("seq"))
        write_version(upsert(done, entries, ["gmail_message_id"]), ledger_root)

    stream = spark.readStream.schema(schema).parquet(source_dir)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thread_windows(mails: DataFrame, at: str, gap: str = "90 days", late: str = "30 days") -> DataFrame:
    """(thread_id, first, last, mails): sessions of a thread's mails; works on tables and on streams (late mails up to the watermark)."""
    return mails.withWatermark(at, late).groupBy("thread_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("mails")).select("thread_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "mails")
