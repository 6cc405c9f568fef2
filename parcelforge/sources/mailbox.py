"""Mailbox dumps as a data source: JSON-lines files of messages, one partition per file, dates and labels pushed down."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, InputPartition, LessThan

MESSAGE = "id STRING, thread_id STRING, received_ms BIGINT, day STRING, label STRING, payload STRING"


class MailboxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tests = options["path"], []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (GreaterThan, LessThan, EqualTo)) and f.attribute in (("day",), ("label",)):
                self.tests.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.jsonl"))] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                try:
                    m = json.loads(line)
                except ValueError:
                    continue
                ms = int(m.get("internalDate") or 0)
                day = datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d")
                for label in m.get("labelIds") or [None]:
                    row = {"day": day, "label": label}
                    if all(row[a] is not None and (row[a] > v if t == "GreaterThan" else row[a] < v if t == "LessThan" else row[a] == v) for t, a, v in self.tests):
                        yield m.get("id"), m.get("threadId"), ms, day, label, json.dumps(m.get("payload") or {})


class Mailbox(DataSource):
    """``spark.read.format("mailbox").option("path", dir)``: one row per message and label."""

    @classmethod
    def name(cls):
        return "mailbox"

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return MailboxReader(self.options)


def scan(spark: SparkSession, path: str, after: str | None = None, before: str | None = None, label: str | None = None) -> DataFrame:
    """Messages of a dump between two days (both exclusive), labelled ones first, each id once with ``labelled``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mailbox)
    df = spark.read.format("mailbox").option("path", path).load()
    if after:
        df = df.where(F.col("day") > after)
    if before:
        df = df.where(F.col("day") < before)
    hit = F.coalesce(F.col("label") == label, F.lit(False)) if label else F.lit(False)
    one = df.groupBy("id").agg(F.min(F.struct("received_ms", "thread_id", "payload")).alias("m"), F.bool_or(hit).alias("labelled"))
    return one.select("id", "m.thread_id", "m.received_ms", "m.payload", "labelled")


def capped(found: DataFrame, most: int) -> DataFrame:
    """The scan's result where each of the two searches, for the label and for everything, gives ``most`` messages at most, the newest: labelled ones first, then by age, each once with its ``position``."""
    newest = lambda d: d.orderBy(F.desc("received_ms"), "id").limit(most)
    rows = newest(found.where("labelled")).withColumn("_source", F.lit(0)).unionByName(newest(found).withColumn("_source", F.lit(1)))
    once = rows.groupBy("id").agg(F.min("_source").alias("_source")).join(rows, ["id", "_source"])
    # at most twice ``most`` rows
    return once.withColumn("position", F.row_number().over(Window.orderBy("_source", F.desc("received_ms"), "id"))).drop("_source")


def query_text(after: str | None, before: str | None, label: str | None) -> str:
    """The search text of a mail service for the same filter."""
    parts = [("after", after), ("before", before), ("label", label and label.replace(" ", "-"))]
    return " ".join(f"{k}:{v}" for k, v in parts if v)
