"""External model calls behind an interface, and what surrounds them: replies to records, checks, verdicts.

``ReplayExtractor`` answers from a table of recorded replies, so that everything can be run and
tested without a network.  Replies are parsed with every leaf as text and then coerced, since models
quote numbers at will; a reply without JSON gives no record.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.jsonx import recover_json
from parcelforge.functions.numbers import clean_text, to_float, to_int
from parcelforge.functions.text import subject_name


class Extractor(Protocol):
    """Adds ``reply`` to rows of ``request_key``."""

    def ask(self, requests: DataFrame) -> DataFrame: ...


class ReplayExtractor:
    """``replies``: request_key, response.  Requests without recorded reply get a null one and stay retryable."""

    def __init__(self, replies: DataFrame):
        self.replies = replies.groupBy("request_key").agg(F.max("response").alias("reply"))

    def ask(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.replies, "request_key", "left")


def fields_of(ddl: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in ddl.split(", ")]


def as_text_schema(ddl: str) -> str:
    return ", ".join(f"{n} STRING" for n, _ in fields_of(ddl))


def coerced(struct: Column, ddl: str) -> list[Column]:
    """The leaves of a struct of texts as the types of ``ddl``: text stripped and without null words, numbers out of pound signs and commas."""
    make = {"STRING": clean_text, "DOUBLE": to_float, "INT": to_int, "BOOLEAN": lambda c: F.lower(c).isin("true", "yes", "1")}
    return [make[t](struct[n]).alias(n) for n, t in fields_of(ddl)]


def records(replies: DataFrame, key: str, ddl: str, wrapper: str = "comparables") -> DataFrame:
    """(key, pos, fields of ``ddl``): one row per record of each reply, a bare list or one under ``wrapper``."""
    js = recover_json("reply")
    leaf = f"array<struct<{', '.join(f'{n}: string' for n, _ in fields_of(ddl))}>>"
    listed = F.from_json(F.when(F.left(js, F.lit(1)) == "[", js).otherwise(F.get_json_object(js, f"$.{wrapper}")), leaf)
    rows = replies.select(key, F.posexplode(listed).alias("pos", "r")).where("r is not null")
    return rows.select(key, "pos", *coerced(F.col("r"), ddl))


def single(replies: DataFrame, key: str, ddl: str) -> DataFrame:
    """(key, fields): the one object of each reply; replies without object are left out."""
    r = F.from_json(recover_json("reply"), f"struct<{', '.join(f'{n}: string' for n, _ in fields_of(ddl))}>")
    return replies.select(key, r.alias("r")).where("r is not null").select(key, *coerced(F.col("r"), ddl))


def indexed(replies: DataFrame, key: str, ddl: str, inputs: DataFrame) -> DataFrame:
    """Records that name their input by a number from 1, joined to ``inputs`` (key, pos from 0); numbers out of range are dropped."""
    named = records(replies, key, f"id INT, {ddl}", "results").drop("pos").withColumn("pos", F.col("id") - 1).drop("id")
    return named.join(inputs, [key, "pos"])


def judged(comps: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``comps`` (key, pos) without those whose verdict (key, pos from 1, verdict) is ``remove``; without verdicts all stay."""
    bad = verdicts.where(F.lower("verdict") == "remove").select(key, (F.col("pos") - 1).alias("pos")).distinct()
    return comps.join(bad, [key, "pos"], "left_anti")


def named_deals(deals: DataFrame, mails: DataFrame) -> DataFrame:
    """Deals with a blank name take one from their mail's subject."""
    m = mails.select("gmail_message_id", subject_name("subject").alias("_name"))
    return deals.join(m, "gmail_message_id", "left").withColumn("asset_name", F.coalesce(F.nullif("asset_name", F.lit("")), "_name")).drop("_name")
