"""Mails grouped into threads, threads into properties, and the best of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.dates import day_or
from parcelforge.functions.text import blank, subject_name
from parcelforge.operators.dedup import decide_deals
from parcelforge.runtime import cut

#: What attachments and mails weigh against a thousand letters of text.
MAIL_ATTACHMENT, THREAD_ATTACHMENT, THREAD_MAIL = 3, 5, 3


def one_delivery(mails: DataFrame) -> DataFrame:
    """Each message id once: the copy that sorts first."""
    cols = [c for c in mails.columns if c != "gmail_message_id"]
    return mails.where(~blank("gmail_message_id")).groupBy("gmail_message_id").agg(F.min(F.struct(*cols)).alias("m")).select("gmail_message_id", "m.*")


def thread_key() -> Column:
    return F.when(~blank("thread_id"), F.col("thread_id")).otherwise(F.col("gmail_message_id"))


def distinct_in_order(c: str) -> Column:
    return F.array_distinct(F.filter(F.col(c), lambda x: x.isNotNull()))


def group_threads(mails: DataFrame) -> DataFrame:
    """One row per thread (mails without thread are their own), in the order of ``date`` and message id: count, first and last date, last subject, distinct domains, attachments and keywords in order of appearance, flags."""
    rows = mails.withColumn("thread_id", thread_key())
    order = F.struct("date", "gmail_message_id")
    cells = F.struct("date", "gmail_message_id", "sender_domain", F.coalesce("attachment_names", F.array().cast("array<string>")).alias("files"), F.coalesce("matched_keywords", F.array().cast("array<string>")).alias("words"))
    chars = F.sum(F.coalesce(F.length("body_preview"), F.lit(0))) if "body_preview" in mails.columns else F.lit(0).cast("bigint")
    out = rows.groupBy("thread_id").agg(
        F.count("*").alias("email_count"), F.min_by("date", order).alias("earliest_date"), F.max_by("date", order).alias("latest_date"), F.max_by("subject", order).alias("latest_subject"),
        F.bool_or("matched_sender").alias("matched_sender"), F.bool_or("matched_label").alias("matched_label"), F.array_sort(F.collect_list(cells)).alias("m"), chars.alias("body_chars"),
    )
    return out.select(
        "thread_id", "email_count", "latest_date", "latest_subject", "earliest_date", F.array_distinct(F.filter(F.col("m.sender_domain"), lambda x: x.isNotNull())).alias("all_sender_domains"),
        F.array_distinct(F.flatten("m.files")).alias("all_attachment_names"), "matched_sender", "matched_label", F.array_distinct(F.flatten("m.words")).alias("matched_keywords"), "body_chars",
    )


def best_mails(mails: DataFrame) -> DataFrame:
    """(thread_id, gmail_message_id, score): the mail with most attachments and text of each thread, the first of equals."""
    score = F.greatest(F.coalesce(F.size("attachment_names"), F.lit(0)), F.lit(0)) * MAIL_ATTACHMENT + F.coalesce(F.length("body_preview"), F.lit(0)) / 1000
    rows = mails.select(thread_key().alias("thread_id"), "gmail_message_id", "date", score.alias("score"))
    best = rows.groupBy("thread_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "date", "gmail_message_id")).alias("b"))
    return best.select("thread_id", F.col("b.gmail_message_id").alias("gmail_message_id"), (-F.col("b.s")).alias("score"))


def mail_labels(mails: DataFrame) -> DataFrame:
    """(gmail_message_id, position, of, label): ``Email i of n`` in each thread, the first and last marked."""
    w = Window.partitionBy("thread_id").orderBy("date", "gmail_message_id")
    rows = mails.select(thread_key().alias("thread_id"), "gmail_message_id", "date").withColumns({"position": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy("thread_id"))})
    mark = F.when((F.col("position") == 1) & (F.col("of") > 1), " (oldest)").when((F.col("position") == F.col("of")) & (F.col("of") > 1), " (newest)").otherwise("")
    return rows.select("gmail_message_id", "position", "of", F.concat(F.lit("Email "), "position", F.lit(" of "), "of", mark).alias("label"))


def group_properties(threads: DataFrame) -> DataFrame:
    """(thread_id, group_id, is_winner, reason, also_introduced_by): threads (thread_id, pos, name, town, score, domains) that a leader's name matches.

    Threads come in the order of ``pos``, any ordered value; each joins its first leader, by ``reason`` (null for leaders); the richest thread wins, the first of equals.
    Winners tell the domains of the group's other threads, in their order, that are not their own; for the others the list is null.
    Matches are those of ``decide_deals``.
    """
    t = threads.select(F.col("pos").alias("id"), "name", "town", F.lit("").alias("postcode"))
    placed = cut(decide_deals(t).withColumnsRenamed({"id": "pos", "kept_id": "leader"}))
    lead = threads.select(F.col("pos").alias("leader"), F.col("thread_id").alias("group_id"))
    groups = threads.join(placed, "pos").join(lead, "leader")
    best = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), "pos"))
    groups = cut(groups.withColumn("is_winner", best == 1))
    # each domain of a group once, where it first comes among the threads that do not win
    said = groups.where("not is_winner").select("group_id", "pos", F.posexplode("domains").alias("k", "domain"))
    firsts = said.groupBy("group_id", "domain").agg(F.min(F.struct("pos", "k")).alias("at"))
    own = groups.where("is_winner").select("group_id", F.explode("domains").alias("domain"))
    others = firsts.join(own, ["group_id", "domain"], "left_anti").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("at", "domain"))).alias("d"))
    out = groups.join(others, "group_id", "left")
    also = F.when(F.col("is_winner"), F.coalesce(F.col("d.domain"), F.array().cast("array<string>")))
    return out.select("thread_id", "group_id", "is_winner", "reason", also.alias("also_introduced_by"))


def thread_score() -> Column:
    """Of a row of ``group_threads``: its attachments, mails and thousands of letters."""
    return F.size("all_attachment_names") * THREAD_ATTACHMENT + F.col("email_count") * THREAD_MAIL + F.col("body_chars") / 1000


def newest_first() -> Column:
    """Position of a thread among all, as an ordered value: by the day of its latest mail, newest first, then by id; threads without a readable day last."""
    day = F.coalesce(F.unix_date(day_or("latest_date", F.lit(None).cast("date"))), F.lit(-1_000_000))
    return F.struct((-day).alias("age"), "thread_id")


def asset_names(mails: DataFrame) -> DataFrame:
    return mails.select("gmail_message_id", subject_name("subject").alias("asset_name"))
