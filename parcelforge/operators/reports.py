"""Counts and lists that a run shows at its end, as small tables; texts of lines are cut for display only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.dates import shown_date

#: Errors that a report shows.
SHOWN_ERRORS = 10
#: Counters of a run, in the order of the report.
COUNTERS = ["threads_processed", "successfully_processed", "introductions", "not_introductions", "pipeline_rows_added", "archived", "brochures_parsed", "investment_comps_added", "occupational_comps_added", "errors"]


def run_report(results: DataFrame) -> DataFrame:
    """One row of a run's counters, with the first ``SHOWN_ERRORS`` messages (by thread) and how many more there are.

    ``results``: thread_id, status, is_introduction, pipeline_rows_added, archived, brochures_parsed, investment_comps, occupational_comps, error_message; a row per thread.
    """
    bad = F.col("status") == "error"
    said = results.where(bad).where(F.coalesce(F.col("error_message"), F.lit("")) != "").orderBy("thread_id").limit(SHOWN_ERRORS)
    said = said.agg(F.transform(F.array_sort(F.collect_list(F.struct("thread_id", "error_message"))), lambda x: x["error_message"]).alias("error_details"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counts = results.agg(
        F.count("*").alias("threads_processed"), F.count_if(F.col("status") == "processed").alias("successfully_processed"), F.count_if(F.coalesce("is_introduction", F.lit(False))).alias("introductions"),
        F.count_if(~F.coalesce("is_introduction", F.lit(False))).alias("not_introductions"), total("pipeline_rows_added").alias("pipeline_rows_added"), total("archived").alias("archived"), total("brochures_parsed").alias("brochures_parsed"),
        total("investment_comps").alias("investment_comps_added"), total("occupational_comps").alias("occupational_comps_added"), F.count_if(bad).alias("errors"),
    )
    # one row each
    out = counts.withColumn("_k", F.lit(0)).join(said.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return out.withColumn("more_errors", F.greatest(F.col("errors") - SHOWN_ERRORS, F.lit(0)))


def report_lines(report: DataFrame) -> list[str]:
    """The report as lines of text."""
    r = report.first()
    out = ["Run report", "-" * 40, *(f"{c.replace('_', ' '):<28}{r[c]:>10}" for c in COUNTERS)]
    out += [f"  - {m}" for m in r["error_details"]]
    return out + ([f"  and {r['more_errors']} more"] if r["more_errors"] else [])


def action_counts(decided: DataFrame) -> DataFrame:
    """(action, rows) of what an insert did."""
    return decided.groupBy("action").agg(F.count("*").alias("rows"))


def cut_short(c: str, most: int) -> Column:
    """At most ``most`` letters, the last two replaced by dots where something is lost."""
    return F.when(F.length(c) > most, F.concat(F.left(F.col(c), F.lit(most - 2)), F.lit(".."))).otherwise(F.col(c))


def scan_table(mails: DataFrame) -> DataFrame:
    """Mails as a scan shows them: day, sender and subject cut short, files, and why they were found."""
    kw = F.concat(F.lit("kw:"), F.array_join(F.slice("matched_keywords", 1, 3), ","))
    why = F.array_compact(F.array(F.when(F.col("matched_label"), F.lit("label")), F.when(F.col("matched_sender"), F.lit("sender")), F.when(F.size("matched_keywords") > 0, kw)))
    files = F.when(F.size("attachment_names") > 0, F.left(F.array_join("attachment_names", ", "), F.lit(18))).otherwise("-")
    return mails.select(
        "gmail_message_id", shown_date("date").alias("day"), cut_short("sender", 35).alias("sender"), cut_short("subject", 50).alias("subject"), files.alias("files"), F.when(F.size(why) > 0, F.array_join(why, " + ")).otherwise("query").alias("reason")
    )


def newest_threads(threads: DataFrame) -> DataFrame:
    """Threads in the order of their latest date's text, newest first, then by id."""
    return threads.orderBy(F.desc_nulls_last("latest_date"), "thread_id")


def without_pipeline_rows(sheet: DataFrame) -> DataFrame:
    """The rows (row, address, date) of a sheet before the first that has an address but no date: that one and all behind it were written by an earlier run."""
    blank_ = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    first = sheet.where(~blank_("address") & blank_("date")).agg(F.min("row").alias("_first"))
    return sheet.join(F.broadcast(first), F.coalesce(F.col("row") < F.col("_first"), F.lit(True))).drop("_first")  # one row is broadcast


def better_folder(new: Column, old: Column) -> Column:
    """Whether a folder's new name tells more: it is longer, or gains a town."""
    return (new != "") & (new != old) & ((F.length(new) > F.length(old)) | (F.contains(new, F.lit(",")) & ~F.contains(old, F.lit(","))))


def renames(folders: DataFrame) -> DataFrame:
    """(folder, ideal): folders (folder, ideal) that get a better name which none has yet; where several want it, the first by name."""
    want = folders.where(better_folder(F.col("ideal"), F.col("folder"))).groupBy("ideal").agg(F.min("folder").alias("folder"))
    return want.join(folders.select(F.col("folder").alias("ideal")).distinct(), "ideal", "left_anti").select("folder", "ideal")


def batches_of(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """``rows`` with ``batch``, of ``most`` rows at most: what is asked of a model in one request."""
    from pyspark.sql import Window

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return rows.withColumn("_part", part).withColumn("batch", F.concat_ws("-", F.col("_part"), F.floor((rank - 1) / most))).drop("_part")
