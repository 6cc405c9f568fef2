"""The whole flow as functions over tables: messages to records, records to clean tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge import extract, schemas
from parcelforge.operators import clean, dedup, greedy, ledger, threads
from parcelforge.runtime import cut


def introductions(mails: DataFrame, done: DataFrame, classifier: extract.Extractor) -> DataFrame:
    """New messages that a label or the classifier calls introductions, with their thread's position.

    Labelled messages skip the classifier; messages that it did not answer stay out of the ledger and are asked again.
    """
    new = threads.one_delivery(ledger.unseen(mails, done, ["gmail_message_id"]))
    labelled = new.where("matched_label").withColumns({"is_introduction": F.lit(True), "confidence": F.lit(1.0)})
    asked = new.where("not coalesce(matched_label, false)")
    replies = classifier.ask(asked.select(F.col("gmail_message_id").alias("request_key")))
    ddl = schemas.CLASSIFICATION.removeprefix("gmail_message_id STRING, ")
    judged = extract.single(replies, "request_key", ddl).select(F.col("request_key").alias("gmail_message_id"), "is_introduction", "confidence")
    return labelled.unionByName(asked.join(judged, "gmail_message_id")).where("is_introduction")


def deals_of(mails: DataFrame, extractor: extract.Extractor) -> DataFrame:
    """Deals of the best message of each thread; names missing in the reply come from the subject."""
    best = threads.best_mails(mails).select("thread_id", "gmail_message_id")
    replies = extractor.ask(best.select(F.col("gmail_message_id").alias("request_key")))
    deals = extract.records(replies, "request_key", schemas.DEAL, "deals").withColumnRenamed("request_key", "gmail_message_id")
    return extract.named_deals(deals, mails)


def distinct_deals(deals: DataFrame) -> DataFrame:
    """(deal_id, kept_id, reason): deals of one run that match an earlier one by name, town and postcode go."""
    d = deals.select(F.col("deal_id").alias("id"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("asset_name", "name"), ("town", "town"), ("postcode", "postcode"))))
    return dedup.decide_deals(d).select(F.col("id").alias("deal_id"), "kept_id", "reason")


def clean_tables(occupational: DataFrame, investment: DataFrame, places: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Deduplicated, merged and cleaned tables and the summaries of what was done."""
    decided = cut(dedup.dedup_lettings(occupational))
    kept = greedy.fill_blanks(occupational, decided.select("id", "kept_id"), dedup.LETTING_FIELDS, "last")
    stays = decided.where("id = kept_id and not (is_vacant or is_investment or no_rent)").select("id")
    others = [c for c in occupational.columns if c not in dedup.LETTING_FIELDS and c != "id"]
    merged = kept.drop("merged").join(stays, "id", "left_semi").join(occupational.select("id", *others), "id").select(*occupational.columns)
    cleaned = clean.clean_occupational(merged, places, as_of)
    return {"lettings": clean.lettings_only(cleaned), "investments": clean.clean_investment(investment), "dedup": dedup.dedup_summary(decided), "counts": clean.filter_counts(cleaned)}
