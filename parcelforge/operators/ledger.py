"""Tables that remember what was processed: incremental filters, upserts, audit rows, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a processed message.
STATES = ["pending", "classified", "processed", "skipped", "error"]


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the ledger; rows with a null key are kept."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``; whole rows replace each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` put in: rows of equal key replace the old ones; of several new ones the last by ``seq`` wins.  ``seq`` of old rows counts as lowest."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc("_new"), F.desc("seq")]).drop("_new")


def unique_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key; rows with a null in the key never collide."""
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    return latest(rows.where(~nulls), keys, order).unionByName(rows.where(nulls))


def audit(before: DataFrame, after: DataFrame, key: str, fields: list[str], action: str, at: str) -> DataFrame:
    """(timestamp, action, key, field_name, old_value, new_value): one row per cell that was blank and is filled."""
    both = after.join(before.select(key, *(F.col(f).alias(f"{f}_0") for f in fields)), key)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = F.array(*(F.when((F.trim(text(f"{f}_0")) == "") & (F.trim(text(f)) != ""), F.struct(F.lit(f).alias("field_name"), text(f"{f}_0").alias("old_value"), text(f).alias("new_value"))) for f in fields))
    return both.select(F.lit(at).alias("timestamp"), F.lit(action).alias("action"), key, F.inline(F.array_compact(cells)))


def processing_stats(ledger: DataFrame) -> DataFrame:
    """One row of counts of a ledger with status, is_introduction and pipeline_row_added."""
    return ledger.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("is_introduction", F.lit(False))).alias("introductions"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.coalesce("pipeline_row_added", F.lit(False))).alias("pipeline_rows"),
    )


def recent(rows: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """The last ``n`` rows: a top-k report."""
    return rows.orderBy(*order).limit(n)


def first_by_file(files: DataFrame) -> DataFrame:
    """(name, size, path, deals, label): files of equal name and size once, the first path kept, with the deals they came from and ``(+n more)``."""
    out = files.groupBy("name", "size").agg(F.min("path").alias("path"), F.min_by("deal", "path").alias("deal"), F.array_sort(F.collect_set("deal")).alias("deals"))
    more = F.size("deals") - 1
    return out.select("name", "size", "path", "deals", F.when(more > 0, F.concat("deal", F.lit(" (+"), more, F.lit(" more)"))).otherwise(F.col("deal")).alias("label"))


def numbered(rows: DataFrame, folder: str, name: str, order: list[Column], suffixed: bool = True) -> DataFrame:
    """``rows`` with ``free_name``: equal names in a folder get `` (2)``, `` (3)`` before the suffix, or behind names that have none."""
    n = F.row_number().over(Window.partitionBy(folder, F.lower(name)).orderBy(*order))
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1) if suffixed else F.lit("")
    stem = F.left(F.col(name), F.length(name) - F.length(suffix))
    return rows.withColumn("_n", n).withColumn("free_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n"), F.lit(")"), suffix))).drop("_n")


def visits(rows: DataFrame, key: str, day: str, gap_days: int = 90) -> DataFrame:
    """``rows`` with ``visit``: a new one where more than ``gap_days`` lie since the key's day before."""
    w = Window.partitionBy(key).orderBy(day, *[c for c in ("row_id",) if c in rows.columns])
    new = F.coalesce(F.date_diff(F.col(day), F.lag(day).over(w)) > gap_days, F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn("visit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_sides(mail: DataFrame, brochure: DataFrame, key: str) -> DataFrame:
    """One deal of a mail's and a brochure's: the mail's date, agent and name (the brochure's name where the mail's is a stub), otherwise the brochure's values, each where it holds one; zero and '' hold nothing."""
    b = brochure.select(key, *(F.col(c).alias(f"{c}_b") for c in brochure.columns if c != key))
    both = mail.join(b, key)
    text = ["country", "town", "address", "postcode", "classification"]
    number = ["area_acres", "area_sqft", "rent_pa", "rent_psf", "asking_price", "net_yield", "reversionary_yield", "capval_psf"]
    some = lambda c, none: F.nullif(F.col(c), F.lit(none))
    stub = F.coalesce(F.col("raw_source") == "stub_from_subject", F.lit(False))
    name = F.coalesce(F.when(stub, some("asset_name_b", "")), some("asset_name", ""), some("asset_name_b", ""))
    return both.select(
        key, "date", "agent", name.alias("asset_name"), *(F.coalesce(some(f"{c}_b", ""), some(c, "")).alias(c) for c in text),
        *(F.coalesce(some(f"{c}_b", 0.0), some(c, 0.0)).alias(c) for c in number), F.greatest("confidence", "confidence_b").alias("confidence"), F.lit("merged").alias("raw_source"),
    )


#: Likeness of two folder names of one town.
FOLDER = 0.7


def folder_lookup(deals: DataFrame, folders: DataFrame) -> DataFrame:
    """(deal_id, folder, how): the archive folder of each deal: equal name, else equal postcode, else the most alike name of its town (``FOLDER`` or more), else the newest of its quarter folders.

    ``deals``: deal_id, folder_name, town, postcode.  ``folders``: folder, town, postcode and, if known, ``latest``, the day of its
    newest subfolder.  Quarter marks are left out where names are compared.  Each name is compared once, however many deals have it.
    """
    from parcelforge.functions.text import without_quarter
    from parcelforge.operators.blocking import alike
    from parcelforge.runtime import cut

    key = lambda c: F.lower(F.trim(c))
    if "latest" not in folders.columns:
        folders = folders.withColumn("latest", F.lit(None).cast("date"))
    f = cut(folders.select("folder", key("folder").alias("fk"), key(without_quarter("folder")).alias("nk"), without_quarter("folder").alias("base"), key("town").alias("tk"), F.upper(F.trim("postcode")).alias("pk"), "latest"))
    d = cut(deals.select("deal_id", F.trim("folder_name").alias("name"), key("folder_name").alias("dk"), key("town").alias("tk"), F.upper(F.trim("postcode")).alias("pk")))
    exact = d.join(f.select("folder", F.col("fk").alias("dk")), "dk").groupBy("deal_id").agg(F.min("folder").alias("exact"))
    code = d.where("pk <> ''").join(f.select("folder", "pk"), "pk").groupBy("deal_id").agg(F.min("folder").alias("code"))
    texts = [x.where("tk <> ''").select("tk", F.col(c).alias("text")).where("text <> ''").distinct() for x, c in ((d, "dk"), (f, "nk"))]
    near = alike(*texts, FOLDER, ["tk"], best=True)
    same = texts[0].join(texts[1], ["tk", "text"]).select("tk", F.col("text").alias("x"), F.col("text").alias("y"), F.lit(1.0).alias("r"))
    near = near.unionByName(same).join(f.select("tk", F.col("nk").alias("y"), "folder"), ["tk", "y"]).groupBy("tk", "x").agg(F.max(F.struct("r", "folder")).getField("folder").alias("near"))
    near = d.select("deal_id", "tk", F.col("dk").alias("x")).join(near, ["tk", "x"]).select("deal_id", "near")
    quarter = f.where("base <> folder").groupBy("base").agg(F.max(F.struct("latest", "folder")).getField("folder").alias("quarter")).withColumnRenamed("base", "name")
    out = d.join(exact, "deal_id", "left").join(code, "deal_id", "left").join(near, "deal_id", "left").join(quarter, "name", "left")
    how = F.when(F.col("exact").isNotNull(), "name").when(F.col("code").isNotNull(), "postcode").when(F.col("near").isNotNull(), "alike").when(F.col("quarter").isNotNull(), "quarter").otherwise("new")
    return out.select("deal_id", F.coalesce("exact", "code", "near", "quarter").alias("folder"), how.alias("how"))
