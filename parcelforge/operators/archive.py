"""Archiving of messages: which folder and subfolder each goes to, under which names its files are kept, and a writer."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.dates import day_or, quarter_suffix
from parcelforge.functions.predicates import junk_image
from parcelforge.functions.text import dated_folder, file_safe, folder_name
from parcelforge.operators.ledger import numbered, visits

#: Days after which a property's next message opens a new quarter folder.
GAP_DAYS = 90


def archive_plan(deals: DataFrame, as_of: str) -> DataFrame:
    """(deal_id, base, folder, subfolder): the property's folder, with the quarter behind it from its second visit on, and the dated subfolder, numbered where a folder has several of the name.

    ``deals``: deal_id, town, asset_name, agent, date.  Undated deals count as of ``as_of``.
    """
    rows = deals.select("deal_id", folder_name("town", "asset_name", "agent", "date").alias("base"), day_or("date", F.lit(as_of).cast("date")).alias("day"), "agent")
    rows = visits(rows.withColumnRenamed("deal_id", "row_id"), "base", "day", GAP_DAYS).withColumnRenamed("row_id", "deal_id")
    opened = rows.groupBy("base", "visit").agg(F.min("day").alias("opened"))
    rows = rows.join(opened, ["base", "visit"])
    later = F.concat("base", F.lit(" ("), quarter_suffix(F.col("opened")), F.lit(")"))
    rows = rows.select("deal_id", "base", F.when(F.col("visit") == 1, F.col("base")).otherwise(later).alias("folder"), dated_folder(F.col("day"), "agent").alias("_dated"))
    return numbered(rows, "folder", "_dated", [F.col("deal_id")], suffixed=False).select("deal_id", "base", "folder", F.col("free_name").alias("subfolder"))


def file_plan(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(deal_id, path, name): where each kept file goes.  ``files``: deal_id, name, size, inline.  Junk images are dropped, equal names numbered."""
    kept = files.where(~F.coalesce(junk_image("name", "size", F.col("inline")), F.lit(False))).join(plan, "deal_id")
    named = kept.select("deal_id", F.concat_ws("/", "folder", "subfolder").alias("path"), file_safe("name").alias("safe"))
    return numbered(named, "path", "safe", [F.col("deal_id")]).select("deal_id", "path", F.col("free_name").alias("name"))


def write_archive(plan: DataFrame, bodies: DataFrame, root: str) -> None:
    """Writes each message's body and metadata file below ``root``, which all executors must share; a message that is there already is left alone, another one in its place is never overwritten but gets a numbered folder.

    ``bodies``: deal_id, gmail_message_id, body, metadata (JSON text).
    """

    def write(rows):
        for r in rows:
            n, there = 1, False
            while True:
                at = Path(root) / r["folder"] / (r["subfolder"] + (f" ({n})" if n > 1 else ""))
                meta = at / "metadata.json"
                if not meta.exists():
                    break
                if there := json.loads(meta.read_text(encoding="utf-8")).get("gmail_message_id") == r["gmail_message_id"]:
                    break
                n += 1
            if there:
                continue
            at.mkdir(parents=True, exist_ok=True)
            (at / "body.txt").write_text(r["body"] or "", encoding="utf-8")
            meta.write_text(json.dumps({**json.loads(r["metadata"] or "{}"), "gmail_message_id": r["gmail_message_id"]}), encoding="utf-8")

    plan.join(bodies, "deal_id").select("folder", "subfolder", "gmail_message_id", "body", "metadata").foreachPartition(write)
