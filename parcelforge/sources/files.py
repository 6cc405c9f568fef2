"""Brochure folders, sheets and lookups as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.numbers import to_number
from parcelforge.functions.predicates import DOCUMENTS, financial_model
from parcelforge.functions.text import blank


def kind_of(path: Column) -> Column:
    """pdf, sheet or '' by suffix."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.pdf$"), "pdf").when(p.rlike(r"\.xlsx?$"), "sheet").otherwise("")


def deal_of(relative: Column) -> Column:
    """The first folder of a path, else the file's name without suffix."""
    parts = F.split(relative, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", ""))


def archive_files(spark: SparkSession, root: str, depth: int | None = None, models: bool = True, skip: list[str] = ()) -> DataFrame:
    """(path, name, size, deal, kind) of the documents below ``root``; with ``depth`` only those that many folders down, without ``models`` no financial models, none of the names in ``skip``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    out = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), deal_of(rel).alias("deal"), kind_of(F.col("path")).alias("kind"), F.size(F.split(rel, "/")).alias("_depth"))
    out = out.where(F.col("name").rlike(DOCUMENTS) & ~F.col("name").isin(*skip))
    if not models:
        out = out.where(~financial_model("name"))
    return (out if depth is None else out.where(F.col("_depth") == depth + 1)).drop("_depth")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, gmail_message_id, postcode, agent) of the metadata files of an archive; broken ones are skipped."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metadata.json").select(F.col("_metadata.file_path").alias("path"), "value")
    good = raw.where(F.try_parse_json("value").isNotNull())
    get = lambda p: F.get_json_object("value", p)
    return good.select("path", get("$.gmail_message_id").alias("gmail_message_id"), get("$.deal_extraction.postcode").alias("postcode"), get("$.deal_extraction.agent").alias("agent"))


def sheet(spark: SparkSession, path: str, columns: dict[str, str], header_row: int = 1, key: str | None = None) -> DataFrame:
    """A sheet exported as CSV, columns by position: ``columns`` maps names to types; rows whose ``key`` is blank are skipped; ``row`` is the sheet's row."""
    names = list(columns)
    schema = ", ".join(f"`{n}` STRING" for n in names)
    raw = spark.read.schema(schema).option("header", "false").option("multiLine", "true").csv(path)
    raw = raw.withColumn("row", (F.monotonically_increasing_id() + 1).cast("int")).where(F.col("row") > header_row)
    out = raw.select("row", *(to_number(n).alias(n) if t == "DOUBLE" else to_number(n).cast("int").alias(n) if t == "INT" else F.col(n) for n, t in columns.items()))
    return out.where(~blank(key)) if key else out


def postcode_towns(places: DataFrame) -> DataFrame:
    """The lookup of postcodes' outcodes: (outcode, town, county, region)."""
    return places.groupBy("outcode").agg(F.min("name").alias("town"), F.min("county").alias("county"), F.min("region").alias("region"))


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """Ordered CSV with a header, nulls as blanks, one file."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)
