"""Mixed date and time formats to one unambiguous form.

Values without zone are clock times of their source's zone.  Which zone that is, is estimated from
sequence order: for each candidate zone the values of a source are turned into instants and held
against instants that are known to lie before and after them, and the zone with the fewest
violations is taken.  The preferred zone (the first candidate) stays unless another one has fewer
violations by more than ``MARGIN`` of the source's tested values and by more than ``LEAST`` in number.
Null, blank and unreadable values, days that do not exist and clock times that the zone skips give
no result; a clock time that is shown twice means the earlier instant.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.arrowmap import mapped
from parcelforge.functions.flexdate import UK, day_of, instant_of, zoneless_local
from parcelforge.runtime import cut, table

#: Candidate zones for values without one, the preferred first; each brings its whole offset history.
CANDIDATES = (UK, "UTC", "Europe/Paris", "Europe/Athens", "America/New_York", "America/Los_Angeles", "Asia/Kolkata")
#: Share of a source's tested values, and number, by which another zone must have fewer violations.
MARGIN, LEAST = 0.05, 5

def normalised(df: DataFrame, keep: list[str], columns: list[str], f, name: str) -> DataFrame:
    """``keep``, ``columns`` and ``f`` of each column as ``<column>_iso``."""
    fields = [*keep, *(c for c in columns if c not in keep)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*fields).dtypes), *(f"`{c}_iso` string" for c in columns)])

    def run(batches):
        for b in batches:
            made = [mapped(b.column(fields.index(c)), f, name) for c in columns]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*fields, *(f"{c}_iso" for c in columns)])

    return df.select(*fields).mapInArrow(run, schema)


def estimate_zones(df: DataFrame, source: str, local: str, before: str, after: str, candidates=CANDIDATES) -> DataFrame:
    """(source, zone, tested, violations): the zone of each source's zone-less clock times.

    ``local`` is a timestamp without zone, ``before`` and ``after`` are instants (UTC timestamps) that
    the event is known not to precede and not to follow; null bounds test nothing.  One aggregate per source.
    """
    sums = []
    for i, zone in enumerate(candidates):
        at = F.to_utc_timestamp(F.col(local), zone)
        bad = F.coalesce(at < F.col(before), F.lit(False)) | F.coalesce(at > F.col(after), F.lit(False))
        sums.append(F.count_if(bad).alias(f"v{i}"))
    tested = F.count_if(F.col(before).isNotNull() | F.col(after).isNotNull()).alias("tested")
    counts = df.where(F.col(local).isNotNull()).groupBy(source).agg(tested, *sums)
    best = F.least(*(F.struct(F.col(f"v{i}").alias("v"), F.lit(i).alias("i")) for i in range(len(candidates))))
    change = (F.col("v0") - best["v"] > F.greatest(F.lit(LEAST), F.col("tested") * MARGIN)).cast("boolean")
    names = F.array(*(F.lit(z) for z in candidates))
    return counts.select(
        source,
        F.when(change, names[best["i"]]).otherwise(F.lit(candidates[0])).alias("zone"),
        "tested",
        F.when(change, best["v"]).otherwise(F.col("v0")).alias("violations"),
    )


def mail_times(mails: DataFrame) -> DataFrame:
    """(gmail_message_id, date, sender_domain, iso): one row per message, times without zone in the zone estimated for their sender's domain.

    A reply (subject ``RE:``) follows every first message of its thread whose instant is stated, and a first
    message precedes every such reply.  Rows without message id are left out.
    """
    cells = F.struct(F.col("date").isNull().alias("none"), "date", "sender_domain", "subject", F.nullif(F.trim("thread_id"), F.lit("")).alias("thread_id"))
    # of several deliveries the one that sorts first, dated ones before others
    one = mails.where("trim(gmail_message_id) <> ''").groupBy("gmail_message_id").agg(F.min(cells).alias("m")).select("gmail_message_id", "m.date", "m.sender_domain", "m.subject", "m.thread_id")

    def read(batches):
        for b in batches:
            d = b.column(1)
            local = mapped(d, zoneless_local, "local", pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays([*b.columns, mapped(d, instant_of, "instant"), local], [*b.schema.names, "iso", "local"])

    read_ = cut(one.mapInArrow(read, "gmail_message_id string, date string, sender_domain string, subject string, thread_id string, iso string, local timestamp_ntz"))
    reply = F.coalesce(F.lower("subject").rlike(r"^\s*(re|aw|sv)\s*:"), F.lit(False))
    stated = F.when(F.col("local").isNull() & (F.length("iso") > 10), F.to_timestamp("iso"))
    known = read_.select("thread_id", reply.alias("reply"), stated.alias("at")).where("thread_id is not null and at is not null")
    bounds = known.groupBy("thread_id").agg(F.max(F.when(~F.col("reply"), F.col("at"))).alias("first"), F.min(F.when(F.col("reply"), F.col("at"))).alias("next"))
    open_ = read_.where("local is not null").join(bounds, "thread_id", "left")
    open_ = open_.select("sender_domain", F.col("local").cast("timestamp").alias("local"), F.when(reply, F.col("first")).alias("before"), F.when(~reply, F.col("next")).alias("after"))
    zones = estimate_zones(open_, "sender_domain", "local", "before", "after").where(F.col("zone") != UK).select("sender_domain", "zone")
    moved = F.date_format(F.to_utc_timestamp(F.col("local").cast("timestamp"), F.col("zone")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = read_.join(zones, "sender_domain", "left")
    return out.select("gmail_message_id", "date", "sender_domain", F.when(F.col("local").isNotNull() & F.col("zone").isNotNull(), moved).otherwise(F.col("iso")).alias("iso"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Every value that denotes a real day or instant and is not in its normal form, with that form."""
    occ = normalised(table(spark, sf_dir, "raw_occupational_comps"), ["id"], ["lease_start", "comp_date"], day_of, "day")
    deal = normalised(table(spark, sf_dir, "deals"), ["deal_id"], ["date"], day_of, "day")
    mail = mail_times(table(spark, sf_dir, "email_summaries"))
    both = F.stack(F.lit(2), F.lit("lease_start"), F.col("lease_start"), F.col("lease_start_iso"), F.lit("comp_date"), F.col("comp_date"), F.col("comp_date_iso")).alias("field_name", "value", "iso")
    out = occ.select(F.lit("occ").alias("src"), F.col("id").cast("string").alias("rec_key"), both)
    out = out.unionByName(deal.select(F.lit("deal").alias("src"), F.col("deal_id").cast("string").alias("rec_key"), F.lit("date").alias("field_name"), F.col("date").alias("value"), F.col("date_iso").alias("iso")))
    out = out.unionByName(mail.select(F.lit("mail").alias("src"), F.col("gmail_message_id").alias("rec_key"), F.lit("date").alias("field_name"), F.col("date").alias("value"), "iso"))
    return out.where("iso is not null and iso <> value").select("src", "rec_key", "field_name", "iso")
