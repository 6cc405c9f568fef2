"""The surviving record of each group of duplicate lettings.

Per field, the values of a group are split into tokens, aligned progressively (each value against
the profile of those before it, by dynamic programming), and each column of the alignment is voted
on with the weights of the values; the survivor takes the existing value that is closest to the
consensus.  Weights are whole numbers, so no group is too large for them.  With ``recency`` weights
each value weighs more than all values updated before it together, as problem 2 asks for rents and
starts: where one value was updated last the vote is settled by that, and where several were updated
at that same instant they vote as often as they were recorded, older values decide between equal
votes, and one of those updated last survives.  With ``support`` weights a value counts as often as it
was recorded, and recency only breaks ties.

Unusable values (null, blank, placeholders, rents not above zero, dates that denote no day) take no
part; a field without usable value gives no row.  Ties go to the value updated last, then to the
higher id.  Copies of a value are counted before anything is gathered, so a group brings to its
task only its different values.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.address import is_missing
from parcelforge.functions.flexdate import day_of
from parcelforge.operators.lettings import MARKS, cluster_signatures, first_day, letting_rows, signatures
from parcelforge.operators.places import place_rows
from parcelforge.runtime import table

GAP = ""
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def align(profile: list[dict[str, int]], seq: list[str], total: int, weight: int) -> list[dict[str, int]]:
    """``profile`` (token weights per column, over ``total`` weight) with ``seq`` aligned into it at the least cost; tokens meet whatever their case."""
    n, m = len(profile), len(seq)
    low = [t.lower() for t in seq]
    here = []  # what each column costs against each token
    for col in profile:
        held: dict[str, int] = {}
        for t, w in col.items():
            held[t.lower()] = held.get(t.lower(), 0) + w
        here.append([total - held.get(t, 0) for t in low])
    gone = [total - col.get(GAP, 0) for col in profile]
    cost = [[j * total for j in range(m + 1)]]
    for i in range(n):
        above, row = cost[-1], [cost[-1][0] + gone[i]]
        for j in range(m):
            row.append(min(above[j] + here[i][j], above[j + 1] + gone[i], row[j] + total))
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + here[i - 1][j - 1]:
            i, j = i - 1, j - 1
            col, t = dict(profile[i]), seq[j]
        elif i and cost[i][j] == cost[i - 1][j] + gone[i - 1]:
            i -= 1
            col, t = dict(profile[i]), GAP
        else:
            j -= 1
            col, t = {GAP: total}, seq[j]
        col[t] = col.get(t, 0) + weight
        out.append(col)
    return out[::-1]


def consensus(values: list[tuple[str, int]]) -> list[str]:
    """The tokens that win their columns; values in falling weight, equal votes go to the token seen first."""
    profile: list[dict[str, int]] = []
    total = 0
    for value, weight in values:
        profile = align(profile, tokens(value), total, weight)
        total += weight
    won = (max(col, key=lambda t: col[t]) for col in profile)
    return [t for t in won if t != GAP]


def edits(a: list[str], b: list[str]) -> int:
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def closest(values: list[tuple[str, int]], least: int = 0) -> str | None:
    """The existing value of weight ``least`` or more that is closest to the consensus of all (value, weight); None of none."""
    ranked = sorted(values, key=lambda v: -v[1])
    if len(ranked) < 2:
        return ranked[0][0] if ranked else None
    won = consensus(ranked)
    return min((v for v in ranked if v[1] >= least), key=lambda v: edits(tokens(v[0]), won))[0]


def weights(values: list[tuple[str, int]], instants: list | None) -> list[tuple[str, int]]:
    """(value, weight) of (value, count), newest first: by instant, each record worth more than all older values together; without instants its count, and between equal counts the newer."""
    n = len(values)
    if instants is None:
        return [(v, (1 << n - 1 - k) + (c << n)) for k, (v, c) in enumerate(values)]
    out, total, each = [], 0, 1
    for k in reversed(range(n)):
        v, c = values[k]
        if k + 1 < n and instants[k] != instants[k + 1]:
            each = total + 1
        out.append((v, c * each))
        total += c * each
    return out[::-1]


def choose(entries: list[tuple], recency: bool) -> tuple | None:
    """The newest entry of the winning value, of (updated_at, id, value, count)."""
    newest = sorted(entries, key=lambda e: (e[0] is not None, e[0] or 0, e[1]), reverse=True)
    counts: dict[str, int] = {}
    last: dict[str, object] = {}
    for e in newest:
        counts[e[2]] = counts.get(e[2], 0) + e[3]
        last.setdefault(e[2], e[0])
    weighed = weights(list(counts.items()), list(last.values()) if recency else None)
    # no value may survive that weighs less than those updated last
    best = closest(weighed, min((w for v, w in weighed if last[v] == newest[0][0]), default=0) if recency else 0)
    return next((e for e in newest if e[2] == best), None)


def usable(name: str, c: Column) -> Column:
    """Which values of a field may survive."""
    if name.startswith(("rent", "size")):
        return c.isNotNull() & ~F.isnan(c) & (c > 0)
    return c.isNotNull() & (F.trim(c) != "")


def pick(groups: DataFrame, recency: bool) -> DataFrame:
    """(group_id, field_name, from_id, value, members) of (group_id, field_name, members, entries): the winner of each group by consensus."""
    known: dict[str, bool] = {}

    def real(value: str, dated: bool) -> bool:
        if not dated:
            return not is_missing(value)
        if value not in known:
            if len(known) > 200_000:
                known.clear()
            known[value] = day_of(value) is not None
        return known[value]

    def run(batches):
        for b in batches:
            entries = b.column(3)
            flat = entries.flatten()
            values, counts, ats, ids = (flat.field(k).to_pylist() for k in range(4))
            ends = np.cumsum(entries.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            got, i = [], 0
            for gid, name, members, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), ends):
                dated = name.startswith(("lease", "comp_date", "break"))
                ok = [e for e in zip(ats[i:j], ids[i:j], values[i:j], counts[i:j]) if real(e[2], dated)]
                i = j
                if e := choose(ok, recency):
                    got.append((gid, name, e[1], e[2], members))
            cols = list(zip(*got)) if got else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["group_id", "field_name", "from_id", "value", "members"])

    return groups.select("group_id", "field_name", "members", "entries").mapInArrow(run, "group_id bigint, field_name string, from_id bigint, value string, members bigint")


def survivors(rows: DataFrame, fields: list[str], recency: bool) -> DataFrame:
    """The surviving value of each field of each group (``group_key``) of two or more rows (id, updated_at, fields)."""
    by_value = None
    for f in fields:
        part = rows.select("group_key", F.lit(f).alias("field_name"), "id", "updated_at", F.when(usable(f, F.col(f)), F.col(f).cast("string")).alias("value"))
        by_value = part if by_value is None else by_value.unionByName(part)
    entry = by_value.groupBy("group_key", "field_name", "value").agg(
        F.count("*").alias("n"), F.min("id").alias("least"), F.max(F.struct(F.unix_micros(F.try_to_timestamp("updated_at")).alias("at"), "id")).alias("last")
    )
    groups = entry.groupBy("group_key", "field_name").agg(
        F.min("least").alias("group_id"), F.sum("n").alias("members"),
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n", F.col("last.at").alias("at"), F.col("last.id").alias("id")))).alias("entries"),
    ).where((F.col("members") >= 2) & (F.size("entries") > 0))
    return pick(groups, recency)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The row that each group's rent and lease start come from, the newest usable value weighing most.

    Everything is counted per signature (rows that agree in unit, deal, occupier, dates and rents) before groups are formed.
    """
    places = place_rows(table(spark, sf_dir, "place_dim"))
    comps = table(spark, sf_dir, "raw_occupational_comps")
    rows = signatures(comps.withColumn("updated", F.unix_micros(F.try_to_timestamp("updated_at"))), places, ["updated"])
    marks = rows.groupBy("unit_key", "sig", *MARKS, "deal").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max(F.struct(F.col("updated").alias("at"), "id")).alias("last"))
    marks = marks.select("unit_key", "sig", *MARKS, "deal", "n", "least", F.col("last.at").alias("at"), F.col("last.id").alias("id"))
    found = cluster_signatures(marks)
    entry = lambda value: F.struct(value.cast("string").alias("value"), "n", "at", "id")
    groups = found.groupBy("letting_id", "deal").agg(
        F.min("least").alias("group_id"), F.sum("n").alias("members"),
        F.collect_list(F.when(usable("rent_pa", F.col("rent_pa")), entry(F.col("rent_pa")))).alias("rents"),
        F.collect_list(F.when(F.col("starts").isNotNull(), entry(first_day("starts")))).alias("starts"),
    ).where("members >= 2")
    sides = F.array(F.struct(F.lit("rent_pa").alias("field_name"), F.col("rents").alias("entries")), F.struct(F.lit("lease_start").alias("field_name"), F.col("starts").alias("entries")))
    groups = groups.select("group_id", "members", F.inline(sides)).where("size(entries) > 0")
    return pick(groups, recency=True).select("group_id", "field_name", "from_id")


def group_rows(spark, sf_dir: str, fields: list[str]) -> DataFrame:
    """Rows of an occupational table with the key of the letting that they record: ``group_key``, id, updated_at and ``fields``."""
    places = place_rows(table(spark, sf_dir, "place_dim"))
    own = [f for f in fields if f != "rent_pa"]
    comps = table(spark, sf_dir, "raw_occupational_comps").withColumns({f"{f}_": F.col(f) for f in own})
    rows = letting_rows(comps, places, ["updated_at", *(f"{f}_" for f in own)]).withColumnsRenamed({f"{f}_": f for f in own})
    return rows.select(F.xxhash64("letting_id", "deal").alias("group_key"), "id", "updated_at", *fields)


def p2_survivors(spark, sf_dir: str) -> DataFrame:
    """One surviving record per group: newest rent and start, and the best-supported writing of the names."""
    new, old = ["rent_pa", "lease_start"], ["source_deal", "tenant_name", "unit_name", "address", "town", "postcode", "lease_expiry"]
    rows = group_rows(spark, sf_dir, new + old)
    both = survivors(rows, new, True).unionByName(survivors(rows, old, False))
    return both.groupBy("group_id").agg(F.max("members").alias("members"), *(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in new + old))
