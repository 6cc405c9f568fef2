"""Order-dependent duplicate removal as rounds over a match graph.

A row goes if an earlier row that stays matches it; that is the lexicographically first maximal
independent set of the graph.  Each round settles all rows whose earlier neighbours are settled:
those next to a kept row go, those with none left stay.  Keepers are assigned after the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.runtime import cut


def first_wins(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept_id) of every node (``id``): itself where it stays, else the first kept row that matches it.

    ``pairs`` has ``id_a < id_b`` for rows that match.  Nodes without pairs stay.
    """
    edges = cut(pairs.select("id_a", "id_b").distinct())
    open_ = cut(edges.select(F.col("id_a").alias("id")).union(edges.select("id_b")).distinct())
    live, kept = edges, None
    while open_.limit(1).count():
        waiting = live.select(F.col("id_b").alias("id")).distinct()
        now = cut(open_.join(waiting, "id", "left_anti"))
        gone = live.join(now.withColumnRenamed("id", "id_a"), "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct()
        gone = cut(gone)
        kept = now if kept is None else kept.union(now)
        open_ = cut(open_.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        live = cut(live.join(open_.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(open_.withColumnRenamed("id", "id_b"), "id_b", "left_semi"))
    if kept is None:
        return nodes.select("id", F.col("id").alias("kept_id"))
    kept = cut(kept)
    keeper = edges.join(kept.withColumnRenamed("id", "id_a"), "id_a", "left_semi").groupBy(F.col("id_b").alias("id")).agg(F.min("id_a").alias("keeper"))
    keeper = keeper.join(kept, "id", "left_anti")
    return nodes.select("id").join(keeper, "id", "left").select("id", F.coalesce("keeper", "id").alias("kept_id"))


def fill_blanks(rows: DataFrame, groups: DataFrame, fields: list[str], policy: str = "first") -> DataFrame:
    """One row per kept row with its blank ``fields`` filled from the rows that it replaces, the ``first`` or ``last`` of them winning; never overwritten."""
    from parcelforge.functions.text import blank

    if policy not in ("first", "last"):
        raise ValueError("policy is 'first' or 'last'")
    both = rows.join(groups, "id")
    pick = F.min_by if policy == "first" else F.max_by
    usable = lambda f: F.col(f).isNotNull() if dict(rows.dtypes)[f] != "string" else ~blank(f)
    own = F.col("id") == F.col("kept_id")
    out = []
    for f in fields:
        mine = F.max(F.when(own & usable(f), F.col(f)))
        other = pick(F.when(~own & usable(f), F.col(f)), F.when(~own & usable(f), F.col("id")))
        out.append(F.coalesce(mine, other, F.max(F.when(own, F.col(f)))).alias(f))
    return both.groupBy(F.col("kept_id").alias("id")).agg(*out, (F.count("*") - 1).alias("merged"))
