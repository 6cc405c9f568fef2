"""Candidate pairs for tolerance and likeness joins.

Likeness joins compare all texts of a group by bounds on arrays, without writing pairs.  Joins on shared words meet on
the rarest words only (prefix filtering): two sets that share at least m of their parts share one of the |set| - m + 1
rarest of each, whatever the order of rarity is.  What is frequent is therefore hardly ever a meeting point, and no pair is lost.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelforge.functions.numbers import close
from parcelforge.functions.similarity import alike_texts, may_be_alike, most_alike_texts
from parcelforge.functions.text import name_key, telling_words
from parcelforge.runtime import cut

#: Texts of either side that one task compares at once.
PIECES = (4096, 32768)


def band(value: Column, tolerance: float) -> Column:
    """Number of the logarithmic band of a value above zero; values within ``tolerance`` of their mean lie at most one band apart."""
    width = math.log((1 + tolerance / 2) / (1 - tolerance / 2))
    return F.when(value > 0, F.floor(F.log(value) / width))


def rent_key(pa: str, psf: str, tolerance: float) -> Column:
    """Band and kind by which two rows' rents can agree: yearly rents, or rents per area where no yearly rent is known."""
    return F.when(F.col(pa).isNotNull(), F.struct(F.lit("pa").alias("kind"), band(F.col(pa), tolerance).alias("band"))).otherwise(F.struct(F.lit("psf").alias("kind"), band(F.col(psf), tolerance).alias("band")))


def band_pairs(df: DataFrame, row_id: str, keep: list[str], pa: str, psf: str, tolerance: float, equal: list[str] = (), via: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """Pairs ``id_a < id_b`` with rents that agree (and equal non-blank ``equal`` columns): an equi-join on bands, one side in three of them, then the exact test.

    With ``via`` (x, y) the one ``equal`` column need not be equal, but (that of a, that of b) has to be one of its rows.
    With ``other`` a is one of ``df`` and b one of ``other``.  Rows without any rent above zero are in no pair.
    """
    held = lambda d: d.select(F.col(row_id).alias("id"), pa, psf, *keep, *equal, rent_key(pa, psf, tolerance).alias("k")).where("k.band is not null").where(reduce(lambda x, y: x & y, [F.col(c) != "" for c in equal], F.lit(True)))
    keyed = held(df)
    cols = list(dict.fromkeys(["id", pa, psf, *keep]))
    left = keyed.select(*(F.col(c).alias(f"{c}_a") for c in cols), *equal, F.col("k.kind").alias("kind"), F.explode(F.sequence(F.col("k.band") - 1, F.col("k.band") + 1)).alias("band"))
    if via is not None:
        left = left.join(via.select(F.col("x").alias(equal[0]), "y"), equal[0]).drop(equal[0]).withColumnRenamed("y", equal[0])
    right = (keyed if other is None else held(other)).select(*(F.col(c).alias(f"{c}_b") for c in cols), *equal, F.col("k.kind").alias("kind"), F.col("k.band").alias("band"))
    same = F.when(F.col("kind") == "pa", close(f"{pa}_a", f"{pa}_b", tolerance)).otherwise(close(f"{psf}_a", f"{psf}_b", tolerance))
    return left.join(right, ["kind", "band", *equal]).where((F.col("id_a") < F.col("id_b")) & same)


def rarest(parts: DataFrame, of: DataFrame) -> DataFrame:
    """``parts`` (id, part, size) with ``rank``, from 1 for the rarest in ``of`` (part)."""
    often = of.groupBy("part").agg(F.count("*").alias("_often"))
    order = Window.partitionBy("id").orderBy("_often", "part")
    return parts.join(often, "part").withColumn("rank", F.row_number().over(order)).drop("_often")


def alike(left: DataFrame, right: DataFrame, least: float, within: list[str] = (), both: bool = False, best: bool = False) -> DataFrame:
    """(within, x, y, r): different texts of ``left`` and ``right`` (``text`` and the columns ``within``, which have to be equal; each once) of which ``ratio(x, y)`` is ``least`` or more; with ``both`` also (y, x) of the other likeness.
    With ``best`` only the most alike of each x are sure to be among them, all of equals.

    All with all of each group, by bounds on arrays (``alike_texts``): no pair is written that is not alike, and none is lost.
    Groups are dealt to tasks in pieces of at most about ``PIECES`` texts of each side.
    """
    by = list(within) or ["_all"]
    sides = [d.where(F.length("text") > 0).select(*within, *([] if within else [F.lit(0).alias("_all")]), "text") for d in (left, right)]
    many = [d.groupBy(by).agg(F.ceil(F.count("*") / p).cast("int").alias(c)) for d, p, c in zip(sides, PIECES, ("_i", "_j"))]
    pieces = many[0].join(many[1], by)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("text"), n).cast("int")
    a, b = (d.join(pieces, by) for d in sides)
    a = a.select(*by, one("_i").alias("i"), each("_j").alias("j"), F.lit(True).alias("x"), "text")
    b = b.select(*by, each("_i").alias("i"), one("_j").alias("j"), F.lit(False).alias("x"), "text")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes make many pairs: the number of tasks must not follow the bytes
    dealt = a.unionByName(b).repartition(n, *by, "i", "j")
    fields = [f for f in sides[0].schema.fields if f.name in within]
    schema = T.StructType([*fields, T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("r", T.DoubleType())])
    types = to_arrow_schema(schema)

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("x")
        xs, ys = (group.column("text").filter(s).to_pylist() for s in (side, pc.invert(side)))
        met = None if best else may_be_alike(xs, ys, least)[:2]
        i, j, r = most_alike_texts(xs, ys, least) if best else alike_texts(xs, ys, least, met)
        found = [[xs[k] for k in i], [ys[k] for k in j], r]
        if both:
            j, i, r = alike_texts(ys, xs, least, met[::-1])
            found = [f + g for f, g in zip(found, ([ys[k] for k in j], [xs[k] for k in i], r))]
        own = [pa.repeat(group.column(c)[0], len(found[2])) for c in within]
        return pa.Table.from_arrays([*own, *(pa.array(f, t) for f, t in zip(found, (pa.string(), pa.string(), pa.float64())))], names=types.names)

    return dealt.groupBy(*by, "i", "j").applyInArrow(compare, schema)


def _meet(left: DataFrame, right: DataFrame, by: str, at: tuple[Column, Column] | None) -> DataFrame:
    """Join of the two sides on ``by`` and, with ``at``, where the left one's array holds the right one's value (columns ``_at`` of both)."""
    if at is None:
        return left.join(right, by)
    return left.withColumn("_at", F.explode("_at")).join(right, [by, "_at"]).drop("_at")


def _at(meet: tuple[Column, Column] | None, k: int) -> list[Column]:
    return [meet[k].alias("_at")] if meet else []


def _overlaps(left: DataFrame, right: DataFrame, part: float, meet: tuple[Column, Column] | None = None) -> DataFrame:
    """(id_a, id_b): names (id, name) that may share two telling words and ``part`` of those of the one that has fewer; with ``meet`` only where it holds."""
    words = [d.select("id", telling_words("name").alias("w"), *_at(meet, k)).where("size(w) > 1").select("id", F.size("w").alias("size"), F.explode("w").alias("part"), *(["_at"] if meet else [])) for k, d in enumerate((left, right))]
    every = words[0].select("part").unionByName(words[1].select("part"))
    ranked = [cut(rarest(w, every)) for w in words]
    # the one with fewer words shares so many of them; the other shares two at least
    fewer = [d.where(F.col("rank") <= F.col("size") - F.greatest(F.lit(2), F.ceil(F.col("size") * part - 1e-9)) + 1) for d in ranked]
    more = [d.where(F.col("rank") < F.col("size")) for d in ranked]
    side = lambda d, s: d.select(F.col("id").alias(f"id_{s}"), F.col("size").alias(f"n_{s}"), "part", *(["_at"] if meet else []))
    return _meet(side(fewer[0], "a"), side(more[1], "b"), "part", meet).where("n_a <= n_b").unionByName(_meet(side(more[0], "a"), side(fewer[1], "b"), "part", meet).where("n_a >= n_b")).select("id_a", "id_b")


def _borders(df: DataFrame, every: bool) -> DataFrame:
    """(id, part, n): what stands around each space of a name key, two letters at each side; with ``every`` also with one letter where there are two."""
    key = df.select("id", name_key("name").alias("k")).where(F.contains("k", F.lit(" ")))
    words = F.filter(F.split("k", " "), lambda w: w != "")
    at = key.select("id", F.length("k").alias("n"), words.alias("w")).select("id", "n", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("l"), F.slice("w", F.lit(2), F.size("w") - 1).alias("r"))).alias("x"))
    sizes = [(i, j) for i in (1, 2) for j in (1, 2)] if every else [(2, 2)]
    parts = F.array(*(F.concat(F.right("x.l", F.lit(i)), F.lit(" "), F.left("x.r", F.lit(j))) for i, j in sizes))
    return at.select("id", "n", F.explode(F.array_distinct(parts)).alias("part"))


def _contained(left: DataFrame, right: DataFrame, meet: tuple[Column, Column] | None = None) -> DataFrame:
    """(id_a, id_b): names of which one may stand in the other: a longer one has what stands around the rarest space of the shorter; with ``meet`` only where it holds."""
    sides = [cut(d.select("id", "name", *_at(meet, k))) for k, d in enumerate((left, right))] if meet else [left, right]

    def within(short: int, long: int) -> DataFrame:
        there = cut(_borders(sides[long], True))
        often = there.groupBy("part").agg(F.count("*").alias("often"))
        rare = _borders(sides[short], False).join(often, "part").groupBy("id").agg(F.min(F.struct("often", "part")).getField("part").alias("part"), F.first("n").alias("n"))
        ends = {short: rare.select(F.col("id").alias("s"), "part", F.col("n").alias("ns")), long: there.select(F.col("id").alias("l"), "part", "n")}
        if meet:
            ends = {k: d.join(sides[k].select(F.col("id").alias("s" if k == short else "l"), "_at"), "s" if k == short else "l") for k, d in ends.items()}
        return _meet(ends[0], ends[1], "part", meet).where("ns <= n").select("s", "l")

    return within(0, 1).select(F.col("s").alias("id_a"), F.col("l").alias("id_b")).unionByName(within(1, 0).select(F.col("l").alias("id_a"), F.col("s").alias("id_b")))


def name_candidates(left: DataFrame, right: DataFrame, text: Column, least: float, part: float = 0.6, meet: tuple[Column, Column] | None = None) -> DataFrame:
    """(id_a, id_b), each once: pairs of names (id, name, other columns of ``text``) that may be equal, contained, share telling words, or have alike ``text``; with ``meet`` only where the left one's array holds the right one's value."""
    side = lambda d, c, k: d.select(F.col("id").alias(f"id_{'ab'[k]}"), c.alias("k"), *_at(meet, k)).where("k <> ''")
    same = _meet(side(left, name_key("name"), 0), side(right, name_key("name"), 1), "k", meet).select("id_a", "id_b")
    at = (F.explode(meet[0]), meet[1]) if meet else (F.lit(0), F.lit(0))
    texts = [cut(d.select(text.alias("text"), m.alias("at")).where("text <> ''").distinct()) for d, m in zip((left, right), at)]
    near = cut(alike(*texts, least, ["at"]).select("x", "y").distinct())
    near = _meet(side(left, text, 0).join(near.withColumnRenamed("x", "k"), "k").drop("k"), side(right, text, 1).withColumnRenamed("k", "y"), "y", meet).select("id_a", "id_b")
    near = near.unionByName(_meet(side(left, text, 0), side(right, text, 1), "k", meet).select("id_a", "id_b"))
    return same.unionByName(near).unionByName(_overlaps(left, right, part, meet)).unionByName(_contained(left, right, meet)).where("id_a <> id_b").distinct()
