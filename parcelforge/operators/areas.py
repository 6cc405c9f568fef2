"""Floor and site areas in whatever unit they were recorded, found out and converted.

A number's unit is decided by the first that speaks: the quotient of yearly rent and rent per square
foot, whose dimension is an area's; a quantity in the words beside it that has the same number or the same size; a unit that the
words state; the sizes that other records of the same unit agree on.  A field without number
(null, zero, negative) takes the quantity that the words give for the thing itself; areas of an
estate, a yard or parking, and prices per area, are not the thing's own.
Null and blank words say nothing; a number for which nothing speaks is taken to be in the field's unit.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.units import AREA, Quantity, Unit, quantities, unit
from parcelforge.operators.places import place_rows, read_addresses
from parcelforge.runtime import cut, table

FOOT2 = unit("sqft").scale
#: Money a year over money a year and square foot: money and time cancel out, an area is left.
YEARLY = Unit("a year", (0, 0, -1, 0), 1 / 31_557_600)
IMPLIED = YEARLY.times(YEARLY.times(unit("sqft"), -1), -1)
assert IMPLIED.dim == AREA
#: Square feet of each unit code.
SQFT = {"sqft": 1.0, "ksqft": 1000.0, "sqm": 1 / FOOT2, "sqyd": 9.0, "acre": unit("acre").scale / FOOT2, "ha": unit("ha").scale / FOOT2}
#: Relative difference up to which two areas, and a ratio and a unit, count as equal.
SAME, RATIO = 0.01, 0.06
#: Words that say that an area is not that of the unit itself.
OTHERS = re.compile(r"\b(?:estate|park|yard|parking|ratio|per\s+(?:sq|m|ft|acre|ha)|range|canopy|mezzanine|roof|car|landscap\w*|adjoining|surplus|whole|in total)\b", re.I)
#: The same for the site of a deal.
OTHER_SITES = re.compile(r"\b(?:cover|parking|ratio|per|building|floor|unit|gia|gea|nia|adjoining|surplus)\b|%", re.I)


def code_of(q: Quantity) -> str | None:
    """The unit code of an area; None for any other dimension and for areas without a code."""
    if q.unit.dim != AREA:
        return None
    size = q.unit.scale / FOOT2 * (1000 if q.thousands else 1)
    return next((c for c, s in SQFT.items() if abs(size / s - 1) < 1e-6), None)


def own_areas(text: str | None, others: re.Pattern = OTHERS) -> list[tuple[float | None, str]]:
    """(number or None, unit code) of what ``text`` says of the thing's own area."""
    return [(q.value, c) for q in quantities(text) if (c := code_of(q)) and not others.search(q.clause)]


def nearest_code(ratio: float, most: float = RATIO) -> str | None:
    """The unit whose square feet are nearest to ``ratio``, if near enough."""
    if not ratio or ratio <= 0 or math.isinf(ratio):
        return None
    code = min(SQFT, key=lambda c: abs(math.log(ratio / SQFT[c])))
    return code if abs(math.log(ratio / SQFT[code])) < most else None


def same(a: float, b: float, most: float = SAME) -> bool:
    return abs(a - b) <= most * max(abs(a), abs(b))


def floor_unit(size: float | None, rent_pa: float | None, rent_psf: float | None, words) -> tuple[str | None, float | None, str | None]:
    """(unit code, own number, what says so: ``rents`` or ``words``) of a floor area meant in square feet; nulls where nothing speaks."""
    none = (None, None, None)
    if size is None or not size > 0 or math.isinf(size):
        return next(((c, v, "words") for v, c in words if v), none)
    if rent_pa and rent_psf and rent_pa > 0 and rent_psf > 0 and (code := nearest_code(IMPLIED.to(rent_pa / rent_psf, unit("sqft")) / size)):
        return code, size, "rents"
    for v, c in words:
        if v and same(v, size):
            return c, size, "words"
        if v and same(v * SQFT[c], size, 0.02):
            return "sqft", size, "words"
    return next(((c, size, "words") for v, c in words if v is None), none)


def site_unit(acres: float | None, words) -> str | None:
    """The unit code of a site area meant in acres: that of the quoted quantity with the same number, or of the first quoted one where there is no number."""
    quoted = [(v, c) for v, c in words if v]
    if acres is None or not acres > 0 or math.isinf(acres):
        return quoted[0][1] if quoted else None
    near = [(abs(v - acres) / acres, c != "acre", c) for v, c in quoted if same(v, acres, 0.005)]
    if near:
        return min(near)[2]
    for v, c in quoted:
        if same(v * SQFT[c] / SQFT["acre"], acres, 0.02):
            return "acre"
    return next((c for v, c in words if v is None), None)


_memo: dict[tuple, list] = {}


def _words(text: str | None, others: re.Pattern) -> list:
    key = (text, others is OTHERS)
    if key not in _memo:
        if len(_memo) > 100_000:
            _memo.clear()
        _memo[key] = own_areas(text, others)
    return _memo[key]


def floor_units(comps: DataFrame, places: tuple) -> DataFrame:
    """(id, size_sqft, code, number, sqft, evidence) of each row of an occupational table.

    ``code`` is the unit found and ``number`` the area in it; ``sqft`` the area in square feet;
    ``evidence`` is what the unit comes from: ``rents``, ``words``, ``mates`` (other records of the unit), null where nothing speaks.
    """
    cols = ["id", "size_sqft", "rent_pa", "rent_psf", "notes"]

    def decide(batches):
        for b in batches:
            got = [floor_unit(s, p, f, _words(n, OTHERS)) for s, p, f, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in cols[1:]))]
            keep = [i for i, c in enumerate(b.schema.names) if c in ("id", "size_sqft", "deal_key", "unit", "unit_col", "town", "number")]
            names = [("building" if b.schema.names[i] == "number" else b.schema.names[i]) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.string())], [*names, "code", "area", "evidence"]
            )

    read = read_addresses(comps, places, cols, unit_name="unit_name", deal="source_deal")
    read = read.mapInArrow(decide, "id bigint, size_sqft double, town string, building string, unit string, deal_key string, unit_col string, code string, area double, evidence string")
    key = F.xxhash64("deal_key", F.when(F.col("unit") != "", F.col("unit")).otherwise(F.col("unit_col")), "town", "building")
    scale = F.create_map(*(x for c, s in SQFT.items() for x in (F.lit(c), F.lit(s))))
    read = cut(read.select("id", "size_sqft", "code", "area", "evidence", key.alias("key")))
    open_ = F.col("code").isNull() & (F.col("size_sqft") > 0)
    mates = read.where("code is not null").select("key", (F.col("area") * scale[F.col("code")]).alias("sqft"))
    mates = mates.join(read.where(open_).select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("sqft").alias("least"), F.max("sqft").alias("most"))
    late = read.where(open_).join(mates, "key", "left")
    ratio = (F.col("least") + F.col("most")) / 2 / F.col("size_sqft")
    agreed = F.col("most") <= F.col("least") * 1.03
    guess = F.coalesce(*(F.when(agreed & (F.abs(F.log(ratio / s)) < RATIO), F.lit(c)) for c, s in SQFT.items()))
    late = late.select("id", "size_sqft", F.coalesce(guess, F.lit("sqft")).alias("code"), F.col("size_sqft").alias("area"), F.when(guess.isNotNull(), "mates").alias("evidence"))
    out = read.where(~F.coalesce(open_, F.lit(False))).select("id", "size_sqft", "code", "area", "evidence").unionByName(late)
    return out.select("id", "size_sqft", "code", F.col("area").alias("number"), (F.col("area") * scale[F.col("code")]).alias("sqft"), "evidence")


def site_units(deals: DataFrame) -> DataFrame:
    """(deal_id, area_acres, code) of each deal; ``code`` null where nothing speaks."""

    def decide(batches):
        for b in batches:
            got = [site_unit(a, _words(q, OTHER_SITES)) for a, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], ["deal_id", "area_acres", "code"])

    return deals.select("deal_id", "area_acres", "area_quoted").mapInArrow(decide, "deal_id bigint, area_acres double, code string")


def no_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (c <= 0)


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Areas that are not in the field's own unit or stand only in words, with the unit found."""
    places = place_rows(table(spark, sf_dir, "place_dim"))
    occ = floor_units(table(spark, sf_dir, "raw_occupational_comps"), places).where("code is not null").where(no_number(F.col("size_sqft")) | (F.col("code") != "sqft"))
    deal = site_units(table(spark, sf_dir, "deals")).where("code is not null").where(no_number(F.col("area_acres")) | (F.col("code") != "acre"))
    row = lambda df, src, key, name: df.select(F.lit(src).alias("src"), F.col(key).cast("string").alias("rec_key"), F.lit(name).alias("field_name"), F.col("code").alias("unit_code"))
    return row(occ, "occ", "id", "size_sqft").unionByName(row(deal, "deal", "deal_id", "area_acres"))


def p7_floor_areas(spark, sf_dir: str) -> DataFrame:
    """Every occupational row's floor area in square feet, with the unit that it was recorded in and what says so."""
    places = place_rows(table(spark, sf_dir, "place_dim"))
    out = floor_units(table(spark, sf_dir, "raw_occupational_comps"), places)
    return out.select("id", "size_sqft", F.col("code").alias("unit_code"), F.round("sqft", 1).alias("sqft"), "evidence")
