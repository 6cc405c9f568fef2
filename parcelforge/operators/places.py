"""Premises identities: address readings, a street gazetteer clustered from the data, unit keys.

All of it grows with the data and stays distributed; only the place table (towns with their
outcodes, fixed and checked to be small) is handed to the workers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.address import AddressReader, estate_name, unit_code
from parcelforge.functions.arrowmap import mapped
from parcelforge.functions.names import deal_key, occupier_key
from parcelforge.runtime import cut

#: Most rows of a place table that are handed to every worker; a larger one is refused.
MAX_PLACES = 50_000
READING = "town string, number string, unit string, street string, stype string, pc string"

_readers: dict[tuple, AddressReader] = {}


def place_rows(places: DataFrame) -> tuple:
    """(name, county, outcode) of the place table, sorted; raises where it is larger than ``MAX_PLACES``."""
    rows = places.select("name", "county", "outcode").limit(MAX_PLACES + 1).collect()
    if len(rows) > MAX_PLACES:
        raise ValueError(f"the place table has more than {MAX_PLACES} rows")
    return tuple(sorted((r[0] or "", r[1] or "", r[2] or "") for r in rows))


def reader_of(rows: tuple) -> AddressReader:
    """One reader per worker process."""
    key = (len(rows), hash(rows))
    if key not in _readers:
        _readers.clear()
        _readers[key] = AddressReader(rows)
    return _readers[key]


def read_addresses(df: DataFrame, places: tuple, keep: list[str], address="address", town="town", postcode="postcode", unit_name=None, deal=None, tenant=None, more=None, full: bool = False) -> DataFrame:
    """The columns ``keep`` of each row and the parts of its address.

    ``town`` is what address, town column and postcodes together speak for, ``pc`` the full
    postcode of the address or else of the column.  With ``deal``, ``tenant`` and ``unit_name``
    also ``deal_key``, ``tenant_key`` and ``unit_col``.  Null or blank inputs give ''.
    ``more`` = (columns, schema, function): further columns made in the same pass from the Arrow columns named.
    With ``full`` also ``estate`` and ``rival``, the town that is spoken for next, and ``lead``, by how many votes the first leads.
    """
    extra = [(deal, "deal_key", deal_key), (tenant, "tenant_key", occupier_key), (unit_name, "unit_col", unit_code)]
    extra = [x for x in extra if x[0]]
    more_in, more_schema, more_of = more or ([], "", None)
    sources = list(dict.fromkeys([*keep, address, town, postcode, *(x[0] for x in extra), *more_in]))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*keep).dtypes), READING, *(f"{n} string" for _, n, _ in extra), *([more_schema] if more_schema else [])])
    names = [x.split()[0] for x in READING.split(", ")]
    full_schema = ["estate string", "rival string", "lead float"] if full else []
    schema = ", ".join([schema, *full_schema])
    more_names = [x.split()[0] for x in more_schema.split(", ") if x]

    def read(batches):
        reader = reader_of(places)
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(sources)}
            out, others = [], []
            for a, t, p in zip(at[address].to_pylist(), at[town].to_pylist(), at[postcode].to_pylist()):
                r = reader.read(a)
                place, *other = reader.towns_of(r, t, p)
                others.append((estate_name(r.estate) if full else "", *other))
                out.append((place, r.number, r.unit, r.street, r.street_type, r.postcode or reader.code_of_column(p)[0]))
            cols = list(zip(*out)) if out else [()] * len(names)
            made = [pa.array(c, pa.string()) for c in cols]
            made += [mapped(at[c], f, n) for c, n, f in extra]
            made += more_of({c: at[c] for c in more_in}, reader) if more_of else []
            if full:
                made += [pa.array([x[k] for x in others], t) for k, t in enumerate((pa.string(), pa.string(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(at[c] for c in keep), *made], [*keep, *names, *(n for _, n, _ in extra), *more_names, *(x.split()[0] for x in full_schema)])

    return df.select(*sources).mapInArrow(read, schema)


#: Bits of a spelling's number in the packed counts of ``_parents``; the upper half is the street's alone and breaks ties.
_BITS = 40


def _rank(street: str) -> Column:
    return F.xxhash64(street).bitwiseAND((1 << _BITS // 2) - 1)


def with_deletion(df: DataFrame) -> DataFrame:
    """Every row with ``less``: its ``street``, and the street without each of its letters in turn (twice the same where a letter is doubled)."""
    at = df.select("*", F.explode(F.sequence(F.lit(0), F.length("street"))).alias("_at"))
    less = F.when(F.col("_at") == 0, F.col("street")).otherwise(F.concat(F.col("street").substr(F.lit(1), F.col("_at") - 1), F.col("street").substr(F.col("_at") + 1, F.length("street"))))
    return at.withColumn("less", less).drop("_at")


#: Counts below 2^_EXACT keep their own level; above, levels rise by a 65,536th of a doubling, so that no count needs more than 23 bits.
_EXACT, _STEPS = 22, 65_536


def level(n: Column) -> Column:
    """A count of any size as a number of 23 bits that keeps the order."""
    high = (1 << _EXACT) + F.floor((F.log2(n) - _EXACT) * _STEPS)
    return F.when(n < (1 << _EXACT), n).otherwise(high).cast("bigint")


def of_level(n: Column) -> Column:
    """The count of a level, at most a 90,000th part too small."""
    return F.when(n < (1 << _EXACT), n.cast("double")).otherwise(F.pow(F.lit(2.0), F.lit(float(_EXACT)) + (n - (1 << _EXACT)) / _STEPS))


def _parents(spellings: DataFrame, within: list[str], ratio: float) -> DataFrame:
    """(within, street, parent): for each spelling the most frequent one at most two edits away that outnumbers it ``ratio`` times.

    Spellings meet on shared one-letter deletions, and each deletion keeps only its most frequent
    spelling, so no group is ever paired with itself.  The meeting runs on numbers: a deletion is a hash, a
    spelling its hash's low bits under its count's ``level``; texts are joined back to the few pairs found, and compared.
    """
    sid = F.shiftleft(_rank("street"), _BITS // 2).bitwiseOR(F.xxhash64(*within, "street").bitwiseAND((1 << _BITS // 2) - 1))
    words = spellings.select(*within, "street", "n", sid.alias("sid"))
    keys = with_deletion(words.select("sid", level(F.col("n")).alias("n"), *within, "street")).select("sid", "n", F.xxhash64(*within, "less").alias("key"))
    best = keys.groupBy("key").agg(F.max(F.shiftleft("n", _BITS).bitwiseOR(F.col("sid"))).alias("best"), F.count("*").alias("m")).where("m > 1").drop("m")
    found = keys.join(best, "key").select("sid", "n", F.col("best").bitwiseAND((1 << _BITS) - 1).alias("other"), F.shiftright("best", _BITS).alias("on"))
    found = found.where((F.col("sid") != F.col("other")) & (of_level(F.col("on")) >= of_level(F.col("n")) * ratio)).distinct()
    mine, theirs = words.select("sid", *within, "street"), words.select(F.col("sid").alias("other"), *within, F.col("street").alias("parent"), F.col("n").alias("pn"))
    pairs = found.select("sid", "other").join(mine, "sid").join(theirs, ["other", *within])
    pairs = pairs.where(F.levenshtein("parent", "street") <= 2)
    return pairs.groupBy(*within, "street").agg(F.max(F.struct("pn", "parent")).getField("parent").alias("parent"))


def street_gazetteer(readings: DataFrame) -> DataFrame:
    """(town, stype, street, canonical, street_id, n): every spelling of a street and the street it stands for.

    A spelling is taken for another street of its town and type if that one is at most two edits
    away and either has the same building number and is not rarer, or is three times as frequent.
    """
    known = readings.where("street <> '' and town <> ''")
    entries = known.groupBy("town", "stype", "street", "number").agg(F.count("*").alias("n"))
    entries = cut(entries)
    spellings = entries.groupBy("town", "stype", "street").agg(F.sum("n").alias("n"))
    same_number = _parents(entries, ["town", "stype", "number"], 1).groupBy("town", "stype", "street").agg(F.min("parent").alias("parent"))
    same_number = (
        same_number.join(spellings.withColumnRenamed("n", "n0"), ["town", "stype", "street"])
        .join(spellings.select("town", "stype", F.col("street").alias("parent"), F.col("n").alias("n1")), ["town", "stype", "parent"])
        .where((F.col("n1") > F.col("n0")) | (F.col("n1") == F.col("n0")) & (_rank("parent") > _rank("street")))
        .select("town", "stype", "street", "parent")
    )
    frequent = _parents(spellings, ["town", "stype"], 3)
    parent = frequent.unionByName(same_number).join(spellings.select("town", "stype", F.col("street").alias("parent"), F.col("n").alias("pn")), ["town", "stype", "parent"])
    parent = parent.groupBy("town", "stype", "street").agg(F.max(F.struct("pn", "parent")).getField("parent").alias("parent"))
    parent = cut(spellings.join(parent, ["town", "stype", "street"], "left"))
    up = parent.select("town", "stype", F.col("street").alias("parent"), F.col("parent").alias("grand"))
    return parent.join(up, ["town", "stype", "parent"], "left").select(
        "town", "stype", "street", F.coalesce("grand", "parent", "street").alias("canonical"), "n"
    ).withColumn("street_id", F.xxhash64("town", "stype", "canonical"))


def street_key() -> Column:
    """What names a spelling of a street of a town, null where no street is given; equal to the street's identifier where the spelling is its own."""
    return F.when((F.col("street") != "") & (F.col("town") != ""), F.xxhash64("town", "stype", "street"))


def corrections(gazetteer: DataFrame) -> DataFrame:
    """(skey, street_id) of the spellings that stand for another street."""
    return gazetteer.where("canonical <> street").select(F.xxhash64("town", "stype", "street").alias("skey"), "street_id")


def occupational_units(comps: DataFrame, places: tuple, keep: list[str], more=None) -> DataFrame:
    """``keep`` (and the columns that ``more`` makes) of each row of an occupational table with ``deal``, ``unit_key`` (hashes), ``street_id``, ``tenant_key`` and ``sure``.

    Rows with an address get town, street, number and unit.  Rows without one get the only unit
    that rows of the same deal, unit name and occupier - else of the same deal and unit name -
    denote; where that is ambiguous, or unknown, ``unit_key`` is made of deal, unit name and
    occupier and ``sure`` is false.
    """
    made = [x.split()[0] for x in (more[1] if more else "").split(", ") if x]
    keep_all = [*keep, *made]
    read = read_addresses(comps, places, keep, unit_name="unit_name", deal="source_deal", tenant="tenant_name", more=more)
    unit = F.when(F.col("unit") != "", F.col("unit")).otherwise(F.col("unit_col"))
    key = street_key()
    read = read.select(*keep_all, F.xxhash64("deal_key").alias("deal"), "tenant_key", F.xxhash64(unit).alias("unit"), "town", "stype", "street", "number", key.alias("skey"))
    read = cut(read)
    moved = corrections(street_gazetteer(read.select("town", "stype", "street", "number")))
    rows = read.select(*keep_all, "deal", "tenant_key", "unit", F.xxhash64("number").alias("number"), "skey")
    there = rows.where("skey is not null").join(moved, "skey", "left").withColumn("street_id", F.coalesce("street_id", "skey"))
    there = there.select(*keep_all, "deal", "tenant_key", "unit", "street_id", F.xxhash64("street_id", "number", "unit").alias("unit_key"), F.lit(True).alias("sure"))
    gone = rows.where("skey is null").withColumn("who", F.xxhash64("tenant_key"))
    asked = gone.select("deal", "unit").distinct()
    ids = rows.where("skey is not null").select("deal", "unit", "skey", "number", F.xxhash64("tenant_key").alias("who")).join(asked, ["deal", "unit"], "left_semi")
    ids = ids.join(moved, "skey", "left").withColumn("street_id", F.coalesce("street_id", "skey")).withColumn("unit_key", F.xxhash64("street_id", "number", "unit"))
    by_name = cut(ids.groupBy("deal", "unit", "who").agg(F.min("unit_key").alias("u1"), F.max("unit_key").alias("u2"), F.min("street_id").alias("st1"), F.max("street_id").alias("st2")))
    by_unit = by_name.groupBy("deal", "unit").agg(F.min("u1").alias("v1"), F.max("u2").alias("v2"), F.min("st1").alias("sv1"), F.max("st2").alias("sv2"))
    gone = gone.join(by_name.where(F.col("who") != F.xxhash64(F.lit(""))), ["deal", "unit", "who"], "left").join(by_unit, ["deal", "unit"], "left")
    only = lambda n: F.when(F.col(f"{n}1") == F.col(f"{n}2"), F.col(f"{n}1"))
    unit_key = F.coalesce(only("u"), only("v"))
    gone = gone.select(
        *keep_all, "deal", "tenant_key", "unit", F.coalesce(only("st"), only("sv")).alias("street_id"),
        F.coalesce(unit_key, F.xxhash64(F.lit("?"), "deal", "unit", "tenant_key")).alias("unit_key"), unit_key.isNotNull().alias("sure"),
    )
    return there.unionByName(gone)
