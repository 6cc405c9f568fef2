"""Which address records denote the same place.

A gazetteer of streets is built from the records themselves: spellings are clustered within each
locality (town), each cluster gets a street identifier, and with it the building numbers and
postcodes seen on it.  Every address is resolved by beam search over the gazetteer, part by part:

1. localities: the town that the record speaks for most, and the next one, at a price for its lag;
2. street types: the one read, and any other under which the locality knows the street, at a price;
3. streets: the spellings of locality and type within two edits, at a price for each edit;
4. building number and postcode: what other records of the street hold adds to a hypothesis.

After each part only the ``beam`` best hypotheses of an address go on.  Records with equal street
identifier, number and unit are the same place; without a number, those with equal street, estate and unit.

Null, blank and placeholder addresses are resolved to nothing and pair with nothing, as do those
with neither number nor estate; repeated rows pair like any others; ties between hypotheses go to the
nearer, then the more frequent street.  A building without unit differs from each unit in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.operators.places import place_rows, read_addresses, street_gazetteer, with_deletion
from parcelforge.runtime import cut, table

#: Hypotheses that are kept for an address at each step of the search.
BEAM = 4
#: What each vote by which a locality lags costs, a street type other than the one read, and one where none is read.
LAG_COST, TYPE_COST, UNTYPED_COST = 1.0, 2.5, 0.5
#: Most that a known building number and a known postcode of the street add to a hypothesis (n / (n + 1) of it for n other records), what each edit costs, and what each doubling of the street's records adds.
NUMBER_GAIN, POSTCODE_GAIN, EDIT_COST, RARE_GAIN = 2.0, 2.0, 1.0, 0.1


def prune(hypotheses: DataFrame, of: list[str], score: Column, beam: int) -> DataFrame:
    """The ``beam`` hypotheses of greatest ``score`` (larger on ties: the other columns, in order) of each ``of``; addresses with few go on as they are."""
    rest = [F.desc(c) for c in hypotheses.columns if c not in of]
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(score), *rest))
    return hypotheses.withColumn("_rank", rank).where(F.col("_rank") <= beam).drop("_rank")


def street_hypotheses(wanted: DataFrame, gazetteer: DataFrame, beam: int = BEAM) -> DataFrame:
    """(town, stype, street, street_id, edits, n): the ``beam`` nearest streets of the gazetteer for each spelling ``wanted`` of a town and type."""
    roots = gazetteer.groupBy("town", "stype", "canonical", "street_id").agg(F.sum("n").alias("n")).withColumnRenamed("canonical", "street")
    left = with_deletion(wanted.select("town", "stype", "street"))
    right = with_deletion(roots.select("town", "stype", "street", "street_id", "n")).withColumnRenamed("street", "root")
    near = left.join(right, ["town", "stype", "less"]).select("town", "stype", "street", "root", "street_id", "n").distinct()
    near = near.withColumn("edits", F.levenshtein("street", "root")).where("edits <= 2").drop("root")
    # a spelling that the gazetteer corrects stands for its street, however far
    own = gazetteer.join(roots.select("street_id", F.col("n").alias("rn")), "street_id").select("town", "stype", "street", "street_id", F.col("rn").alias("n"), F.levenshtein("street", "canonical").alias("edits"))
    own = own.join(wanted.select("town", "stype", "street"), ["town", "stype", "street"], "left_semi")
    near = near.unionByName(own).distinct()
    rank = F.row_number().over(Window.partitionBy("town", "stype", "street").orderBy("edits", F.desc("n"), "street_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= beam).drop("_rank")


def readings_of(asked: DataFrame, gazetteer: DataFrame, beam: int) -> DataFrame:
    """(sid, t, y, street, cost): localities and street types that each spelling ``asked`` (sid, town, rival, lead, stype, street) may mean, itself among them."""
    towns = F.array_compact(F.array(
        F.struct(F.col("town").alias("t"), F.lit(0.0).cast("float").alias("cost")),
        F.when(F.col("rival") != "", F.struct(F.col("rival").alias("t"), (F.lit(LAG_COST) * F.col("lead")).cast("float").alias("cost"))),
    ))
    places = asked.select("sid", "stype", "street", F.inline(towns))
    # a rival locality without any such street is no hypothesis
    known = cut(gazetteer.groupBy("town", "street").agg(F.sort_array(F.collect_set("stype")).alias("types")).withColumnsRenamed({"town": "t"}))
    at = places.join(known, ["t", "street"], "left").where("cost = 0 or types is not null")
    at = prune(at.select("sid", "t", "street", "stype", "types", "cost"), ["sid"], -F.col("cost"), beam)
    own = F.when(F.col("stype") == "", UNTYPED_COST).otherwise(TYPE_COST)
    types = F.array_union(F.array("stype"), F.coalesce("types", F.array().cast("array<string>")))
    typed = at.select("sid", "t", "street", "stype", "cost", F.explode(types).alias("y"))
    typed = typed.select("sid", "t", "y", "street", (F.col("cost") + F.when(F.col("y") == F.col("stype"), 0.0).otherwise(own)).alias("cost"))
    return prune(typed, ["sid"], -F.col("cost"), beam)


def resolve(readings: DataFrame, beam: int = BEAM) -> DataFrame:
    """``readings`` with ``street_id``, by beam search over the gazetteer that they themselves make; null for rows without street or town."""
    named = ["town", "stype", "street"]
    spoken = [*named, "rival", "lead"]
    sid = F.when((F.col("street") != "") & (F.col("town") != ""), F.xxhash64(*spoken))
    rows = readings.withColumn("sid", sid)
    with_street = rows.where("sid is not null")
    gazetteer = cut(street_gazetteer(with_street))
    asked = with_street.groupBy("sid").agg(*(F.first(c).alias(c) for c in spoken))
    hypotheses = cut(readings_of(cut(asked), gazetteer, beam))
    spellings = hypotheses.select(F.col("t").alias("town"), F.col("y").alias("stype"), "street").distinct()
    streets = street_hypotheses(cut(spellings), gazetteer, beam).withColumnsRenamed({"town": "t", "stype": "y"})
    found = hypotheses.join(streets, ["t", "y", "street"])
    merit = F.lit(RARE_GAIN) * F.log2(F.col("n") + 1) - F.col("cost") - F.lit(EDIT_COST) * F.col("edits")
    found = found.select("sid", merit.alias("merit"), (-F.col("edits")).alias("near"), "n", "street_id")
    found = found.groupBy("sid", "street_id").agg(F.max(F.struct("merit", "near", "n")).alias("m")).select("sid", "m.*", "street_id")
    found = cut(prune(found, ["sid"], F.col("merit"), beam))
    alone = cut(found.groupBy("sid").agg(F.count("*").alias("h"), F.max(F.struct("merit", "street_id")).getField("street_id").alias("only")))

    known = with_street.join(gazetteer.select(*named, "street_id"), named)
    numbers = known.groupBy("street_id", "number").agg(F.count("*").alias("on_number"))
    codes = known.where("pc <> ''").groupBy("street_id", "pc").agg(F.count("*").alias("on_code"))
    asked = known.join(alone.where("h > 1").select("sid"), "sid", "left_semi").groupBy("sid", "number", "pc").agg(F.first("street_id").alias("own_id"))
    last = asked.join(found, "sid").join(numbers, ["street_id", "number"], "left").join(codes, ["street_id", "pc"], "left")
    # the address that asks is no evidence for itself
    evidence = lambda c: F.coalesce(c, F.lit(0)) - F.when((F.col("own_id") == F.col("street_id")) & F.col(c).isNotNull(), 1).otherwise(0)
    gain = lambda c, most: F.lit(most) * evidence(c) / (evidence(c) + 1)
    # a blank number is on no street
    score = F.when(F.col("number") != "", gain("on_number", NUMBER_GAIN)).otherwise(0.0) + gain("on_code", POSTCODE_GAIN) + F.col("merit")
    best = last.groupBy("sid", "number", "pc").agg(F.max(F.struct(score.alias("score"), "near", "n", "street_id")).getField("street_id").alias("found"))
    out = rows.join(alone.select("sid", F.when(F.col("h") == 1, F.col("only")).alias("only")), "sid", "left")
    out = out.join(best, ["sid", "number", "pc"], "left")
    return out.withColumn("street_id", F.coalesce("only", "found")).drop("only", "found", "sid")


def place_key() -> Column:
    """What records of the same place share: street, number and unit; without number, street, estate and unit; null where nothing tells the place."""
    building = F.when((F.col("street_id").isNotNull()) & (F.col("number") != ""), F.xxhash64("street_id", "number", "unit"))
    return F.coalesce(building, F.when((F.col("estate") != "") & (F.col("town") != ""), F.xxhash64(F.lit("estate"), "town", F.coalesce("street_id", F.lit(0)), "estate", "unit")))


def address_records(spark, sf_dir: str) -> DataFrame:
    """(rec, address, town, postcode) of the three tables that hold addresses."""
    occ = table(spark, sf_dir, "raw_occupational_comps").select(F.concat(F.lit("occ-"), "id").alias("rec"), "address", "town", "postcode")
    inv = table(spark, sf_dir, "investment_comps").select(F.concat(F.lit("inv-"), "row_no").alias("rec"), "address", "town", F.lit(None).cast("string").alias("postcode"))
    deal = table(spark, sf_dir, "deals").select(F.concat(F.lit("deal-"), "deal_id").alias("rec"), "address", "town", "postcode")
    return occ.unionByName(inv).unionByName(deal).where("trim(address) <> ''")


def places_of(spark, sf_dir: str) -> DataFrame:
    """(rec, street_id, number, unit, town, stype, street): the resolved place of every address record."""
    read = cut(read_addresses(address_records(spark, sf_dir), place_rows(table(spark, sf_dir, "place_dim")), ["rec"], full=True))
    return resolve(read).select("rec", "street_id", "number", "unit", "town", "stype", "street", place_key().alias("place"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Every pair of address records that denote the same place, ``rec_a < rec_b``."""
    at = places_of(spark, sf_dir).where("place is not null").select("rec", "place")
    at = cut(at)
    a, b = at.select("place", F.col("rec").alias("rec_a")), at.select("place", F.col("rec").alias("rec_b"))
    return a.join(b, "place").where("rec_a < rec_b").select("rec_a", "rec_b")


def p1_places(spark, sf_dir: str) -> DataFrame:
    """One row per address record: the place it denotes and how many records denote it; null and null where nothing tells the place."""
    at = cut(places_of(spark, sf_dir))
    size = at.where("place is not null").groupBy("place").agg(F.count("*").alias("records"))
    return at.join(size, "place", "left").select("rec", "street_id", "number", "unit", "place", "records")
