"""Duplicate lettings and investment comparables by tolerance bands and likeness, earlier rows winning."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelforge.functions.dates import quarter_ordinal
from parcelforge.functions.deals import REASONS, Deals, first_matches, kept_first
from parcelforge.functions.numbers import close
from parcelforge.functions.postcodes import sheet_postcode, with_postcode
from parcelforge.functions.predicates import about_investment, contained, sorted_telling, vacant, words_overlap
from parcelforge.functions.similarity import can_reach, ratio
from parcelforge.functions.text import blank, name_key, strip, telling_words, tenant_key, unit_key
from parcelforge.operators.blocking import alike, band, band_pairs, name_candidates, rent_key
from parcelforge.operators.greedy import first_wins
from parcelforge.runtime import cut

#: Relative difference of two rents and of two prices, and likeness of tenants, addresses and deal names.
RENT, PRICE, TENANT, ADDRESS, DEAL = 0.005, 0.05, 0.90, 0.85, 0.65
#: Lettings that are compared with each other before their first ones take out later rows.
STRETCH = 200_000
#: Deals of the first stretch, and known deals that all new ones are compared with first; deals of the longest stretch; new and known deals of one task.
FIRST, LONGEST, NEW, HELD = 2048, 8192, 8192, 32768
#: Tenant keys of rows without tenant.
VACANT = ("vacant", "vacant under offer")
#: Fields that a kept letting may take from its duplicates.
LETTING_FIELDS = ["tenant_name", "unit_name", "address", "town", "postcode", "size_sqft", "rent_pa", "rent_psf", "lease_start", "lease_expiry", "break_date", "rent_review_date", "lease_term_years", "comp_date", "notes"]
#: Fields that an investment comparable may take from its duplicates.
INVESTMENT_FIELDS = ["date", "quarter", "town", "style", "address", "units", "area_sqft", "rent_pa", "rent_psf", "awultc", "price", "yield_niy", "reversionary_yield", "capval_psf", "vendor", "purchaser", "comment", "source_deal", "source_file_path"]


def flagged(comps: DataFrame) -> DataFrame:
    """``comps`` with keys and the flags that take a row out of the comparison: ``is_vacant``, ``is_investment``, ``no_rent``."""
    return comps.withColumns({
        "tenant": tenant_key(F.coalesce("tenant_name", F.lit(""))), "unit": unit_key(F.coalesce("unit_name", F.lit(""))),
        "is_vacant": vacant("tenant_name", "notes"), "is_investment": about_investment("notes"), "no_rent": F.col("rent_pa").isNull() & F.col("rent_psf").isNull(),
    })


def copies(rows: DataFrame) -> Column:
    """What rows agree in that the comparison can not tell apart."""
    return F.xxhash64("tenant", "unit", F.coalesce("rent_pa", F.lit(-1.0)), F.coalesce("rent_psf", F.lit(-1.0)))


def alike_tenants(rows: DataFrame, least: float = TENANT) -> DataFrame:
    """(x, y): different tenant keys, of rows with rents at most a band apart, of which ``ratio(x, y)`` is ``least`` or more; keys meet once in each band, however many rows have them."""
    at = rows.where("tenant <> ''").select(F.col("tenant").alias("text"), rent_key("rent_pa", "rent_psf", RENT).alias("k")).where("k.band is not null")
    at = cut(at.select("text", "k.kind", "k.band").distinct())
    near = at.select("text", "kind", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band")).distinct()  # of neighbouring bands one only is looked up in the other
    return cut(alike(at, near, least, ["kind", "band"], both=True).select("x", "y").distinct())


def _compared(comps: DataFrame) -> DataFrame:
    """The first (id) of each tenant, unit and rents that are compared."""
    rows = flagged(comps).where("not (is_vacant or is_investment or no_rent)")
    return cut(rows.groupBy("tenant", "unit", "rent_pa", "rent_psf").agg(F.min("id").alias("id")))


def _agreeing(rows: DataFrame, later: DataFrame, met: DataFrame) -> DataFrame:
    """(id_a, id_b, reason), id_a < id_b: those of ``rows`` and of ``later`` that agree; ``met`` are the tenants that are alike."""
    by = lambda key, why, via=None: band_pairs(rows, "id", [], "rent_pa", "rent_psf", RENT, [key], via, later).select("id_a", "id_b", F.lit(why).alias("reason"))
    return by("tenant", "tenant+rent").unionByName(by("unit", "unit+rent")).unionByName(by("tenant", "alike+rent", met))


def letting_pairs(comps: DataFrame) -> DataFrame:
    """(id_a, id_b, reason): rows with agreeing rents and the same tenant, the same unit, or tenants that are alike.

    Rows that agree in tenant, unit and rents stand in pairs as the first of them.
    """
    rows = _compared(comps)
    return _agreeing(rows, rows, alike_tenants(rows))


def first_lettings(rows: DataFrame, first: int | None = None) -> DataFrame:
    """(id, kept_id) of all ``rows`` (id, tenant, unit, rents): itself, or the first kept row that it agrees with.

    Pairs grow with the square of the rows, for there are few units; what a kept row replaces does not.  So rows are
    decided in stretches of ids, the first of about ``first`` rows (``STRETCH``), each next one as long as all before it: what the kept rows of a stretch
    replace goes before the later ones are compared with each other, which leaves these few pairs.
    """
    met, first = alike_tenants(rows), first or STRETCH
    many, ends = rows.count(), []
    while first < many:
        ends.append(first / many)
        first *= 2
    ends = [int(e) for e in rows.approxQuantile("id", ends, 0.001)] if ends else []
    out = []
    for end in [*ends, None]:
        part = rows if end is None else cut(rows.where(F.col("id") <= end))
        decided = cut(first_wins(part.select("id"), _agreeing(part, part, met).select("id_a", "id_b")))
        out.append(decided)
        if end is not None:
            stays, rest = part.join(decided.where("id = kept_id").select("id"), "id", "left_semi"), rows.where(F.col("id") > end)
            gone = cut(_agreeing(stays, rest, met).groupBy(F.col("id_b").alias("id")).agg(F.min("id_a").alias("kept_id")))
            out.append(gone)
            rows = cut(rest.join(gone, "id", "left_anti"))
    return reduce(DataFrame.unionByName, out)


def dedup_lettings(comps: DataFrame) -> DataFrame:
    """(id, kept_id, is_vacant, is_investment, no_rent) of every row; flagged rows keep themselves.

    Of rows that agree in tenant, unit and rents only the first is compared: what replaces it replaces them all,
    and where it stays it replaces the others - if a tenant or unit and a rent above zero are there to match by.
    """
    rows = flagged(comps)
    skip = F.col("is_vacant") | F.col("is_investment") | F.col("no_rent")
    match_ = (F.col("tenant") != "") | (F.col("unit") != "")
    rows = cut(rows.select("id", "is_vacant", "is_investment", "no_rent", F.when(~skip & match_ & rent_key("rent_pa", "rent_psf", RENT)["band"].isNotNull(), copies(rows)).alias("copy")))
    firsts = rows.where("copy is not null").groupBy("copy").agg(F.min("id").alias("first"))
    decided = first_lettings(_compared(comps)).withColumnsRenamed({"id": "first"})
    kept = firsts.join(decided, "first").select("copy", "kept_id")
    return rows.join(kept, "copy", "left").select("id", F.coalesce("kept_id", "id").alias("kept_id"), "is_vacant", "is_investment", "no_rent")


def dedup_summary(decided: DataFrame) -> DataFrame:
    """One row of counts; the categories of removed rows overlap."""
    gone = F.col("id") != F.col("kept_id")
    return decided.agg(
        F.count("*").alias("rows_scanned"), F.count_if(gone).alias("duplicate_pairs"), F.count_if("is_vacant").alias("vacant_rows"), F.count_if("is_investment").alias("inv_comp_rows"),
        F.count_if("no_rent").alias("no_rent_rows"), F.count_if(gone | F.col("is_vacant") | F.col("is_investment") | F.col("no_rent")).alias("rows_removed"),
    )


def addresses_alike(a: str, b: str) -> tuple[Column, Column, Column]:
    """(native decision, whether likeness may still decide, likeness)."""
    x, y = name_key(a), name_key(b)
    both = (x != "") & (y != "")
    return both & ((x == y) | contained(a, b) | words_overlap(a, b)), both & can_reach(x, y, ADDRESS), ratio(x, y)


def investment_rows(comps: DataFrame, key: str = "row_no") -> DataFrame:
    """(id, name, price, q): investment comparables with an address (``name``), price above zero and quarter's ordinal; zero is no price."""
    return comps.where(~blank("address")).select(F.col(key).alias("id"), F.col("address").alias("name"), F.nullif("price", F.lit(0.0)).alias("price"), quarter_ordinal("quarter").alias("q"))


def prices_agree() -> Column:
    """Both prices are close, or neither is known."""
    return close("price_a", "price_b", PRICE) | (F.col("price_a").isNull() & F.col("price_b").isNull())


def alike_addresses(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``investment_rows`` (columns of each with _a and _b) whose prices agree and whose addresses are alike; a's address is the one whose likeness is judged."""
    home = F.coalesce(band(F.col("price"), PRICE), F.lit(-1_000_000))  # all without price together
    around = F.when(F.col("price") > 0, F.sequence(home - 1, home + 1)).otherwise(F.array(home))
    met = name_candidates(left, right, name_key("name"), ADDRESS, meet=(around, home))
    side = lambda d, s: d.select(*(F.col(c).alias(f"{c}_{s}") for c in d.columns))
    pairs = met.join(side(left, "a"), "id_a").join(side(right, "b"), "id_b").where(prices_agree())
    sure, may, like = addresses_alike("name_a", "name_b")
    judged = pairs.withColumns({"sure": sure, "may": may})
    near = judged.where("not sure and may").withColumn("r", like).where(F.col("r") >= ADDRESS).drop("r")
    return judged.where("sure").unionByName(near).drop("sure", "may")


def investment_pairs(comps: DataFrame) -> DataFrame:
    """(id_a, id_b): investment comparables with agreeing price, quarters at most one apart, and alike addresses; candidates meet on addresses, so no price is a meeting point."""
    rows = cut(investment_rows(comps))
    pairs = alike_addresses(rows, rows).where("id_a < id_b")
    return pairs.where(F.coalesce(F.abs(F.col("q_a") - F.col("q_b")) <= 1, F.lit(True))).select("id_a", "id_b")


def insert_investments(existing: DataFrame, new: DataFrame, key: str = "row_no") -> DataFrame:
    """(id, action, match_id): what happens to each new investment comparable in turn: ``inserted``, or ``merged`` into or ``duplicate`` of the first row, existing or inserted before, that it matches.

    A row that matches fills the blank fields of the row it matches (``merged`` if it fills any).  A filled quarter is
    compared from then on; prices need not be followed, since a row without price matches none with one.
    Rows without address match nothing.  Decided as ``insert_batch`` decides, in rounds until nothing changes.
    """
    keyed = lambda d, fresh: d.withColumn("id", F.struct(F.lit(fresh).alias("fresh"), F.col(key).alias("id")))
    fields = [f for f in INVESTMENT_FIELDS if f in existing.columns and f in new.columns]
    both = keyed(existing, False).select("id", *dict.fromkeys([*fields, "address", "price", "quarter"])).unionByName(keyed(new, True).select("id", *dict.fromkeys([*fields, "address", "price", "quarter"])))
    text = {f for f, t in both.dtypes if t == "string"}
    blanks = F.array_compact(F.array(*(F.when(blank(f) if f in text else F.col(f).isNull(), F.lit(f)) for f in fields)))
    rows = cut(both.select("id", blanks.alias("blanks"), "address", "price", "quarter"))
    judged = cut(investment_rows(rows, "id"))
    # the later row's address is the one whose likeness is judged
    pairs = alike_addresses(judged.where("id.fresh"), judged).where("id_b < id_a").select(F.col("id_b").alias("a"), F.col("id_a").alias("b"), F.col("q_b").alias("q_a"), F.col("q_a").alias("q_b"))
    no_quarter = rows.select(F.col("id").alias("a"), (blank("quarter")).alias("open"))
    pairs = cut(pairs.join(no_quarter, "a"))
    near = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) <= 1, F.lit(True))
    pairs = pairs.where(near("q_a", "q_b"))
    gives = rows.select(F.col("id").alias("b"), F.col("blanks").alias("b_blanks"), (~blank("quarter")).alias("gives_q"), quarter_ordinal("quarter").alias("new_q"))
    takes = rows.select(F.col("id").alias("a"), F.col("blanks").alias("a_blanks"))
    last = fills = None
    while True:
        active = pairs
        if last is not None:
            active = pairs.join(last.select(F.col("b").alias("a")), "a", "left_anti").join(fills, "a", "left")
            active = active.where(~F.col("open") | F.col("from").isNull() | (F.col("from") >= F.col("b")) | near("held", "q_b"))
        best = cut(active.groupBy("b").agg(F.min("a").alias("a")))
        same = last is not None and best.join(last.withColumnRenamed("a", "was"), "b", "full").where(~F.col("a").eqNullSafe(F.col("was"))).limit(1).count() == 0
        if same:
            break
        last = best
        first = best.join(no_quarter.where("open"), "a").join(gives.where("gives_q"), "b").groupBy("a").agg(F.min(F.struct("b", "new_q")).alias("x"))
        fills = cut(first.select("a", F.col("x.b").alias("from"), F.col("x.new_q").alias("held")))
    given = best.join(gives, "b").join(takes, "a").select("a", "b", F.explode(F.array_except("a_blanks", "b_blanks")).alias("field"))
    merged = given.groupBy("a", "field").agg(F.min("b").alias("b")).select("b").distinct().withColumn("fills", F.lit(True))
    out = rows.where("id.fresh").select(F.col("id").alias("b")).join(best, "b", "left").join(merged, "b", "left")
    return out.select("b.id", F.when(F.col("a").isNull(), "inserted").when(F.col("fills"), "merged").otherwise("duplicate").alias("action"), F.col("a.id").alias("match_id"))


def with_copy(deals: DataFrame) -> DataFrame:
    """Deals with ``copy``, what those of equal name, town and postcode have in common; null without name, as such deals match nothing."""
    text = [F.coalesce(c, F.lit("")) for c in ("name", "town", "postcode")]
    out = deals.select("id", *(t.alias(c) for t, c in zip(text, ("name", "town", "postcode"))))
    return out.withColumn("copy", F.when(name_key("name") != "", F.sha2(F.concat_ws("\u0001", "name", "town", "postcode"), 256)))


def first_copies(deals: DataFrame) -> DataFrame:
    """Of deals with equal ``copy`` the first."""
    return cut(deals.where("copy is not null").groupBy("copy").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("name", "town", "postcode"))))


def _features(deals: DataFrame) -> DataFrame:
    """What ``functions.deals`` compares of deals with a name: id, key, words, text, town, code."""
    return deals.select("id", name_key("name").alias("key"), telling_words("name").alias("words"), sorted_telling("name").alias("text"), F.lower(strip("town")).alias("town"), F.upper(strip("postcode")).alias("code"))


def _in_tasks(sides: DataFrame, pieces: int, find) -> DataFrame:
    """(id, known_id, reason) of what ``find(deals, new rows, known rows)`` tells of each piece (i, j) of ``sides`` (features, known, i, j); known deals in the order of ids."""
    schema = T.StructType([T.StructField("id", sides.schema["id"].dataType), T.StructField("known_id", sides.schema["id"].dataType), T.StructField("reason", T.StringType())])
    types = to_arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        deals = Deals(*(group.column(c).to_pylist() for c in ("key", "words", "text", "town", "code")))
        known = group.column("known").to_pylist()
        ids = group.column("id").combine_chunks()
        if not isinstance(ids, pa.Array):
            ids = pa.concat_arrays(ids.chunks)
        plain = ids.to_pylist()
        order = sorted(range(len(known)), key=lambda k: tuple(plain[k].values()) if isinstance(plain[k], dict) else plain[k])
        found = find(deals, [k for k in order if not known[k]], [k for k in order if known[k]])
        at, to, why = zip(*found) if found else ((), (), ())
        take = lambda rows: ids.take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([take(at), take(to), pa.array([REASONS[w] if w >= 0 else None for w in why], pa.string())], names=types.names).cast(types)

    n = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes take long: the number of tasks must not follow the bytes
    return sides.repartition(max(n, pieces), "i", "j").groupBy("i", "j").applyInArrow(run, schema)


def _first_known(new: DataFrame, known: DataFrame, many: int, many_known: int) -> DataFrame:
    """(id, known_id, reason): the first of ``known`` (``_features``) that each of ``new`` matches; dealt to tasks in pieces, ``many`` and ``many_known`` are their rows."""
    j = max(-(-many_known // HELD), 1)
    i = max(min(many // 256, -(-24 // j)), -(-many // NEW), 1)
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = new.withColumns({"known": F.lit(False), "i": at(i)}).withColumn("j", each(j)).unionByName(known.withColumns({"known": F.lit(True), "j": at(j)}).withColumn("i", each(i)))
    found = _in_tasks(sides, i * j, lambda deals, rows, there: first_matches(deals, rows, there, DEAL))
    return found if j == 1 else found.groupBy("id").agg(F.min(F.struct("known_id", "reason")).alias("m")).select("id", "m.known_id", "m.reason")


def _kept_first(rows: DataFrame) -> DataFrame:
    """(id, known_id, reason) of one stretch of ``rows`` (``_features``), decided in one task in the order of ids: itself, or the first kept before it that it matches."""
    sides = rows.withColumns({"known": F.lit(False), "i": F.lit(0), "j": F.lit(0)})
    return _in_tasks(sides, 1, lambda deals, order, _: kept_first(deals, order, DEAL))


def lookup_deals(new: DataFrame, known: DataFrame) -> DataFrame:
    """(new_id, known_id, reason): the first known deal that each new one matches.  Both have id, name, town, postcode; new deals without match are left out.  Equal deals are compared once.

    No pairs are written.  All are compared with the first ``FIRST`` known deals, where most find theirs, only the others with the next ones, four times as many, and so on up to ``HELD``; then with all that are left.
    """
    new = cut(with_copy(new))
    a, b = first_copies(new), first_copies(with_copy(known))
    left, right = cut(_features(a)), cut(_features(b))
    many, held, size, best = left.count(), right.count(), FIRST, None
    while True:
        last = held <= size or size > HELD
        head = right if last else cut(right.orderBy("id").limit(size))
        found = _first_known(left, head, many, held if last else size)
        found = found if last else cut(found)
        best = found if best is None else best.unionByName(found)
        if last:
            break
        left, right = cut(left.join(found.select("id"), "id", "left_anti")), cut(right.join(head.select("id"), "id", "left_anti"))
        many, held, size = left.count(), held - size, size * 4
    best = best.join(a.select("id", "copy"), "id").drop("id")
    return new.select(F.col("id").alias("new_id"), "copy").join(best, "copy").select("new_id", "known_id", "reason")


def decide_deals(deals: DataFrame) -> DataFrame:
    """(id, kept_id, reason) of every deal: itself, or the first kept deal before it that it matches, and by what.

    Equal deals are compared as the first of them: what replaces it replaces them all, and where it stays the others are its copies.

    Pairs grow with the square of the deals, what stays does not.  So deals are decided in stretches of ids, each in one task; the first has ``FIRST`` deals, each next one
    twice as many up to ``LONGEST``.  What a stretch keeps takes out later deals, in all tasks, before the next stretch begins; no pairs are written.
    """
    rows = cut(with_copy(deals))
    firsts = first_copies(rows)
    rest, out, size = cut(_features(firsts)), None, FIRST
    many = rest.count()
    while True:
        part = cut(rest.orderBy("id").limit(size)) if many > size else rest
        found = cut(_kept_first(part))
        out = found if out is None else out.unionByName(found)
        if many <= size:
            break
        stays = part.join(found.where("id = known_id").select("id"), "id", "left_semi")
        rest = rest.join(part.select("id"), "id", "left_anti")
        gone = cut(_first_known(rest, stays, many - size, size))
        out = out.unionByName(gone)
        rest = cut(rest.join(gone.select("id"), "id", "left_anti"))
        many, size = rest.count(), min(2 * size, LONGEST)
    decided = out.select(F.col("id").alias("first"), F.col("known_id").alias("kept_id"), "reason")
    decided = decided.join(firsts.select(F.col("id").alias("first"), "copy"), "first")
    out = rows.select("id", "copy").join(decided, "copy", "left").withColumn("kept_id", F.coalesce("kept_id", "id"))
    return out.select("id", "kept_id", F.when(F.col("id") == F.col("kept_id"), None).when(F.col("kept_id") == F.col("first"), "exact match").otherwise(F.col("reason")).alias("reason"))


def append_deals(sheet: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that ``new`` deals (deal_id, the fields of a deal, has_brochure, brochure_scraped, comment, also_introduced_by) add to a ``sheet`` (row, asset_name, town, address).

    A deal that matches a row of the sheet, or a deal added before it, adds none; one without name is always added.
    The sheet keeps postcodes behind the address; yields become fractions; dates that are none stay text.
    """
    known = sheet.select(F.col("row").alias("id"), F.col("asset_name").alias("name"), "town", sheet_postcode("address").alias("postcode"))
    asked = new.select(F.col("deal_id").alias("id"), F.col("asset_name").alias("name"), "town", "postcode")
    there = cut(lookup_deals(asked, known))
    fresh = cut(asked.join(there.select(F.col("new_id").alias("id")), "id", "left_anti"))
    added = decide_deals(fresh).where("id = kept_id").select(F.col("id").alias("deal_id"))
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "Yes").otherwise("No").alias(c)
    share = lambda c: (F.col(c) / 100).alias(c)
    same = ["agent", "asset_name", "country", "town"]
    numbers = ["area_acres", "area_sqft", "rent_pa", "rent_psf", "asking_price"]
    return new.join(added, "deal_id").select(
        "deal_id", F.coalesce(F.date_format(F.try_to_date(strip("date"), "d/M/yyyy"), "yyyy-MM-dd"), "date").alias("date"), *same, with_postcode("address", "postcode").alias("address"), "classification",
        *numbers, share("net_yield"), share("reversionary_yield"), "capval_psf", F.lit("New").alias("status"), F.lit("No").alias("considered"), yes("has_brochure").alias("brochure_stored"), yes("brochure_scraped"),
        F.nullif("comment", F.lit("")).alias("comment"), F.nullif("also_introduced_by", F.lit("")).alias("also_introduced_by"),
    )


def _insert_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, phase, filled, key): row b is new, comes after row a and matches it in ``phase``; where ``filled`` names a field, only while a has ``key`` there from an earlier duplicate."""
    free = ~F.col("tenant").isin(*VACANT)
    keep = ["fresh", "tenant", "t_blank", "u_blank"]
    own = rows.withColumns({"tenant_k": F.when(free, F.col("tenant")).otherwise(""), "unit_k": F.col("unit")})
    # a blank field is taken from a duplicate, which matches by the other field: all that it may become are the values of the row's own matches
    old, new = own.where("not fresh"), own.where("fresh").where(free)
    pair = lambda df, equal, via=None: band_pairs(df, "id", keep, "rent_pa", "rent_psf", RENT, equal, via, new)
    none = F.lit(None).cast("string")
    shown = lambda df, phase, filled=none, key=none: df.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (phase if isinstance(phase, Column) else F.lit(phase)).alias("phase"), filled.alias("filled"), key.alias("key"))
    # each tenant is compared once with each other, however many rows have it: (earlier, later) by the later one's likeness to the earlier
    met = alike_tenants(own.select(F.col("tenant_k").alias("tenant"), "rent_pa", "rent_psf"))
    later = met.select(F.col("y").alias("x"), F.col("x").alias("y"))
    every = lambda df: shown(pair(df, ["tenant_k"]), 1).unionByName(shown(pair(df, ["unit_k"]), 2)).unionByName(shown(pair(df, ["tenant_k"], later), 3))
    # existing rows never go: of those that match a new row only the first may ever be its match, and of new ones only what comes before that
    least = cut(every(old).groupBy("b").agg(F.min(F.struct("phase", "a")).alias("least")))
    before = lambda df: df.join(least, "b", "left").where(F.col("least").isNull() | (F.struct("phase", "a") < F.col("least"))).drop("least")
    static = cut(before(every(new)).unionByName(shown(least.select("b", "least.*").withColumnsRenamed({"a": "id_a", "b": "id_b"}), F.col("phase"))))

    givers = rows.select(F.col("id").alias("b"), F.col("tenant").alias("new_tenant"), F.col("unit").alias("new_unit"), F.col("t_blank").alias("no_tenant"), F.col("u_blank").alias("no_unit"))
    open_ = rows.where("t_blank or u_blank").select(F.col("id").alias("a"), "rent_pa", "rent_psf", "t_blank", "u_blank")
    may = cut(static.select("a", "b").join(open_, "a").join(givers, "b"))
    agree = F.when(F.col("rent_pa").isNotNull() | F.col("pa_b").isNotNull(), close("rent_pa", "pa_b", RENT)).otherwise(close("rent_psf", "psf_b", RENT))
    takers = rows.where("id.fresh").where(free).select(F.col("id").alias("b"), F.col("rent_pa").alias("pa_b"), F.col("rent_psf").alias("psf_b"), F.col("tenant").alias("tenant_b"), F.col("unit").alias("unit_b"), rent_key("rent_pa", "rent_psf", RENT).alias("k"))
    cols = ["a", "rent_pa", "rent_psf"]
    bands = lambda df: df.withColumn("k0", rent_key("rent_pa", "rent_psf", RENT)).withColumn("near", F.explode(F.sequence(F.col("k0.band") - 1, F.col("k0.band") + 1))).withColumn("k", F.struct(F.col("k0.kind").alias("kind"), F.col("near").alias("band"))).drop("k0", "near")
    units = bands(may.where("u_blank and not no_unit and new_unit <> ''").select(*cols, F.col("new_unit").alias("key")).distinct())
    tenants = bands(may.where("t_blank and not no_tenant and new_tenant <> ''").select(*cols, F.col("new_tenant").alias("key")).distinct())
    late = lambda df, phase, field: df.where("a < b").where(agree).select("a", "b", F.lit(phase).alias("phase"), F.lit(field).alias("filled"), "key")
    by_unit = late(units.join(takers.withColumn("key", F.col("unit_b")), ["k", "key"]), 2, "unit")
    by_tenant = late(tenants.join(takers.withColumn("key", F.col("tenant_b")), ["k", "key"]), 1, "tenant")
    by_like = late(tenants.join(later.select(F.col("x").alias("key"), F.col("y").alias("tenant_b")), "key").join(takers, ["k", "tenant_b"]), 3, "tenant")
    return static.unionByName(before(by_unit.unionByName(by_tenant).unionByName(by_like)))


def insert_batch(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action, match_id): what happens to each new row in turn: ``inserted``, or ``merged`` into or ``duplicate`` of an existing or earlier inserted row.

    Existing rows come before all new ones, whatever their ids; new rows come in the order of ids.
    Phases in order: same tenant, same unit, alike tenants, each with agreeing rents and the first row; vacant rows are always inserted.
    A row that matches fills the blank fields of the row it matches (``merged`` if it fills any); later rows match the row as filled.

    The fold in order is the only fixed point of deciding all rows at once from the decisions and fills of the round
    before: each round settles at least the first row that is not settled yet, so the rounds end when nothing changes.
    """
    fields = [f for f in LETTING_FIELDS if f in existing.columns and f in new.columns]
    no = lambda d, f: blank(f) if dict(d.dtypes)[f] == "string" else F.col(f).isNull()
    keyed = lambda d, fresh: d.select(
        F.struct(F.lit(fresh).alias("fresh"), "id").alias("id"), F.lit(fresh).alias("fresh"), "rent_pa", "rent_psf",
        tenant_key(F.coalesce("tenant_name", F.lit(""))).alias("tenant"), unit_key(F.coalesce("unit_name", F.lit(""))).alias("unit"),
        no(d, "tenant_name").alias("t_blank"), no(d, "unit_name").alias("u_blank"), F.array_compact(F.array(*(F.when(no(d, f), F.lit(f)) for f in fields))).alias("blanks"),
    )
    rows = cut(keyed(existing, False).unionByName(keyed(new, True)))
    pairs = cut(_insert_pairs(rows))
    gives = rows.select(F.col("id").alias("b"), F.col("blanks").alias("b_blanks"), F.col("tenant").alias("new_tenant"), F.col("unit").alias("new_unit"))
    takes = rows.select(F.col("id").alias("a"), F.col("blanks").alias("a_blanks"))
    last = None
    while True:
        if last is None:
            active = pairs.where("filled is null")
        else:
            active = pairs.join(last.select(F.col("b").alias("a")), "a", "left_anti").join(fills, ["a", "filled"], "left").where((F.col("filled").isNull()) | ((F.col("from") < F.col("b")) & (F.col("key") == F.col("held"))))
        best = cut(active.groupBy("b").agg(F.min(F.struct("phase", "a")).getField("a").alias("a")))
        same = last is not None and best.join(last.withColumnRenamed("a", "was"), "b", "full").where(~F.col("a").eqNullSafe(F.col("was"))).limit(1).count() == 0
        # the first duplicate that holds a field fills it
        given = best.join(gives, "b").join(takes, "a").select("a", "b", "new_tenant", "new_unit", F.explode(F.array_except("a_blanks", "b_blanks")).alias("field"))
        if same:
            break
        last = best
        keys = given.where(F.col("field").isin("tenant_name", "unit_name")).groupBy("a", "field").agg(F.min(F.struct("b", "new_tenant", "new_unit")).alias("x"))
        tenant = F.col("field") == "tenant_name"
        fills = cut(keys.select("a", F.when(tenant, "tenant").otherwise("unit").alias("filled"), F.col("x.b").alias("from"), F.when(tenant, F.col("x.new_tenant")).otherwise(F.col("x.new_unit")).alias("held")))
    merged = given.groupBy("a", "field").agg(F.min("b").alias("b")).select("b").distinct().withColumn("fills", F.lit(True))
    out = rows.where("fresh").select(F.col("id").alias("b")).join(best, "b", "left").join(merged, "b", "left")
    return out.select("b.id", F.when(F.col("a").isNull(), "inserted").when(F.col("fills"), "merged").otherwise("duplicate").alias("action"), F.col("a.id").alias("match_id"))
