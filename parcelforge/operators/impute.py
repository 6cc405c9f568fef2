"""Missing values filled by chained equations, with a mask of what was filled.

Every incomplete field has an equation that gives it from the others, fitted on observed values, and the
equations are run in turn, round after round, each on the fields as the others were filled last.

* Towns and postcodes: a classifier.  Each of its inputs (the unit, the street, the deal, the other field as
  filled so far) guesses the value that most of its other rows hold; the guesses vote with the log odds of
  being right, which are fitted each round on all rows that hold the field and lack another one: the classifier's
  log likelihood where guesses err independently.
* Numbers: a linear regression, on logarithmic scale, on the other numbers as filled so far and on the value
  that the unit (for rents per area: the letting) holds.  Where unit or letting hold values, the one nearest to
  the prediction is taken (predictive mean matching), else the prediction and a draw from the residual's spread.

Everything is fitted over all rows.  Rows that agree in all that the equations see are counted first and filled
alike: they share one combination, its count is its weight, and draws depend on the combination alone.  The
values of a unit come from its combinations in one pass over them.

Null, blank and placeholder texts and numbers not above zero are missing.  Ties go to the smaller value; equations
are fitted on observed targets only; a town or postcode that no input knows and a number that no row holds stay
null; masks stay as found at the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.address import Reading, is_missing
from parcelforge.functions.arrowmap import mapped
from parcelforge.operators.areas import OTHERS, RATIO, SQFT, _words, floor_unit
from parcelforge.operators.lettings import MARKS, cluster_signatures, signatures
from parcelforge.operators.places import level, of_level, place_rows, reader_of
from parcelforge.runtime import cut, table

#: Rounds of the chained equations.
ROUNDS = 2
#: Tiers of trust in a floor area: recorded in square feet, converted to them, of unknown unit.
TIERS = (3, 2, 1)
#: Least and most share of right guesses that an input of a classifier is credited with.
CREDIT = (0.51, 0.9999)

#: Inputs of the classifiers of towns and postcodes, beside the unit.
PLACE_EQUATIONS = {"town": [["postcode_filled"], ["street_id"], ["deal"]], "postcode": [["street_id"], ["deal", "town_filled"]]}

#: Inputs of the regressions, beside the value that unit or letting hold; yearly rents are filled only to serve the others.
NUMBER_EQUATIONS = {"size_sqft": ["rent_pa", "rent_psf"], "rent_psf": ["rent_pa", "size_sqft"], "rent_pa": ["size_sqft", "rent_psf"]}


def missing_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (c <= 0)


def moments(equations: dict[str, tuple[str, list[str]]], weight: Column, where: Column | None = None) -> list[Column]:
    """Aggregates for the normal equations of each named equation (target, inputs): sums of products over rows where all are known."""
    out = []
    for e, (target, inputs) in equations.items():
        known = F.col(target).isNotNull() if where is None else where & F.col(target).isNotNull()
        for c in inputs:
            known = known & F.col(c).isNotNull()
        terms = [None, *(F.col(c) for c in inputs), F.col(target)]
        for i, x in enumerate(terms):
            for j, y in enumerate(terms[i:], i):
                product = weight if y is None else y * weight if x is None else x * y * weight
                out.append(F.sum(F.when(known, product)).alias(f"{e}_{i}_{j}"))
    return out


def solve(rows: list, equations: dict[str, tuple[str, list[str]]]) -> dict[str, tuple[list[float], float]]:
    """Intercept and slopes, and residual standard deviation, of least squares for each equation, from rows of ``moments`` added up."""
    out = {}
    for e, (_, inputs) in equations.items():
        k = len(inputs) + 2
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = sum(r[f"{e}_{i}_{j}"] or 0.0 for r in rows)
        n = m[0, 0]
        if n <= k:
            out[e] = [0.0] * (k - 1), 0.0
            continue
        a, b = m[:-1, :-1], m[:-1, -1]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        rss = max(0.0, m[-1, -1] - 2 * beta @ b + beta @ a @ beta)
        out[e] = [float(x) for x in beta], float(np.sqrt(rss / max(1.0, n - k + 1)))
    return out


def regress(df: DataFrame, target: str, inputs: list[str]) -> tuple[list[float], float]:
    """Least squares of one equation."""
    equation = {"e": (target, inputs)}
    return solve([df.agg(*moments(equation, F.lit(1.0))).first()], equation)["e"]


def normal_draw(*keys: Column | str) -> Column:
    """A repeatable standard normal number of a row's keys."""
    u1 = (F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(1_000_003)) + 1) / F.lit(1_000_005.0)
    u2 = F.pmod(F.xxhash64(*keys, F.lit(2)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.lit(np.pi) * u2)


def log_odds(right: float | None, of: float | None) -> float:
    """What a guess counts that was right so often."""
    p = min(max(right / of, CREDIT[0]), CREDIT[1]) if right and of else CREDIT[0]
    return math.log(p / (1 - p))


#: Bits of the number of a town or of a postcode (seven digits of base 36).
_VALUE_BITS = 37


def guesses(known: DataFrame, keys: list[str], field: str, name: str) -> DataFrame:
    """(keys, <name>, <name>_m): in each group the value that most rows (``n``) hold, the smaller on ties, and how many do."""
    counts = known.dropna(subset=[*keys, field]).groupBy(*keys, field).agg(F.sum("n").alias("n"))
    # count and value in one number
    rank = F.shiftleft(level(F.col("n")), _VALUE_BITS).bitwiseOR(F.lit((1 << _VALUE_BITS) - 1) - F.col(field))
    top = counts.groupBy(*keys).agg(F.max(rank).alias("top"))
    value = F.lit((1 << _VALUE_BITS) - 1) - F.col("top").bitwiseAND((1 << _VALUE_BITS) - 1)
    return top.select(*keys, value.alias(name), F.round(of_level(F.shiftright("top", _VALUE_BITS))).cast("bigint").alias(f"{name}_m"))


def credits(df: DataFrame, field: str, inputs: list[str]) -> list[tuple[str, float]]:
    """(input, log odds of guessing right), tried on the rows that hold ``field``; a row that alone holds the value that it is guessed is no trial."""
    sums = []
    for g in inputs:
        fair = F.col(g).isNotNull() & F.col(field).isNotNull() & ~((F.col(g) == F.col(field)) & (F.col(f"{g}_m") <= F.col("n")))
        sums += [F.sum(F.when(fair & (F.col(g) == F.col(field)), F.col("n"))).alias(f"{g}_right"), F.sum(F.when(fair, F.col("n"))).alias(f"{g}_of")]
    row = df.agg(*sums).first()
    return [(g, log_odds(row[f"{g}_right"], row[f"{g}_of"])) for g in inputs]


def elected(votes: list[tuple[str, float]]) -> Column:
    """The value of the (column, weight) votes with the most weight; earlier columns on ties; null where all are."""
    total = lambda c: sum((F.when(F.col(c) == F.col(d), F.lit(w)).otherwise(0.0) for d, w in votes), F.lit(0.0))
    sides = [F.when(F.col(c).isNotNull(), F.struct(total(c).alias("w"), F.lit(-k).alias("k"), F.col(c).cast("bigint").alias("v"))) for k, (c, _) in enumerate(votes)]
    return F.greatest(*sides)["v"] if len(sides) > 1 else sides[0]["v"]


def chain_classifiers(df: DataFrame, key: str, equations: dict[str, list[list[str]]] = PLACE_EQUATIONS, rounds: int = ROUNDS) -> DataFrame:
    """(key, <field>_filled) of the rows that lack one of the fields (``equations``: field -> inputs, key columns of which may be filled fields), chained for ``rounds`` rounds.

    ``df`` has a row per combination with its count ``n``, the fields, the inputs' columns, and of the unit ``<field>_g``, its most frequent value, ``<field>_m`` and ``<field>_n``, how many rows hold that and any.
    """
    fields = [*equations]
    lacks = F.lit(False)
    for f in fields:
        lacks = lacks | F.col(f).isNull()
    kinds = dict(df.dtypes)
    inputs = sorted({k for levels in equations.values() for keys in levels for k in keys if not k.endswith("_filled")})
    both = [*inputs, *(f"{f}_filled" for f in fields), *fields, "n"]
    whole = cut(df.where(~lacks).groupBy(*inputs, *fields).agg(F.sum("n").alias("n")).withColumns({f"{f}_filled": F.col(f) for f in fields}))
    open_ = df.where(lacks).select(key, "n", *inputs, *fields, *(x for f in fields for x in (f"{f}_g", F.col(f"{f}_m").alias(f"{f}_g_m")))).withColumns({f"{f}_filled": F.coalesce(f, f"{f}_g") for f in fields})
    named = lambda f: {f"{f}_{i}": keys for i, keys in enumerate(equations[f])}
    changes = lambda keys: any(k.endswith("_filled") for k in keys)
    known = whole.select(*both).unionByName(open_.select(*both))
    for f in fields:
        for at, keys in named(f).items():
            if not changes(keys):
                open_ = open_.join(guesses(known, keys, f, at), keys, "left")
    open_ = cut(open_)
    for _ in range(rounds):
        for f in fields:
            known = whole.select(*both).unionByName(open_.select(*both))
            for at, keys in named(f).items():
                if changes(keys):
                    open_ = open_.join(guesses(known, keys, f, at), keys, "left")
            open_ = cut(open_)
            votes = credits(open_, f, [f"{f}_g", *named(f)])
            gone = [x for at, keys in named(f).items() if changes(keys) for x in (at, f"{at}_m")]
            open_ = open_.withColumn(f"{f}_filled", F.coalesce(F.col(f), elected(votes).cast(kinds[f]))).drop(*gone)
    return open_.select(key, *(f"{f}_filled" for f in fields))


def chain_regressions(df: DataFrame, key: str, equations: dict[str, list[str]] = NUMBER_EQUATIONS, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with ``<field>_filled`` of each numeric field (``equations``: field -> inputs), chained for ``rounds`` rounds.

    ``df`` has a row per combination with its count ``n`` and, of fields whose unit or letting may hold values, ``<field>_g``, the most
    frequent one, ``<field>_lo``, ``<field>_hi`` and ``<field>_m``, how many rows hold ``<field>_g``.  A field starts from that value, else from
    the mean of the held logarithms, so a row is filled whatever else it lacks.  A round fits all equations at once, on the
    fields as the round before left them, and then fills one field after the other.  A field whose equation can not be
    fitted keeps its start, one that no row holds stays null.
    """
    value = lambda c: F.log(F.when(F.col(c) > 0, F.col(c)))
    grouped = [f for f in equations if f"{f}_g" in df.columns]
    lacks = F.lit(False)
    for f in equations:
        lacks = lacks | F.col(f).isNull()
    own = {f: (f"{f}_y", [f"{x}_x" for x in xs]) for f, xs in equations.items()}
    lines = {**own, **{f"{f}_unit": (f"{f}_y", [f"{f}_u", *own[f][1]]) for f in grouped}}

    def logs(rows: DataFrame, filled: str) -> DataFrame:
        return rows.select(
            "n", *(value(f"{f}{filled}").alias(f"{f}_x") for f in equations), *(value(f).alias(f"{f}_y") for f in equations),
            # the value of a unit says something about a row only where other rows hold it
            *(F.when((F.col(f) != F.col(f"{f}_g")) | (F.col(f"{f}_m") > F.col("n")), value(f"{f}_g")).alias(f"{f}_u") for f in grouped),
        )

    # rows that lack nothing count the same in every round
    whole = F.lit(True)
    for f in equations:
        whole = whole & F.col(f"{f}_y").isNotNull()
    means = [x for f in equations for x in (F.sum(F.col(f"{f}_y") * F.col("n")).alias(f), F.sum(F.when(F.col(f"{f}_y").isNotNull(), F.col("n"))).alias(f"{f}_n"))]
    start = logs(df, "").agg(*means, *moments(lines, F.col("n"), whole)).first()
    mean = {f: F.lit(start[f] / start[f"{f}_n"] if start[f"{f}_n"] else None).cast("double") for f in equations}
    held = lambda f: [F.col(f"{f}_g")] if f in grouped else []
    done = df.where(~lacks).withColumns({f"{f}_filled": F.col(f) for f in equations})
    df = df.where(lacks).withColumns({f"{f}_filled": F.coalesce(f, *held(f), F.exp(mean[f])) for f in equations})
    for _ in range(rounds):
        fits = solve([start, logs(df, "_filled").agg(*moments(lines, F.col("n"))).first()], lines)
        for f, xs in equations.items():
            out = F.col(f"{f}_filled")
            beta, spread = fits[f]
            line = lambda b, cols: sum((F.lit(w) * value(c) for w, c in zip(b[1:], cols)), F.lit(b[0]))
            if any(beta):
                out = F.coalesce(F.exp(line(beta, [f"{x}_filled" for x in xs]) + F.lit(spread) * normal_draw(key, F.lit(f))), out)
            if f in grouped:
                beta, _ = fits[f"{f}_unit"]
                if any(beta):
                    guess = line(beta, [f"{f}_g", *(f"{x}_filled" for x in xs)])
                    donors = [F.struct(F.abs(value(f"{f}_{d}") - guess).alias("off"), F.lit(k).alias("k"), F.col(f"{f}_{d}").alias("v")) for k, d in enumerate(("g", "lo", "hi"))]
                    near = F.when(F.col(f"{f}_lo") == F.col(f"{f}_hi"), F.col(f"{f}_g")).otherwise(F.coalesce(F.least(*donors)["v"], F.col(f"{f}_g")))
                    out = F.when(F.col(f"{f}_g").isNotNull(), near).otherwise(out)
                else:
                    out = F.coalesce(f"{f}_g", out)
            df = df.withColumn(f"{f}_filled", F.coalesce(F.col(f), out))
    return df.unionByName(done)


_SEEN_IN = ["town", "postcode", "size_sqft", "rent_pa", "rent_psf", "notes"]
_SEEN = "own_town int, town_blank boolean, own_code bigint, code_blank boolean, own_size double, tier int"


def _observe(at: dict, reader) -> list[pa.Array]:
    """Number of the town among the place table's sorted names, full postcode as a number of base 36, floor area in square feet and the tier of trust in it."""
    names = {n: i for i, n in enumerate(sorted(set(reader.towns.values())))}
    town = mapped(at["town"], lambda t: None if is_missing(t) else names.get(reader.town(Reading(), t, None)), "town number", pa.int32())
    code = mapped(at["postcode"], lambda c: int(x.replace(" ", ""), 36) if not is_missing(c) and (x := reader.code_of_column(c)[0]) else None, "code number", pa.int64())
    blanks = [mapped(at[c], is_missing, "missing", pa.bool_()) for c in ("town", "postcode")]
    sizes, tiers = [], []
    for s, p, f, n in zip(*(at[c].to_pylist() for c in ("size_sqft", "rent_pa", "rent_psf", "notes"))):
        if s is None or not s > 0:
            sizes.append(None)
            tiers.append(None)
            continue
        unit = floor_unit(s, p, f, _words(n, OTHERS))[0]
        sizes.append(float(round(s * SQFT[unit or "sqft"])))
        tiers.append(3 if unit == "sqft" else 2 if unit else 1)
    return [town, blanks[0], code, blanks[1], pa.array(sizes, pa.float64()), pa.array(tiers, pa.int32())]


def code_text(c: str) -> Column:
    """The postcode that a number of base 36 stands for."""
    return F.regexp_replace(F.conv(F.col(c).cast("string"), 10, 36), "^(.+)(...)$", "$1 $2")


def tally(keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, most frequent value, the smaller on ties, rows that hold it, rows that hold any, least and greatest value) of the keys that hold a value; NaN is none."""
    some = ~np.isnan(values)
    k, v, n = keys[some], values[some], counts[some]
    by = np.lexsort((v, k))
    k, v, n = k[by], v[by], n[by]
    if not len(k):
        return k, v, n, n, v, v
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))))
    k, v, n = k[first], v[first], np.add.reduceat(n, first)
    group = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    top = np.lexsort((v, -n, k))[group]
    return k[group], v[top], n[top], np.add.reduceat(n, group), v[group], v[np.concatenate((group[1:], [len(k)])) - 1]


def spread_out(keys: np.ndarray, found: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """The columns of a ``tally`` for every row with a key; NaN and 0 where the key holds nothing."""
    at = np.searchsorted(found[0], keys)
    at[at == len(found[0])] = 0
    has = found[0][at] == keys if len(found[0]) else np.zeros(len(keys), dtype=bool)
    pick_ = lambda c, none: np.where(has, c[at], none) if len(c) else np.full(len(keys), none)
    g, m, n, lo, hi = found[1:]
    return [pick_(g, np.nan), pick_(m, 0), pick_(n, 0), pick_(lo, np.nan), pick_(hi, np.nan)]


def implied_scales(sizes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Square feet of the unit in which rents (yearly over per square foot) imply that a floor area was recorded; 1 where they do not agree on one."""
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = (least + most) / 2 / sizes
        off = np.abs(np.log(ratio[:, None] / np.array([*SQFT.values()])[None, :]))
    ok = (most <= least * 1.05) & (np.nanmin(np.where(np.isnan(off), np.inf, off), axis=1, initial=np.inf) < RATIO)
    return np.where(ok, np.array([*SQFT.values()])[np.argmax(off < RATIO, axis=1)], 1.0)


_HELD = [("town", "int"), ("postcode", "bigint"), ("size_sqft", "double"), ("rent_psf", "double")]
_HELD_SCHEMA = ", ".join(f"{f}_g {t}, {f}_m bigint, {f}_n bigint" + (f", {f}_lo {t}, {f}_hi {t}" if t == "double" else "") for f, t in _HELD)


def held_by_group(b: pa.RecordBatch) -> dict[str, pa.Array]:
    """Of whole units: what each unit holds of towns, postcodes and floor areas (of the best tier of trust), and each letting of rents per square foot."""
    names = b.schema.names
    at = lambda c: b.column(names.index(c))
    number = lambda c: at(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    units, lettings, n = at("unit_key").to_numpy(), at("letting_id").to_numpy(), at("n").to_numpy()
    sizes, tiers, rents, psf = (number(c) for c in ("size_sqft", "tier", "rent_pa", "rent_psf"))
    rents, psf = np.where(rents > 0, rents, np.nan), np.where(psf > 0, psf, np.nan)
    # floor areas: the best tier that the unit holds; how many hold any, of all tiers
    tier = np.where(np.isnan(sizes), np.nan, tiers)
    best = spread_out(units, tally(units, tier, n))[4]
    size = spread_out(units, tally(units, np.where(tier == best, sizes, np.nan), n))
    size[2] = spread_out(units, tally(units, np.where(np.isnan(sizes), np.nan, 0.0), n))[2]
    _, _, _, least, most = spread_out(units, tally(units, rents / psf, n))
    scale = np.where(best == TIERS[-1], implied_scales(size[0], least, most), 1.0)
    for k in (0, 3, 4):
        size[k] = np.where(scale == 1, size[k], np.round(size[k] * scale))
    found = {
        "town": spread_out(units, tally(units, number("town"), n)), "postcode": spread_out(units, tally(units, number("postcode"), n)),
        "size_sqft": size, "rent_psf": spread_out(lettings, tally(lettings, np.round(psf, 2), n)),
    }
    out = {}
    for f, t in _HELD:
        kind = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[t]
        g, m, k, lo, hi = found[f]
        value = lambda x: pa.array(x, pa.float64(), from_pandas=True).cast(kind)  # noqa: E731, B023
        out |= {f"{f}_g": value(g), f"{f}_m": pa.array(m.astype(np.int64)), f"{f}_n": pa.array(k.astype(np.int64))}
        if t == "double":
            out |= {f"{f}_lo": value(lo), f"{f}_hi": value(hi)}
    return out


def imputed_combinations(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, combinations): (id, cid) of each occupational row, and of each combination ``<field>_filled``, ``<field>_was_missing`` and ``<field>_n``, rows of the unit (rents per area: of the letting) that hold the field.

    Towns and postcodes are numbers on the way; a town that the place table does not know counts as held, but gives nothing.
    """
    places = place_rows(table(spark, sf_dir, "place_dim"))
    rows = signatures(table(spark, sf_dir, "raw_occupational_comps"), places, ["id"], (_SEEN_IN, _SEEN, _observe))
    seen = ["own_town", "town_blank", "own_code", "code_blank", "own_size", "tier"]
    rows = cut(rows.select("id", "unit_key", "sig", *MARKS, F.nullif("deal", F.xxhash64(F.lit(""))).alias("deal"), "street_id", *seen, F.xxhash64("sig", "street_id", *seen).alias("cid")))
    combos = rows.groupBy("unit_key", "sig", "cid", *MARKS, "deal", "street_id", *seen).agg(F.count("*").alias("n"))
    combos = combos.withColumnsRenamed({"own_town": "town", "own_code": "postcode", "own_size": "size_sqft"})
    held = cluster_signatures(combos, (_HELD_SCHEMA, held_by_group))
    usable = lambda c: F.when(~missing_number(F.col(c)), F.col(c))
    held = cut(held.select("cid", "n", "deal", "street_id", "town", "town_blank", "postcode", "code_blank", "size_sqft", usable("rent_pa").alias("rent_pa"), F.round(usable("rent_psf"), 2).alias("rent_psf"), *(x.split()[0] for x in _HELD_SCHEMA.split(", "))))
    places_ = chain_classifiers(held, "cid")
    numbers = chain_regressions(held, "cid")
    out = numbers.join(places_, "cid", "left").select(
        "cid", F.coalesce("town", "town_filled").alias("town_filled"), F.col("town_blank").alias("town_was_missing"), "town_n",
        F.coalesce("postcode", "postcode_filled").alias("postcode_filled"), F.col("code_blank").alias("postcode_was_missing"), "postcode_n",
        "size_sqft_filled", F.col("size_sqft").isNull().alias("size_sqft_was_missing"), "size_sqft_n", "rent_psf_filled", F.col("rent_psf").isNull().alias("rent_psf_was_missing"), "rent_psf_n",
    )
    names = sorted({n for n, _, _ in places if n})
    towns = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    return rows.select("id", "cid"), out.withColumns({"town_filled": F.try_element_at(towns, F.col("town_filled") + 1), "postcode_filled": code_text("postcode_filled")})


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Values that a row lacks and another row of its unit (rent per square foot: of its letting) holds, as filled."""
    rows, filled = imputed_combinations(spark, sf_dir)
    shown = {
        "town": F.col("town_filled"),
        "postcode": F.col("postcode_filled"),
        "size_sqft": F.col("size_sqft_filled").cast("decimal(18,0)").cast("string"),
        "rent_psf": F.col("rent_psf_filled").cast("decimal(18,2)").cast("string"),
    }
    cells = F.array_compact(F.array(*(F.when(F.col(f"{f}_was_missing") & (F.col(f"{f}_n") > 0) & c.isNotNull(), F.struct(F.lit(f).alias("field_name"), c.alias("filled"))) for f, c in shown.items())))
    asked = " or ".join(f"({f}_was_missing and {f}_n > 0)" for f in shown)
    filled = filled.where(asked).select("cid", cells.alias("cells"))
    return rows.join(filled, "cid").select("id", F.inline("cells"))


def p5_imputed(spark, sf_dir: str) -> DataFrame:
    """Every row with its four fields filled and masks of what was filled."""
    rows, filled = imputed_combinations(spark, sf_dir)
    fields = ["town", "postcode", "size_sqft", "rent_psf"]
    cells = [c for f in fields for c in (F.col(f"{f}_filled").alias(f) if f in ("town", "postcode") else F.round(f"{f}_filled", 2).alias(f), F.col(f"{f}_was_missing"))]
    return rows.join(filled.select("cid", *cells), "cid").drop("cid")
