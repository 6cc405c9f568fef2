"""Records of two tables that describe the same properties without a common key.

Both tables are read into the same parts (name, phase, type, town, postcode), put into one order by
each of several composite sort keys, and compared inside a sliding window; fields are weighed into
a confidence.  Records of one table that are clearly the same property are taken together first;
between these, pairs are assigned one to one so that the total confidence is greatest, and every
record of an assigned pair of properties is reported.  An order is cut into blocks that overlap by
a window, so no block depends on how often a key occurs.

The assignment is exact: a pair at least as good as the best alternatives of both sides together
is settled at once; what is left falls into small components, each solved by the Hungarian method.

A record without name matches only by the same full postcode and town; one that lacks these too matches nothing; a missing town or postcode neither supports nor contradicts;
different phases of an estate never match; ties go to the smaller identifiers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.address import ESTATE_WORDS, OUTCODE, POSTCODE, Speller, distance, is_missing
from parcelforge.operators.places import place_rows, reader_of
from parcelforge.runtime import cut, table

#: Records compared with each record's followers in an order, and records of a block.
WINDOW, BLOCK = 12, 2000
#: Least confidence of a pair across the tables and of a pair within one.
ACROSS, WITHIN = 0.80, 0.86
#: Confidence of a pair of which one has no name, and town and full postcode agree.
NAMELESS = 0.80
#: Weights of the fields, and most edits between two names.
WEIGHTS = {"name": 0.6, "town": 0.2, "postcode": 0.15, "type": 0.05}
EDITS = 3
#: Most rounds of label passing in ``components``; a path of 2^ROUNDS records is read in them.
ROUNDS = 40

# Type words of estate names.
TYPES = {"industrial", "trading", "retail", "business", "distribution", "commercial", "enterprise", "logistics", "estate", "park", "centre", "works", "phase"}
_SPELL = Speller([t for t in TYPES if len(t) > 4])
_LEAD = re.compile(r"^\s*(?:(?:land|units?|property|premises|site|freehold)\s+(?:at|within|on)\s+|(?:multi-let|units?)\s*:?\s*(?:various|[\d\-– ,&to]+)\s*,\s*|units?\s+[\d\-–,& ]+\s*,\s*|the\s+)", re.I)
_PHASE = re.compile(r"\b(?:phase|ph)\b\.?\s*(\d+|iii|ii|iv|i|one|two|three|four)\b")
_NUMERALS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "one": "1", "two": "2", "three": "3", "four": "4"}
_SHORT = {"d.c": "distribution centre", "dc": "distribution centre", "b.p": "business park", **{k.strip("."): v for k, v in ESTATE_WORDS.items()}}


def read_name(text: str | None, reader) -> tuple[str, str, str]:
    """(name without spaces, type words, phase) of an estate's name, however ordered and abbreviated."""
    if is_missing(text):
        return "", "", ""
    s = " ".join(re.sub(r"[()\"]", " ", text.lower().replace(" ", " ")).split())
    for _ in range(3):
        s = _LEAD.sub("", s)
    phase = ""
    if m := _PHASE.search(s):
        phase = _NUMERALS.get(m[1], m[1])
        s = s[: m.start()] + " " + s[m.end() :]
    parts = []
    for seg in re.split(r",|\s[-–](?:\s|$)", s):
        words = seg.strip(" -.").split()
        if not words or reader.place(" ".join(words)):
            continue
        core, types = [], []
        for w in words:
            e = _SHORT.get(w.strip(".")) or w.strip(".")
            for y in e.split():
                z = y if y in TYPES else _SPELL.nearest(y) if len(y) > 4 else None
                (types if z else core).append(z or y)
        street = not types and len(words) > 1 and words[-1].strip(".") not in ("hill", "gardens", "grove", "square", "place") and reader.type_of(words[-1]) and distance(words[-1].strip("."), reader.type_of(words[-1]), 2) != 1
        parts.append((street, core, types))
    named = [p for p in parts if p[1] and not p[0]] or [p for p in parts if p[1]]
    core = [w for p in named for w in p[1]]
    return "".join(core), " ".join(sorted({w for p in parts for w in p[2] if w != "phase"})), "" if phase == "1" else phase


def read_code(text: str | None, address_code: str) -> str:
    """Full postcode, else outcode, of a postcode column, else of the address."""
    s = "" if is_missing(text) else " ".join(text.lower().split())
    if m := POSTCODE.search(s):
        return f"{m[1]} {m[2]}"
    if address_code:
        return address_code.lower()
    return m[1] if (m := OUTCODE.match(s)) else ""


def read_properties(df: DataFrame, key: str, side: int, places: tuple) -> DataFrame:
    """(uid, side, name, types, phase, town, code) of each record; ``uid`` is its key."""

    def run(batches):
        reader = reader_of(places)
        for b in batches:
            out = []
            for k, n, t, p, a in zip(*(b.column(i).to_pylist() for i in range(5))):
                r = reader.read(a)
                name, types, phase = read_name(n, reader)
                code = read_code(p, r.postcode)
                if name or " " in code:
                    own = [x for x in (reader.place(s.strip(" .")) for s in re.split(r"\s[-–]\s|,", (n or "").lower())) if x and x[0] == "town"]
                    r.towns += [x[1] for x in own]
                    out.append((k, name, types, phase, reader.town(r, t, p), code))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["uid", "name", "types", "phase", "town", "code"])

    read = df.select(key, "asset_name", "town", "postcode", "address").mapInArrow(run, "uid bigint, name string, types string, phase string, town string, code string")
    return read.withColumn("side", F.lit(side))


def code_likeness(a: str, b: str) -> float | None:
    if not a or not b:
        return None
    if a == b:
        return 1.0
    if a.split()[0] != b.split()[0]:
        return 0.0
    return 0.8 if " " not in a or " " not in b else 0.4


def letter_bits(name: str) -> int:
    """The set of a name's letters, as bits; letters beyond the basic ones share bits."""
    out = 0
    for c in set(name):
        out |= 1 << ord(c) % 64
    return out


_apart: dict[tuple[str, str], int] = {}


def name_distance(a: str, b: str) -> int:
    """``distance`` of two names; a worker remembers it, the same names meet in several orders."""
    if a == b:
        return 0
    key = (a, b) if a < b else (b, a)
    d = _apart.get(key)
    if d is None:
        if len(_apart) > 200_000:
            _apart.clear()
        d = _apart[key] = distance(a, b, EDITS)
    return d


def confidence(a: tuple, b: tuple) -> float:
    """Weighted likeness of two (name, types, phase, town, code); 0 where the names or phases differ, ``NAMELESS`` at most where a name is missing."""
    if not a[0] or not b[0]:
        return NAMELESS if a[3] and a[3] == b[3] and " " in a[4] and a[4] == b[4] else 0.0
    if a[2] != b[2]:
        return 0.0
    d = name_distance(a[0], b[0])
    if d > EDITS or d > 0.25 * min(len(a[0]), len(b[0])):
        return 0.0
    marks = [("name", 1 - d / max(len(a[0]), len(b[0])))]
    if a[3] and b[3]:
        marks.append(("town", float(a[3] == b[3])))
    if (c := code_likeness(a[4], b[4])) is not None:
        marks.append(("postcode", c))
    if a[1] and b[1]:
        x, y = set(a[1].split()), set(b[1].split())
        marks.append(("type", len(x & y) / min(len(x), len(y))))
    total = sum(WEIGHTS[f] for f, _ in marks)
    return sum(WEIGHTS[f] * v for f, v in marks) / total * (0.94 if len(marks) == 1 else 1.0)


def window_pairs(records: DataFrame, key, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b, side_a, side_b, conf) of the records at most ``window`` - 1 places apart in the order of ``key``."""
    spark = records.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = records.withColumn("key", key).repartitionByRange(n, "key", "uid").sortWithinPartitions("key", "uid")
    place = F.monotonically_increasing_id()
    ordered = cut(ordered.withColumn("part", F.shiftright(place, 33)).withColumn("pos", place.bitwiseAND((1 << 33) - 1)).drop("key"))
    # one row per partition of the order
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, m in sizes:
        offsets.append((p, total))
        total += m
    starts = spark.createDataFrame(offsets or [(0, 0)], "part bigint, start bigint")
    ranked = ordered.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("pos"))
    home = F.floor(F.col("rank") / block)
    both = F.when(F.col("rank") % block >= block - window + 1, F.array(home, home + 1)).otherwise(F.array(home))
    blocks = ranked.select("uid", "side", "name", "types", "phase", "town", "code", "rank", home.alias("home"), F.explode(both).alias("block"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group.column("rank").to_numpy()))
        cols = {c: group.column(c).to_pylist() for c in ("uid", "side", "name", "types", "phase", "town", "code")}
        fields = list(zip(*(cols[c] for c in ("name", "types", "phase", "town", "code"))))
        n = len(fields)
        new = group.column("home").to_numpy() == group.column("block").to_numpy()  # the others are the end of the block before
        sizes = np.array([len(x) for x in cols["name"]], dtype=np.int32)
        phases, towns, codes = (np.unique(np.array(cols[c], dtype=object).astype(str), return_inverse=True)[1] if n else sizes for c in ("phase", "town", "code"))
        letters = np.array([letter_bits(x) for x in cols["name"]], dtype=np.uint64)
        out = []
        for step in range(1, min(window, n)):
            i, j = slice(0, n - step), slice(step, n)
            least = np.minimum(sizes[i], sizes[j])
            most = np.minimum(EDITS, least // 4)
            # an edit changes the length by one and the set of letters by two at most
            same_place = (codes[i] == codes[j]) & (towns[i] == towns[j]) & ((sizes[i] == 0) | (sizes[j] == 0))
            may = new[j] & (same_place | (phases[i] == phases[j]) & (np.abs(sizes[i] - sizes[j]) <= most) & (np.bitwise_count(letters[i] ^ letters[j]) <= 2 * most))
            for k in np.flatnonzero(may).tolist():
                m = k + step
                c = confidence(fields[k], fields[m])
                if c >= ACROSS:
                    x, y = (cols["side"][k], cols["uid"][k]), (cols["side"][m], cols["uid"][m])
                    p, q = (x, y) if x <= y else (y, x)
                    out.append((p[1], q[1], p[0], q[0], c))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "b", "side_a", "side_b", "conf"])

    return blocks.groupBy("block").applyInArrow(compare, "a bigint, b bigint, side_a int, side_b int, conf double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected (a, b): the least node of its component; labels double their reach each round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    label = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(ROUNDS):
        near = both.join(label.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy("a").agg(F.min("r").alias("near"))
        new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = cut(new.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        moved = new.where("root <> old").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label
    raise RuntimeError("components did not settle")


def hungarian(weights) -> list[int]:
    """Column assigned to each row (or -1) so that the total of positive weights is greatest; rows by columns, no more rows than columns."""
    w = np.asarray(weights, dtype=float)
    n, m = w.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, way, open_ = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.ones(m + 1, dtype=bool)
        while True:
            open_[j0] = False
            i0 = row_of[j0]
            c = -w[i0 - 1] - u[i0] - v[1:]
            nearer = open_[1:] & (c < least[1:])
            least[1:][nearer], way[1:][nearer] = c[nearer], j0
            j1 = int(np.where(open_, least, np.inf).argmin())
            delta = least[j1]
            closed = ~open_
            u[row_of[closed]] += delta
            v[closed] -= delta
            least[open_] -= delta
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if (i := row_of[j]) and w[i - 1, j - 1] > 0:
            out[i - 1] = j - 1
    return out


def assign(edges: DataFrame) -> DataFrame:
    """The (a, b, conf) of a one-to-one choice of (a, b, conf) with the greatest total."""
    edges = cut(edges)
    best = lambda k: edges.groupBy(k).agg(F.slice(F.sort_array(F.collect_list("conf"), asc=False), 1, 2).alias("top"), F.count("*").alias("n"))
    # beside its own weight, the best other weight at each end
    other = lambda top: F.when(F.col(f"{top}.top")[0] > F.col("conf"), F.col(f"{top}.top")[0]).otherwise(F.coalesce(F.try_element_at(F.col(f"{top}.top"), F.lit(2)), F.lit(0.0)))
    at_a = best("a").select("a", F.struct("top").alias("ta"))
    at_b = best("b").select("b", F.struct("top").alias("tb"))
    seen = edges.join(at_a, "a").join(at_b, "b")
    safe = cut(seen.where((F.col("conf") > other("ta") + other("tb")) | (F.col("ta.top")[0] == F.col("conf")) & (F.size("ta.top") == 1) & (F.size("tb.top") == 1)).select("a", "b", "conf"))
    left = edges.join(safe.select("a"), "a", "left_anti").join(safe.select("b"), "b", "left_anti")
    left = cut(left)
    nodes = left.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b"))
    roots = components(nodes).where("node % 2 = 0").select((F.col("node") / 2).cast("bigint").alias("a"), "root")

    def solve(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("a").to_pylist(), group.column("b").to_pylist(), group.column("conf").to_pylist()))
        xs, ys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        ix, iy = {x: i for i, x in enumerate(xs)}, {y: i for i, y in enumerate(ys)}
        flip = len(xs) > len(ys)
        w = np.zeros((len(ys), len(xs)) if flip else (len(xs), len(ys)))
        for a, b, c in rows:
            i, j = (iy[b], ix[a]) if flip else (ix[a], iy[b])
            w[i, j] = max(w[i, j], c)
        out = [((xs[j], ys[i]) if flip else (xs[i], ys[j])) + (float(w[i, j]),) for i, j in enumerate(hungarian(w)) if j >= 0]
        cols = list(zip(*out)) if out else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "conf"])

    solved = left.join(roots, "a").groupBy("root").applyInArrow(solve, "a bigint, b bigint, conf double")
    return safe.unionByName(solved)


def matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, places: tuple) -> DataFrame:
    """(left_key, right_key, confidence) of every pair of records of one property."""
    records = cut(read_properties(left, left_key, 0, places).unionByName(read_properties(right, right_key, 1, places)))
    c = F.col
    keys = [
        F.concat_ws("|", "name", "phase", "town"),
        F.concat_ws("|", "town", "phase", "name"),
        F.concat_ws("|", F.when(c("code") != "", c("code")).otherwise(c("town")), "name", "phase"),
        F.concat_ws("|", F.reverse("name"), "phase", "town"),
    ]
    pairs = None
    for k in keys:
        p = window_pairs(records, k)
        pairs = p if pairs is None else pairs.unionByName(p)
    pairs = cut(pairs.groupBy("a", "b", "side_a", "side_b").agg(F.max("conf").alias("conf")))
    within = pairs.where((c("side_a") == c("side_b")) & (c("conf") >= WITHIN))
    # the two tables number their records apart; nodes carry their side
    node = lambda k, s: (c(k) * 2 + c(s)).alias(k)
    roots = components(within.select(node("a", "side_a"), node("b", "side_b")))
    entities = records.select((c("uid") * 2 + c("side")).alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("entity"))
    entities = cut(entities)
    across = pairs.where("side_a < side_b").select((c("a") * 2).alias("na"), (c("b") * 2 + 1).alias("nb"), "conf")
    across = across.join(entities.withColumnsRenamed({"node": "na", "entity": "ea"}), "na").join(entities.withColumnsRenamed({"node": "nb", "entity": "eb"}), "nb")
    edges = across.groupBy("ea", "eb").agg(F.max("conf").alias("conf")).withColumnsRenamed({"ea": "a", "eb": "b"})
    chosen = assign(edges)
    xs = entities.where("node % 2 = 0").select(c("entity").alias("a"), (c("node") / 2).cast("bigint").alias(left_key))
    ys = entities.where("node % 2 = 1").select(c("entity").alias("b"), ((c("node") - 1) / 2).cast("bigint").alias(right_key))
    return chosen.join(xs, "a").join(ys, "b").select(left_key, right_key, F.round("conf", 4).alias("confidence"))


def p3_matches(spark, sf_dir: str) -> DataFrame:
    """Pairs of deals and brochure deals of one property, with the confidence of their match."""
    places = place_rows(table(spark, sf_dir, "place_dim"))
    return matches(table(spark, sf_dir, "deals"), table(spark, sf_dir, "brochure_deals"), "deal_id", "brochure_deal_id", places)


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Every pair of rows for the same property."""
    return p3_matches(spark, sf_dir).select("deal_id", "brochure_deal_id")
