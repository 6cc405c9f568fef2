"""Which rows of an occupational table record one letting: same unit, occupier and lease.

Rows that agree in all that identifies a letting are first reduced to one signature, so that a
mass of copies never meets in one task; the signatures of a unit are then compared.  Two of them
are linked if their occupiers do not differ and their leases agree: starts and expiries at most ``WIDE`` days apart
(months, quarters and years count as spans), with the occupier, a rent or one date within ``NEAR`` days in support.  A signature without comparable date joins the one lease of the unit
that has its occupier and rent.  Null, blank and placeholder values never contradict; a row
without any of them forms a letting of its own.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.address import distance
from parcelforge.functions.arrowmap import mapped
from parcelforge.functions.flexdate import read_day
from parcelforge.operators.places import occupational_units
from parcelforge.runtime import cut

#: Days between two starts, or two expiries, of one lease: such that one alone is evidence, and at most.
NEAR, WIDE = 3, 45
#: Days that a month, quarter and year span.
SPAN = {"day": 0, "month": 30, "quarter": 91, "year": 365}
#: Relative difference of two rents of one lease.
RENT = 0.015

#: Day number of 1970-01-01.
EPOCH = date(1970, 1, 1).toordinal()


def span_of(text: str | None) -> tuple[int, int] | None:
    """(first day, last day), counted from 1970-01-01, of what a date text denotes, else None."""
    got = read_day(text)
    if got is None:
        return None
    first = got[0].toordinal() - EPOCH
    return first, first + SPAN[got[1]]


#: What a packed span's two low bits say.
KINDS = ["day", "month", "quarter", "year"]


def packed(text: str | None) -> int | None:
    """A date text as one number: first day * 4 + the kind of its span."""
    span = span_of(text)
    return None if span is None else span[0] * 4 + [SPAN[k] for k in KINDS].index(span[1] - span[0])


def unpacked(n: int | None) -> tuple[int, int] | None:
    return None if n is None else (n >> 2, (n >> 2) + SPAN[KINDS[n & 3]])


def first_day(c: str) -> Column:
    """The day on which a packed span begins."""
    return F.date_from_unix_date(F.shiftright(c, 2))


#: The lease's start and expiry as packed spans, made in the pass that reads addresses.
SPANS = (["lease_start", "lease_expiry"], "starts int, ends int", lambda at, reader: [mapped(at[c], packed, "span", pa.int32()) for c in ("lease_start", "lease_expiry")])


def with_spans(more=None):
    """``SPANS`` and further columns of the same kind as one."""
    if more is None:
        return SPANS
    return [*SPANS[0], *more[0]], f"{SPANS[1]}, {more[1]}", lambda at, reader: [*SPANS[2](at, reader), *more[2](at, reader)]


def gap(a: tuple[int, int] | None, b: tuple[int, int] | None) -> int | None:
    """Days between two spans, 0 where they overlap, None where one is unknown."""
    return None if a is None or b is None else max(0, a[0] - b[1], b[0] - a[1])


def close(a: float | None, b: float | None) -> bool | None:
    """Whether two positive numbers are nearly equal; None where one is missing or not above zero."""
    return None if not a or not b or a <= 0 or b <= 0 else abs(a - b) <= RENT * (a + b) / 2


def same_occupier(a: str, b: str) -> bool | None:
    """None where one is unknown."""
    return None if not a or not b else a == b or distance(a, b, 2) <= 2


def link(a, b) -> int:
    """2: one lease by its dates; 1: one lease by occupier and rent; 0: no evidence; -1: two leases.  a, b: (occupier, start, end, pa, psf)."""
    who = same_occupier(a[0], b[0])
    if who is False:
        return -1
    s, e = gap(a[1], b[1]), gap(a[2], b[2])
    pa_, psf = close(a[3], b[3]), close(a[4], b[4])
    rent = pa_ or psf
    if s is not None and e is not None:
        if s <= WIDE and e <= WIDE and (who or rent or s <= NEAR or e <= NEAR):
            return 2
        return 2 if min(s, e) <= NEAR and who and rent else -1
    if s is not None or e is not None:
        d = e if s is None else s
        if d > WIDE:
            return -1
        return 2 if who or rent or d <= NEAR else 0
    if rent and not (pa_ is False or psf is False):
        return 1
    return 0


def cluster(items: list[tuple]) -> list[int]:
    """Cluster number of each signature of one unit.  items: (occupier, start, end, pa, psf)."""
    n = len(items)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    against: set[tuple[int, int]] = set()
    weak: list[tuple[int, int]] = []
    for i in range(n):
        for j in range(i):
            k = link(items[i], items[j])
            if k == 2:
                root[find(i)] = find(j)
            elif k == 1:
                weak.append((j, i))
            elif k < 0:
                against.add((j, i))
    if weak:
        apart = {frozenset((find(i), find(j))) for i, j in against}
        dateless = [x[1] is None and x[2] is None for x in items]
        choices: dict[int, set[int]] = {}
        for i, j in weak:
            a, b = find(i), find(j)
            if a == b or frozenset((a, b)) in apart:
                continue
            if dateless[i] or not dateless[j]:
                choices.setdefault(a, set()).add(b)
            if dateless[j] or not dateless[i]:
                choices.setdefault(b, set()).add(a)
        for a, bs in sorted(choices.items()):  # a signature that dates do not place joins only where one lease fits
            roots = {find(b) for b in bs} - {find(a)}
            if len(roots) == 1 and frozenset((find(a), next(iter(roots)))) not in apart:
                root[find(a)] = roots.pop()
    return [find(i) for i in range(n)]


#: What a signature is made of, besides unit and deal.
MARKS = ["tenant_key", "starts", "ends", "rent_pa", "rent_psf"]


def _cluster_partition(names: list[str], more):
    """Adds ``letting_id`` (and what ``more`` makes of it) to rows that come sorted by unit; a unit may go over the end of a batch."""
    at = [names.index(c) for c in MARKS]

    def done(b):
        units, found = b.column(0).to_numpy(), b.column(1).to_numpy().copy()
        edges = np.flatnonzero(np.diff(units)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(units)]))
        several = ends - starts > 1
        rows = np.flatnonzero(np.repeat(several, ends - starts))
        who, starts_, ends_, rent, psf = (b.column(i).take(pa.array(rows)).to_pylist() for i in at)
        items = [(w, unpacked(s), unpacked(e), r, f) for w, s, e, r, f in zip(who, starts_, ends_, rent, psf)]
        k = 0
        for i, j in zip(starts[several].tolist(), ends[several].tolist()):
            name: dict[int, int] = {}
            groups = cluster(items[k : k + j - i])
            k += j - i
            for c, sig in zip(groups, found[i:j].tolist()):
                name[c] = min(name.get(c, sig), sig)
            found[i:j] = [name[c] for c in groups]
        b = pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*names, "letting_id"])
        if more:
            made = more[1](b)
            b = pa.RecordBatch.from_arrays([*b.columns, *made.values()], [*b.schema.names, *made])
        return b

    def run(batches):
        rest = None
        for b in batches:
            if rest is not None:
                b = pa.concat_batches([rest, b])
            if not b.num_rows:
                continue
            units = b.column(0).to_numpy()
            cut_at = int(np.flatnonzero(units != units[-1])[-1]) + 1 if units[0] != units[-1] else 0
            rest = b.slice(cut_at)
            if cut_at:
                yield done(b.slice(0, cut_at))
        if rest is not None:
            yield done(rest)

    return run


def signatures(comps: DataFrame, places: tuple, keep: list[str], more=None) -> DataFrame:
    """``keep`` and what ``more`` makes of each row, and unit, deal, ``MARKS`` and their hash ``sig``; rows that can not be placed are told apart by their dates."""
    need = list(dict.fromkeys(["id", *keep, "rent_pa", "rent_psf"]))
    rows = occupational_units(comps, places, need, with_spans(more))
    unsure = ~F.col("sure") & (F.col("tenant_key") == "")
    rows = rows.withColumn("unit_key", F.when(unsure, F.xxhash64("unit_key", "starts", "ends")).otherwise(F.col("unit_key")))
    return rows.withColumn("sig", F.xxhash64("unit_key", "deal", *MARKS))


def cluster_signatures(marks: DataFrame, more=None) -> DataFrame:
    """``marks`` (one row per signature, starting with unit_key and sig, with ``MARKS``) with ``letting_id``.

    ``more`` = (schema, function): further columns that the function makes of Arrow batches of whole units with ``letting_id``.
    """
    names = marks.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in marks.dtypes), "letting_id bigint", *([more[0]] if more else [])])
    return marks.repartition("unit_key").sortWithinPartitions("unit_key", "sig").mapInArrow(_cluster_partition(names, more), schema)


def letting_rows(comps: DataFrame, places: tuple, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with ``unit_key``, ``deal``, ``street_id`` and ``letting_id``."""
    rows = cut(signatures(comps, places, keep))
    marks = rows.groupBy("unit_key", "sig", *MARKS).agg(F.count("*").alias("n"))
    return rows.join(cluster_signatures(marks).select("sig", "letting_id"), "sig").drop("sig")
