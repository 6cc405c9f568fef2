"""Documents packed into containers of fixed token capacity.

A text longer than the capacity is cut into full containers of its own and one remainder; everything
else stays whole.  The items are spread over shards of about ``SHARD`` items by a hash, and each
shard is packed by itself: a first assignment, then a local search that takes the emptiest bins one
after the other and moves their documents, or exchanges them one for one or two for one, into other
underfull bins, wherever that increases the sum of squared fills.  It ends where no move and no
exchange increases it any more; the sum is bounded, so it does end.  The number of
shards follows the number of items, so that the space lost at shard borders (less than a container
a shard) stays a constant, small share.

Null and empty texts have 0 tokens and take a place in a container without filling it.  Ties are
broken by fill, then bin number, then ``doc_id``; repeated texts are items of their own.  Limits that
are null or not above zero are refused.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.encoding import TOKENIZERS, count_tokens
from parcelforge.runtime import cut, table

#: Items that one task packs at a time.
SHARD = 20_000
#: Most rows of the table of limits, which is read on the driver.
MAX_LIMITS = 1000


class Bins:
    """Open bins of one shard, ordered by free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # (size, item) in each bin
        self.free: list[int] = []
        self.order: list[tuple[int, int]] = []  # (free, bin) of bins with free space, sorted
        # of every bin, to find partners at once: free space, and the smallest item that fills any (the capacity and more where there is none)
        self.spaces, self.least = np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int64)

    def open(self) -> int:
        if len(self.free) == len(self.spaces):
            self.spaces, self.least = (np.concatenate([x, np.zeros_like(x)]) for x in (self.spaces, self.least))
        self.spaces[len(self.free)], self.least[len(self.free)] = self.capacity, self.capacity + 1
        self.items.append([])
        self.free.append(self.capacity)
        insort(self.order, (self.capacity, len(self.free) - 1))
        return len(self.free) - 1

    def change(self, b: int, by: int) -> None:
        """Use ``by`` more of a bin's space."""
        if not by:
            return
        if self.free[b]:
            del self.order[bisect_left(self.order, (self.free[b], b))]
        self.free[b] -= by
        self.spaces[b] = self.free[b]
        if self.free[b]:
            insort(self.order, (self.free[b], b))

    def put(self, b: int, item: tuple[int, int]) -> None:
        self.items[b].append(item)
        if 0 < item[0] < self.least[b]:
            self.least[b] = item[0]
        self.change(b, item[0])

    def take(self, b: int, item: tuple[int, int]) -> None:
        self.items[b].remove(item)
        if item[0] == self.least[b]:
            self.least[b] = min((x[0] for x in self.items[b] if x[0]), default=self.capacity + 1)
        self.change(b, -item[0])

    def tightest(self, size: int, but: int = -1) -> int | None:
        """The bin with least free space that still holds ``size``."""
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            if self.order[i][1] != but:
                return self.order[i][1]
            i += 1
        return None

    def partners(self, b: int, size: int) -> list[int]:
        """The other bins, no emptier than b, that lack space for ``size`` but hold something smaller; most free space first."""
        n = len(self.free)
        free = self.spaces[:n]
        found = np.flatnonzero((self.least[:n] < size) & (free > 0) & (free < size) & (free <= self.free[b]))
        return [c for c in found[np.lexsort((-found, -free[found]))].tolist() if c != b]

    def fill(self, b: int) -> int:
        return self.capacity - self.free[b]


def first_assignment(sizes: list[tuple[int, int]], capacity: int) -> Bins:
    """Longest first, each into the tightest bin that holds it."""
    bins = Bins(capacity)
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        b = bins.tightest(size) if size else (0 if bins.items else None)
        bins.put(bins.open() if b is None else b, (size, item))
    return bins


def better_exchange(bins: Bins, b: int, x: tuple[int, int]) -> bool:
    """Exchange document x of bin b for one or two smaller ones of a fuller bin that it then fills better."""
    for c in bins.partners(b, x[0]):
        free = bins.free[c]
        least = x[0] - free  # what has to leave c, and leave it fuller than before
        here = sorted(y for y in bins.items[c] if 0 < y[0] < x[0])
        one = bisect_left(here, (least, -1))
        found = [here[one]] if one < len(here) else None
        best = here[one][0] if found else x[0]
        lo, hi = 0, len(here) - 1
        while lo < hi:
            two = here[lo][0] + here[hi][0]
            if two < least:
                lo += 1
            else:
                if two < best:
                    best, found = two, [here[lo], here[hi]]
                hi -= 1
        if not found or best >= x[0]:
            continue
        # squares grow iff c gains more than b loses: (fc + g)^2 + (fb - g)^2 with g = x - best
        gain = x[0] - best
        if bins.fill(c) + gain <= bins.fill(b):
            continue
        bins.take(b, x)
        for y in found:
            bins.take(c, y)
            bins.put(b, y)
        bins.put(c, x)
        return True
    return False


def improve(bins: Bins) -> None:
    """The local search; every step increases the sum of squared fills, until none does."""
    changed = True
    while changed:
        changed = False
        for b in [b for _, b in sorted(bins.order, reverse=True)]:
            if not bins.items[b] or not bins.free[b]:
                continue
            for x in sorted(bins.items[b], reverse=True):
                if not x[0]:
                    c = next((c for c in range(len(bins.items)) if c != b and bins.items[c]), None) if bins.fill(b) == 0 else None
                    if c is not None:
                        bins.items[b].remove(x)
                        bins.items[c].append(x)
                    continue
                c = bins.tightest(x[0], b)
                if c is not None and bins.fill(c) + x[0] > bins.fill(b):
                    bins.take(b, x)
                    bins.put(c, x)
                    changed = True
                elif better_exchange(bins, b, x):
                    changed = True


def pack(sizes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of (size, item); no size may exceed the capacity."""
    bins = first_assignment(sizes, capacity)
    improve(bins)
    return [b for b in bins.items if b]


def limits_of(limits: DataFrame) -> list[tuple[str, str, int]]:
    rows = limits.select("limit_name", "tokenizer", "capacity").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} container limits")
    if any(r[2] is None or r[2] <= 0 for r in rows):
        raise ValueError("a container's capacity must be above zero")
    return sorted((r[0], r[1], r[2]) for r in rows)


def pack_documents(docs: DataFrame, limits: list[tuple[str, str, int]], path: str = TOKENIZERS, shard: int = SHARD) -> DataFrame:
    """(limit_name, bin_id, doc_id, piece_no, first_token, tokens): one row for each piece of a document in each limit."""
    sized = None
    for name in sorted({t for _, t, _ in limits}):
        part = count_tokens(docs, path=path, name=name).withColumn("tokenizer", F.lit(name))
        sized = part if sized is None else sized.unionByName(part)
    sized = cut(sized)
    n = sized.where(F.col("tokenizer") == limits[0][1]).count()
    shards = max(1, -(-n // shard))
    names = F.array(*(F.struct(F.lit(a).alias("limit_name"), F.lit(t).alias("of"), F.lit(c).cast("bigint").alias("capacity")) for a, t, c in limits))
    rows = sized.select("doc_id", "tokens", "tokenizer", F.inline(names)).where("tokenizer = of")
    rows = rows.select("limit_name", "capacity", "doc_id", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(shards)).cast("int").alias("shard"))
    schema = "limit_name string, bin_id string, doc_id bigint, piece_no int, first_token bigint, tokens bigint"

    def run(key, batch):
        limit, capacity, number = key[0].as_py(), key[1].as_py(), key[2].as_py()
        ids, sizes = batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()
        out, rest, whole = [], [], 0
        for k, (d, s) in enumerate(zip(ids, sizes)):
            for p in range(s // capacity if s > capacity else 0):
                out.append((f"{number}-x{whole}", d, p, p * capacity, capacity))
                whole += 1
            left = s % capacity if s > capacity else s
            if left or s <= capacity:
                rest.append((left, k))
        for j, items in enumerate(pack(rest, capacity)):
            for size, k in items:
                full = sizes[k] // capacity if sizes[k] > capacity else 0
                out.append((f"{number}-{j}", ids[k], full, full * capacity, size))
        cols = list(zip(*out)) if out else [()] * 5
        return pa.table(
            {"limit_name": pa.array([limit] * len(out), pa.string()), "bin_id": pa.array(cols[0], pa.string()), "doc_id": pa.array(cols[1], pa.int64()), "piece_no": pa.array(cols[2], pa.int32()), "first_token": pa.array(cols[3], pa.int64()), "tokens": pa.array(cols[4], pa.int64())}
        )

    return rows.groupBy("limit_name", "capacity", "shard").applyInArrow(run, schema)


def p9_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's containers under every limit."""
    return pack_documents(table(spark, sf_dir, "documents"), limits_of(table(spark, sf_dir, "pack_limits")))


def p9_fill(spark, sf_dir: str) -> DataFrame:
    """Per limit: containers, tokens, the share of space used and the fewest containers that could do."""
    bins = p9_packing(spark, sf_dir).groupBy("limit_name", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    limits = table(spark, sf_dir, "pack_limits").select("limit_name", "capacity")
    out = bins.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"))
    out = out.join(limits, "limit_name")
    return out.select("limit_name", "capacity", "containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("used"))
