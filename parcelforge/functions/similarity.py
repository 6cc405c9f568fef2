"""Sequence likeness (Ratcliff-Obershelp) as an Arrow function, and bounds that decide most pairs without it."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """2 M / T of the matching blocks, the second text being the one that is indexed; null where one is null."""
    out, matcher, last = [], SequenceMatcher(None, "", ""), None
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def _edits(a: Column, b: Column, least: float) -> Column:
    return F.floor((1 - least) * (F.length(a) + F.length(b)) + 1e-9).cast("int")


def lengths_reach(a: Column, b: Column, least: float) -> Column:
    """Whether two texts are near enough in length for the ratio to be ``least`` or more."""
    return F.abs(F.length(a) - F.length(b)) <= _edits(a, b, least)


def can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio can be ``least`` or more: a ratio r leaves at most (1 - r) T letters to insert or delete."""
    return lengths_reach(a, b, least) & (F.levenshtein(a, b) <= _edits(a, b, least))


class _Texts:
    """Texts as arrays: lengths, letters, and bits of the letters (a repeated one numbered) and of the pairs of neighbouring letters."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.start = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(texts)), self.size)
        order = np.lexsort((self.codes, row))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(row[order]) != 0) | (self.codes[order][1:] != self.codes[order][:-1])
        at = np.arange(len(order))
        again = np.empty(len(order), np.uint64)
        again[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        self.letters = self._bits(self.codes * np.uint64(37) + again * np.uint64(1_000_003))
        pair = self.codes * np.uint64(1_000_003) + np.append(self.codes[1:], np.uint64(0))
        pair[self.start + self.size - 1] = np.uint64(1 << 40)  # the last letter begins no pair: all texts have this bit
        half = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(bool)
        self.pairs = [self._bits(pair, half), self._bits(pair, ~half)]

    def _bits(self, features: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        bit = np.uint64(1) << (features * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58))
        return np.bitwise_or.reduceat(bit if only is None else np.where(only, bit, np.uint64(0)), self.start)


#: Words of 64 letters that common subsequences are counted in; longer texts are not bounded by them.
WORDS = 4


class _Common:
    """Lengths of the longest common subsequences of texts of x, of 64 * ``WORDS`` letters at most, and of y: no less than what the matching blocks hold."""

    def __init__(self, x: _Texts, y: _Texts):
        known, letter = np.unique(x.codes, return_inverse=True)
        self.x, self.y, self.none = x, y, len(known)
        row = np.repeat(np.arange(len(x.texts)), x.size)
        shift = np.arange(len(x.codes)) - x.start[row]
        words = int(min(WORDS, -(-x.size.max() // 64)))
        ok = shift < 64 * words
        self.where = np.zeros((words, len(x.texts), len(known) + 1), np.uint64)
        np.bitwise_or.at(self.where, (shift[ok] // 64, row[ok], letter[ok]), np.uint64(1) << (shift[ok] % 64).astype(np.uint64))
        found = np.minimum(np.searchsorted(known, y.codes), len(known) - 1)
        self.other = np.where(known[found] == y.codes, found, len(known))  # letters that x never has meet no bit

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            start, many, size = self.y.start[b], self.y.size[b], self.x.size[a]
            where = self.where[: -(-int(size.max()) // 64)]
            v = [np.full(len(a), ~np.uint64(0)) for _ in where]
            for t in range(int(many.max())):
                c = np.where(many > t, self.other[np.minimum(start + t, len(self.other) - 1)], self.none)
                carry = None
                for w, at in enumerate(where):
                    u = v[w] & at[a, c]
                    total = v[w] + u
                    if len(where) > 1:
                        over = total < u
                        if carry is not None:
                            total = total + carry
                            over |= total < carry
                        carry = over.astype(np.uint64)
                    v[w] = total | (v[w] - u)
            shared = 0
            for w, bits in enumerate(v):
                here = np.clip(size - 64 * w, 0, 64).astype(np.uint64)
                shared = shared + np.bitwise_count(~bits & np.where(here >= 64, ~np.uint64(0), (np.uint64(1) << (here & np.uint64(63))) - np.uint64(1))).astype(np.int64)
            out[k : k + (1 << 14)] = shared
        return out


def may_be_alike(xs: list[str], ys: list[str], least: float, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, most) of all texts, none empty, whose ``ratio(xs[i], ys[j])`` or ``ratio(ys[j], xs[i])`` can be ``least`` or more, and the most that it can be.

    A ratio r leaves u <= (1 - r) T letters without match.  Each changes one bit of the letters and three of the pairs
    of letters at most; what differs in more, or has a common subsequence too short, is never compared.
    """
    if not xs or not ys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    x, y = _Texts(xs), _Texts(ys)
    common = None
    by, rows = np.argsort(y.size, kind="stable"), np.argsort(x.size, kind="stable")
    sizes, letters, lengths = y.size[by], y.letters[by], x.size[rows]
    reach = lambda n, m: np.floor((1 - least) * (n + m) + 1e-9).astype(np.int64)
    got, k = [], 0
    while k < len(rows):
        n = lengths[k]
        end = np.searchsorted(lengths, n + n // 8, "right")  # texts of nearly one length together, by the longest one's bound
        near = np.flatnonzero((sizes - lengths[end - 1] <= reach(lengths[end - 1], sizes)) & (n - sizes <= reach(n, sizes)))
        if not len(near):
            k = end
            continue
        lo, hi = near[0], near[-1] + 1
        end = min(end, k + max(1, block // (hi - lo)))
        most = np.minimum(reach(lengths[end - 1], sizes[lo:hi]), 64).astype(np.uint8)
        a, b = np.divmod(np.flatnonzero(np.bitwise_count(x.letters[rows[k:end], None] ^ letters[None, lo:hi]) <= most), hi - lo)
        i, j = rows[k + a], by[lo + b]
        u = reach(x.size[i], y.size[j])
        ok = (np.abs(x.size[i] - y.size[j]) <= u) & (sum(np.bitwise_count(p[i] ^ q[j]).astype(np.int64) for p, q in zip(x.pairs, y.pairs)) <= 3 * u)
        i, j, u = i[ok], j[ok], u[ok]
        k, n = end, lengths[end - 1]
        if n <= 64 * WORDS and len(i):
            common = common or _Common(x, y)
            shared, both = common(i, j), x.size[i] + y.size[j]
            ok = both - 2 * shared <= u
            i, j, top = i[ok], j[ok], (2 * shared / both)[ok]
        else:
            top = np.ones(len(i))
        got.append((i, j, top))
    return tuple(np.concatenate(g) for g in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def alike_texts(xs: list[str], ys: list[str], least: float, where: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[int], list[int], list[float]]:
    """(i, j, r) of all different texts, none empty, whose ``ratio(xs[i], ys[j])`` is ``least`` or more; looked for in ``where`` (i, j) if given."""
    i, j = where or may_be_alike(xs, ys, least)[:2]
    order = np.lexsort((i, j))
    out, matcher, last = ([], [], []), SequenceMatcher(None, "", ""), None
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if xs[a] == ys[b]:
            continue
        if b != last:
            matcher.set_seq2(ys[b])
            last = b
        matcher.set_seq1(xs[a])
        if (r := matcher.ratio()) >= least:
            for o, v in zip(out, (a, b, r)):
                o.append(v)
    return out


def most_alike_texts(xs: list[str], ys: list[str], least: float) -> tuple[list[int], list[int], list[float]]:
    """(i, j, r) of ``alike_texts`` with the greatest r of each i, all of equals: what can be most alike is compared first, what can not reach the best is left out."""
    i, j, most = may_be_alike(xs, ys, least)
    order = np.lexsort((-most, i))
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    last, best, here = None, least, []

    def put():
        for b, r in here:
            if r == best:
                for o, v in zip(out, (last, b, r)):
                    o.append(v)

    for a, b, top in zip(i[order].tolist(), j[order].tolist(), most[order].tolist()):
        if a != last:
            put()
            last, best, here = a, least, []
        if top >= best - 1e-9 and xs[a] != ys[b] and (r := SequenceMatcher(None, xs[a], ys[b]).ratio()) >= best:
            best = r
            here.append((b, r))
    put()
    return out
