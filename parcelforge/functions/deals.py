"""The first of many known deals that a deal matches by the five tiers, found without pairs: known deals stand in order, each search ends at the first that matches."""

from __future__ import annotations

from bisect import bisect_right
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np

from parcelforge.functions.similarity import _Texts

#: Share of the telling words of the deal that has fewer.
SHARED = 0.6
#: Names of more telling words are compared word by word, not looked up by pairs of words.
WORDS = 12
#: Known deals whose texts stay indexed.
INDEXED = 4096
REASONS = ("exact match", "postcode match", "contained", "word overlap", "alike")


class Deals:
    """Deals as arrays: name keys, telling words, the texts that likeness compares, towns and postcodes as compared; every deal has a name key."""

    def __init__(self, keys: list[str], words: list[list[str]], texts: list[str], towns: list[str], codes: list[str]):
        self.keys, self.words, self.texts, self.codes = keys, [frozenset(w) for w in words], texts, codes
        self.parts = [k.split(" ") for k in keys]
        number: dict[str, int] = {}
        self.town = np.array([-1 if t == "" or t.startswith("multi") else number.setdefault(t, len(number)) for t in towns], np.int64)
        t = _Texts([x or " " for x in texts])
        self.size, self.letters, self.pairs = t.size, t.letters, t.pairs
        known, letter = np.unique(t.codes, return_inverse=True)
        self.none = len(known)
        # letters of each text up to the 64th; longer texts are not bounded by their common subsequence
        self.letter = np.full((len(keys), int(min(64, t.size.max(initial=1)))), self.none, np.int32)
        row = np.repeat(np.arange(len(keys)), t.size)
        at = np.arange(len(t.codes)) - t.start[row]
        ok = at < self.letter.shape[1]
        self.letter[row[ok], at[ok]] = letter[ok]


class Known:
    """Some of ``deals``, in the order in which they were added."""

    def __init__(self, deals: Deals, least: float):
        self.d, self.least, self.n = deals, least, 0
        many = len(deals.keys)
        self.rows = np.empty(many, np.int64)
        self.town, self.size, self.letters = np.empty(many, np.int64), np.empty(many, np.int64), np.empty(many, np.uint64)
        self.exact: dict = {}  # by key: first of all; by key and town: first of the town
        self.code: dict[str, int] = {}
        self.any: dict[tuple, int] = {}  # by two words: first of all, first of three words at most, all others
        self.few: dict[tuple, int] = {}
        self.more: dict[tuple, list[int]] = {}
        self.wordy: list[int] = []
        self.text, self.starts, self.tail = "\n", [], []
        self.borders: dict[str, list[int]] = {}
        self.matchers: dict[int, SequenceMatcher] = {}

    def add(self, r: int) -> None:
        d, k = self.d, self.n
        self.rows[k], self.town[k], self.size[k], self.letters[k] = r, d.town[r], d.size[r], d.letters[r]
        key, words, parts = d.keys[r], d.words[r], d.parts[r]
        self.exact.setdefault(key, k)
        self.exact.setdefault((key, int(d.town[r])), k)
        if d.codes[r]:
            self.code.setdefault(d.codes[r], k)
        if len(words) > WORDS:
            self.wordy.append(k)
        elif len(words) > 1:
            for p in combinations(sorted(words), 2):
                self.any.setdefault(p, k)
                if len(words) <= 3:
                    self.few.setdefault(p, k)
                else:
                    self.more.setdefault(p, []).append(k)
        self.tail.append(key)
        if len(parts) > 1:
            self.borders.setdefault(f"{parts[0][-2:]} {parts[1][:2]}", []).append(k)
        self.n += 1

    def _all_text(self) -> str:
        """All keys in order, a line each; what was added last is put behind in large steps."""
        if self.tail and (len(self.tail) > 64 or not self.starts):
            at = len(self.text)
            for key in self.tail:
                self.starts.append(at)
                at += len(key) + 1
            self.text += "\n".join(self.tail) + "\n"
            self.tail = []
        return self.text

    def _contained(self, r: int, best: int) -> int:
        key, parts = self.d.keys[r], self.d.parts[r]
        if len(parts) > 1:  # the known one holds it
            text = self._all_text()
            at = text.find(key, 0, self.starts[best] if best < len(self.starts) else len(text))
            if at >= 0:
                best = min(best, bisect_right(self.starts, at) - 1)
            else:
                best = min([best, *(len(self.starts) + i for i, t in enumerate(self.tail) if key in t)])
            for left, right in zip(parts, parts[1:]):  # it holds the known one, and so what stands around that one's first space
                for i in {min(i, len(left)) for i in (1, 2)}:
                    for j in {min(j, len(right)) for j in (1, 2)}:
                        for k in self.borders.get(f"{left[-i:]} {right[:j]}", ()):
                            if k >= best:
                                break
                            if self.d.keys[self.rows[k]] in key:
                                best = k
                                break
        return best

    def _overlap(self, r: int, best: int) -> int:
        mine = self.d.words[r]
        shares = lambda k: (n := len(mine & (other := self.d.words[self.rows[k]]))) >= 2 and n / min(len(mine), len(other)) >= SHARED
        if len(mine) < 2:
            return best
        if len(mine) > WORDS:
            return next((k for k in range(min(best, self.n)) if shares(k)), best)
        pairs = list(combinations(sorted(mine), 2))
        # of three words at most two are share enough
        first = self.any if len(mine) <= 3 else self.few
        best = min([best, *(first[p] for p in pairs if p in first)])
        if len(mine) > 3:
            met: set[int] = set()
            for p in pairs:
                for k in self.more.get(p, ()):
                    if k >= best:
                        break
                    if k not in met:
                        met.add(k)
                        if shares(k):
                            best = k
                            break
        return next((k for k in self.wordy if k < best and shares(k)), best)

    def _common(self, r: int, k: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of the text of ``r``, of 64 letters at most, and of known ones."""
        d, n = self.d, int(self.d.size[r])
        where = np.zeros(d.none + 1, np.uint64)
        np.bitwise_or.at(where, d.letter[r, :n], np.uint64(1) << np.arange(n, dtype=np.uint64))
        where[d.none] = 0
        rows = self.rows[k]
        at = where[d.letter[rows, : int(min(64, d.size[rows].max()))]].T
        v = np.full(len(k), ~np.uint64(0))
        for m in at:
            u = v & m
            v = (v + u) | (v - u)
        return np.bitwise_count(~v & (~np.uint64(0) >> np.uint64(64 - n)))

    def _alike(self, r: int, best: int) -> int:
        d = self.d
        if not d.texts[r]:
            return best
        n, town, start, step = d.size[r], d.town[r], 0, 256
        end_ = min(best, self.n)
        while start < end_:
            end = min(end_, start + step)
            size = self.size[start:end]
            u = np.floor((1 - self.least) * (n + size) + 1e-9).astype(np.int64)
            ok = (np.abs(size - n) <= u) & (np.bitwise_count(self.letters[start:end] ^ d.letters[r]) <= u)
            if town >= 0:
                ok &= (self.town[start:end] == town) | (self.town[start:end] < 0)
            k = np.flatnonzero(ok) + start
            if len(k):
                u, rows = u[k - start], self.rows[k]
                ok = sum(np.bitwise_count(p[r] ^ p[rows]).astype(np.int64) for p in d.pairs) <= 3 * u
                k, u = k[ok], u[ok]
            if len(k) and n <= 64:
                ok = (n + self.size[k] - 2 * self._common(r, k).astype(np.int64) <= u) | (self.size[k] > 64)
                k = k[ok]
            for j in k.tolist():
                if (other := d.texts[self.rows[j]]) and self._ratio(d.texts[r], j, other) >= self.least:
                    return j
            start, step = end, step * 2
        return best

    def _ratio(self, text: str, k: int, other: str) -> float:
        m = self.matchers.get(k)
        if m is None:
            m = SequenceMatcher(None, "", other)
            if len(self.matchers) < INDEXED:
                self.matchers[k] = m
        m.set_seq1(text)
        return m.ratio()

    def first(self, r: int) -> tuple[int, int] | None:
        """(position, number of the reason) of the first known deal that ``r`` matches."""
        d, none = self.d, self.n
        key, town = d.keys[r], int(d.town[r])
        exact = self.exact.get(key, none) if town < 0 else min(self.exact.get((key, town), none), self.exact.get((key, -1), none))
        code = self.code.get(d.codes[r], none) if d.codes[r] else none
        best = min(exact, code)
        # later tiers need not look behind what earlier ones found
        contained = self._contained(r, best)
        best = min(best, contained)
        overlap = self._overlap(r, best)
        best = min(best, overlap)
        alike = self._alike(r, best)
        if alike < best:
            return alike, 4
        return next(((best, i) for i, k in enumerate((exact, code, contained, overlap)) if k == best), None) if best < none else None


def first_matches(deals: Deals, new: list[int], known: list[int], least: float) -> list[tuple[int, int, int]]:
    """(new, known, reason) of those of ``new`` that match one of ``known``: the first."""
    there = Known(deals, least)
    for r in known:
        there.add(r)
    out = []
    for r in new:
        if found := there.first(r):
            out.append((r, int(there.rows[found[0]]), found[1]))
    return out


def kept_first(deals: Deals, rows: list[int], least: float) -> list[tuple[int, int, int]]:
    """(row, kept row, reason) of all ``rows`` in turn: itself (-1), or the first kept before that it matches."""
    kept, out = Known(deals, least), []
    for r in rows:
        if found := kept.first(r):
            out.append((r, int(kept.rows[found[0]]), found[1]))
        else:
            kept.add(r)
            out.append((r, r, -1))
    return out
