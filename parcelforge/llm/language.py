"""The language of every document and of each of its segments, by a recurrent network over bytes.

A bidirectional gated recurrent network reads the UTF-8 bytes of a text and labels every position
with a language; it is trained here, in numpy, by backpropagation through time, on sentences of a
bounded sample of the labelled documents (the ``SAMPLE`` with the least hash of
``doc_id``, and ``SAMPLE_EACH`` of each language).  Labels may be wrong: a sentence seen under several labels takes the most frequent one, and
twice during training the sentences that the network reads as another language are dropped.

A document is cut into sentences and lines.  Digits and names (capitalised words inside a
sentence) are replaced by one letter each, so that they speak for no language and equal sentences
are read once.  The positions' log-probabilities are pooled over words, a sentence's words over the
sentence, and a best path over the sentences (with a price ``SWITCH`` for each change) gives the
runs of one language; units are also cut between words, at twice that price.  Whole texts are read.

Null, empty and blank texts and texts without words have no language and give no row.  Labels are
compared by what they denote: codes of two or three letters, with or without region, and English names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.runtime import shared_folder, table

# The languages, and how labels write them.
LANGS = ["en", "de", "fr", "es", "it", "nl", "pt"]
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
}
#: Documents of any language, documents of each language, and sentences of each document, that the network may be trained on.
SAMPLE, SAMPLE_EACH, SENTENCES = 3000, 150, 12
#: Nats a position by which the network has to prefer another language to distrust a label.
CLEAR = 0.1
#: Width of the network, bytes of a training crop, sentences of a batch, steps, rate.
WIDTH, CROP, BATCH, STEPS, RATE = 32, 40, 96, 900, 0.015
#: Price of a change of language between two units, in nats, and most nats that one word adds.
SWITCH, PER_WORD = 8.0, 2.5
#: Words by which a line without full stop, perhaps a heading of names, counts less: n words count n * n / (n + NAMED).
NAMED = 3
#: Different units that a worker remembers.
REMEMBERED = 200_000
#: Bytes that are read at once, and bytes of the documents whose new units are gathered for that.
CELLS, GATHERED = 2_000_000, 8_000_000

_CODE = {n: c for c, names in NAMES.items() for n in names}
_UNITS = re.compile(r"[^\n]+")
_SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")
_NUMBER = re.compile(r"\d(?:[\d.,]*\d)?")
_NAME = re.compile(r"[A-Z](?<=[^\W\d_,;&'’] [A-Z])[\w&'’]*(?:[ -](?:[A-Z&][\w&'’]*))*")
_WORD = re.compile(r"[^\W\d_]{2,}")


def label_code(label: str | None) -> str | None:
    """The language that a label denotes; None for missing labels, other languages and anything else."""
    s = (label or "").strip().lower().replace("_", "-")
    return _CODE.get(s) or _CODE.get(s.split("-")[0])


def plain(unit: str) -> str:
    """A unit in the form that the network reads."""
    s = " ".join(unit.split())
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    low = s.lower()
    if s != low and s != s.upper():
        low = _NAME.sub("X", s).lower()
    return _NUMBER.sub("0", low).lstrip("-*•· ")


def units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences and lines of a text."""
    out = []
    for line in _UNITS.finditer(text):
        at, s = line.start(), line.group()
        i = 0
        for m in _SENTENCE_END.finditer(s):
            end = m.start() + 1
            out.append((at + i, at + end, s[i:end]))
            i = m.end()
        if s[i:].strip():
            out.append((at + i, at + len(s), s[i:]))
    return out


class Network:
    """Gated recurrent units in both directions over bytes; a linear layer labels every position."""

    def __init__(self, width: int = WIDTH, labels: int = len(LANGS), seed: int = 7):
        rng = np.random.default_rng(seed)
        h = width
        self.width = h
        self.p = {
            "E": rng.normal(0, 0.3, (2, 257, 3 * h)),  # what each byte adds to the three gates
            "U": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "b": np.concatenate([np.ones((2, 1, h)), np.zeros((2, 1, 2 * h))], axis=2),
            "W": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, labels)),
            "c": np.zeros(labels),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def batch(texts: list[bytes]):
        """(codes (2, n, t), lengths, order): both reading directions, padded with 256, and the places of the backward states."""
        n, t = len(texts), max(map(len, texts))
        codes = np.full((2, n, t), 256, dtype=np.int64)
        lengths = np.array([len(x) for x in texts])
        for i, x in enumerate(texts):
            a = np.frombuffer(x, dtype=np.uint8)
            codes[0, i, : len(a)] = a
            codes[1, i, : len(a)] = a[::-1]
        order = np.clip(lengths[:, None] - 1 - np.arange(t)[None, :], 0, None)
        return codes, lengths, order

    def forward(self, codes, order):
        """Logits (n, t, labels), and what the backward pass needs."""
        p = self.p
        states, saved = self._run(codes)
        back = np.take_along_axis(states[1].transpose(1, 0, 2), order[:, :, None], axis=1)
        both = np.concatenate([states[0].transpose(1, 0, 2), back], axis=2)
        return both @ p["W"] + p["c"], both, saved

    def _run(self, codes):
        """States (2, t, n, width) and what the backward pass needs of every step."""
        h, p = self.width, self.p
        n, t = codes.shape[1:]
        state = np.zeros((2, n, h), dtype=np.float32)
        states = np.empty((2, t, n, h), dtype=np.float32)
        saved = []
        rows = p["E"] + p["b"]
        two = np.arange(2)[:, None]
        for k in range(t):
            x = rows[two, codes[:, :, k]]
            a = np.matmul(state, p["U"])
            gates = 1 / (1 + np.exp(-(x[..., : 2 * h] + a[..., : 2 * h])))
            z, r = gates[..., :h], gates[..., h:]
            m = np.tanh(x[..., 2 * h :] + r * a[..., 2 * h :])
            new = m + z * (state - m)
            saved.append((state, z, r, m, a[..., 2 * h :]))
            state = states[:, k] = new
        return states, saved

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Logits (positions, labels) of texts, one behind the other; what several begin with, or end with, is read once."""
        lengths = np.array([len(x) for x in texts])
        ends = np.cumsum(lengths)
        last, parents, sizes, at = beginnings(texts)
        logits = self._votes(0, last, parents, sizes)[at]
        last, parents, sizes, at = beginnings([x[::-1] for x in texts])
        turned = np.repeat(2 * ends - lengths - 1, lengths) - np.arange(ends[-1])
        logits += self._votes(1, last, parents, sizes)[at[turned]]
        logits += self.p["c"].astype(np.float32)
        return logits

    def _votes(self, side: int, last, parents, sizes) -> np.ndarray:
        """What the state after each beginning adds to the labels; the logistic function by way of tanh, halves kept in the weights, no temporary arrays."""
        p, h = self.p, self.width
        rows = (p["E"][side] + p["b"][side]).astype(np.float32).reshape(-1, 3, h).transpose(1, 0, 2).copy()
        rows[:2] *= 0.5
        u = p["U"][side].astype(np.float32).reshape(h, 3, h).transpose(1, 0, 2) * np.float32(0.5)
        w = p["W"][side * h : (side + 1) * h].astype(np.float32)
        votes = np.empty((len(last), w.shape[1]), dtype=np.float32)
        most = int(sizes.max(initial=0))
        space = np.empty((8, most * h), dtype=np.float32)
        state, at = np.zeros((1, h), dtype=np.float32), 0
        for k, n in enumerate(sizes.tolist()):
            x, a = (space[i : i + 3, : n * h].reshape(3, n, h) for i in (0, 3))
            before = space[6, : n * h].reshape(n, h)
            np.take(state, parents[at : at + n] if k else np.zeros(n, dtype=np.intp), axis=0, out=before, mode="clip")
            for i in range(3):
                np.take(rows[i], last[at : at + n], axis=0, out=x[i], mode="clip")
                np.matmul(before, u[i], out=a[i])
            g, m = x[:2], x[2]
            g += a[:2]
            np.tanh(g, out=g)
            g += 1
            a[2] *= g[1]
            m += a[2]
            np.tanh(m, out=m)
            before -= m
            before *= g[0]
            before *= 0.5
            state = np.add(m, before, out=space[7, : n * h].reshape(n, h))
            np.matmul(state, w, out=votes[at : at + n])
            at += n
        return votes

    def gradients(self, texts: list[bytes], labels: np.ndarray):
        """(loss, gradients) of the mean cross-entropy over all positions, by backpropagation through time."""
        h, p = self.width, self.p
        codes, lengths, order = self.batch(texts)
        n, t = codes.shape[1:]
        logits, both, saved = self.forward(codes, order)
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        inside = (np.arange(t)[None, :] < lengths[:, None]).astype(np.float32)
        total = inside.sum()
        at = np.arange(n)
        loss = -(np.log(prob[at, :, labels] + 1e-9) * inside).sum() / total
        prob[at, :, labels] -= 1
        d_logits = prob * (inside / total)[:, :, None]
        g = {"W": both.reshape(-1, 2 * h).T @ d_logits.reshape(-1, d_logits.shape[2]), "c": d_logits.sum((0, 1))}
        d_both = d_logits @ p["W"].T
        d_back = np.zeros((n, t, h), dtype=np.float32)
        np.put_along_axis(d_back, order[:, :, None], d_both[..., h:] * inside[:, :, None], axis=1)
        # padded places all point to 0; put the true first one again
        d_back[at, order[:, 0]] = d_both[at, 0, h:]
        d_out = np.stack([d_both[..., :h], d_back]).transpose(2, 0, 1, 3)
        g["U"], d_x = np.zeros_like(p["U"]), np.empty((t, 2, n, 3 * h), dtype=np.float32)
        d_state = np.zeros((2, n, h), dtype=np.float32)
        for k in range(t - 1, -1, -1):
            before, z, r, m, am = saved[k]
            d = d_state + d_out[k]
            d_m = d * (1 - z) * (1 - m * m)
            d_z = d * (before - m) * z * (1 - z)
            d_r = d_m * am * r * (1 - r)
            d_x[k] = np.concatenate([d_z, d_r, d_m], axis=2)
            d_a = np.concatenate([d_z, d_r, d_m * r], axis=2)
            g["U"] += np.matmul(before.transpose(0, 2, 1), d_a)
            d_state = d * z + np.matmul(d_a, p["U"].transpose(0, 2, 1))
        g["b"] = d_x.sum((0, 2))[:, None, :]
        g["E"] = np.zeros_like(p["E"])
        for side in range(2):  # the sums of equal bytes
            at_ = codes[side].T.reshape(-1)
            by = np.argsort(at_, kind="stable")
            first = np.flatnonzero(np.diff(at_[by], prepend=-1))
            g["E"][side][at_[by][first]] = np.add.reduceat(d_x[:, side].reshape(-1, 3 * h)[by], first, axis=0)
        return loss, g


def train(examples: list[tuple[str, int]], steps: int = STEPS, seed: int = 11) -> Network:
    """A network fitted to (plain unit, language number) examples; Adam, with a falling rate.  Languages are drawn by the square root of their examples."""
    rng = np.random.default_rng(seed)
    net = Network()
    if not examples:
        return net
    data = agreed(examples)
    by = {y: [t for t, z in data if z == y] for y in sorted({y for _, y in data})}
    every = by
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        if step in (steps // 2, 3 * steps // 4):
            by = {y: trusted(net, ts, y) or ts for y, ts in every.items()}
        langs = sorted(by)
        share = np.sqrt([len(by[y]) for y in langs])
        texts, labels = [], []
        for y in rng.choice(langs, BATCH, p=share / share.sum()):
            t = by[y][rng.integers(len(by[y]))]
            s = rng.integers(max(1, len(t) - CROP + 1))
            texts.append(t[s : s + CROP])
            labels.append(y)
        _, g = net.gradients(texts, np.array(labels))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, x in g.items():
            x = x * min(1.0, 1.0 / (norm + 1e-9))
            m1[k] += 0.1 * (x - m1[k])
            m2[k] += 0.01 * (x * x - m2[k])
            net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def agreed(examples: list[tuple[str, int]]) -> list[tuple[bytes, int]]:
    """Each different unit once, with the language that most of the documents it was seen in are labelled with; units without majority are left out."""
    seen: dict[str, dict[int, int]] = {}
    for t, y in examples:
        if t:
            seen.setdefault(t, {}).setdefault(y, 0)
            seen[t][y] += 1
    out = []
    for t, counts in seen.items():
        y = max(counts, key=lambda k: (counts[k], -k))
        if 2 * counts[y] > sum(counts.values()):
            out.append((t.encode(), y))
    return sorted(out)


def trusted(net: Network, texts: list[bytes], label: int) -> list[bytes]:
    """Those that the network does not clearly (by ``CLEAR`` nats a position) read as another language than their label's."""
    out = []
    for part in batches(texts):
        pooled = pool(net, part)
        out += [t for t, v in zip(part, pooled) if v[label] > v.max() - CLEAR]
    return sorted(out)


def beginnings(texts: list[bytes]):
    """The different beginnings of texts, shorter ones first: (their last bytes, the places of the beginnings one byte shorter among those of that length,
    how many there are of each length), and the beginning that each position of each text ends, text behind text.
    """
    by = sorted(range(len(texts)), key=texts.__getitem__)
    lengths = np.array([len(texts[i]) for i in by])
    inside = np.arange(lengths.max()) < lengths[:, None]
    codes = np.full(inside.shape, 256, dtype=np.int16)
    codes[inside] = np.frombuffer(b"".join([texts[i] for i in by]), dtype=np.uint8)
    new = inside.copy()  # sorted, so texts that begin alike follow each other: where a text has left the one before it
    new[1:] &= np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
    rank = np.cumsum(new, axis=0, dtype=np.int32) - 1
    sizes = new.sum(axis=0)
    length, text = np.nonzero(new.T)
    last, parents = codes[text, length].astype(np.intp), rank[text, length - 1].astype(np.intp)
    found = (rank + (np.cumsum(sizes) - sizes))[inside]
    begin = np.zeros(len(texts), dtype=np.int64)
    begin[by] = lengths
    begin = np.cumsum(begin) - begin
    at = np.empty(len(found), dtype=np.int64)
    at[np.repeat(begin[by] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(found))] = found
    return last, parents, sizes, at


def batches(texts: list):
    """``texts`` in batches of like length, of at most ``CELLS`` bytes if all were as long as the longest."""
    texts = sorted(texts, key=lambda u: (len(u), u))
    i = 0
    while i < len(texts):
        j = i + 1
        while j < len(texts) and (j - i + 1) * len(texts[j]) <= CELLS:
            j += 1
        yield texts[i:j]
        i = j


def log_probabilities(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, labels) of texts, one behind the other, and the texts' lengths."""
    logits = net.read(texts)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), np.array([len(t) for t in texts])


def pool(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean log-probability of each language over the positions of each text."""
    lp, lengths = log_probabilities(net, texts)
    sums = np.concatenate([np.zeros((1, lp.shape[1])), np.cumsum(lp, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)[:, None]


def word_scores(net: Network, texts: list[str]) -> list[np.ndarray]:
    """For each text (words, languages): the positions' log-probabilities pooled over each word of two letters or more, neutral words left out, at most ``PER_WORD`` below the best."""
    lp, lengths = log_probabilities(net, [t.encode() for t in texts])
    sums = np.concatenate([np.zeros((1, lp.shape[1])), np.cumsum(lp, axis=0, dtype=np.float64)])
    whole = "\n".join(texts)
    at = np.array([m.span() for m in _WORD.finditer(whole)], dtype=np.int64).reshape(-1, 2)
    if not whole.isascii():  # from letters to bytes
        codes = np.frombuffer(whole.encode(), dtype=np.uint8)
        at = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))[at]
    number = np.searchsorted(np.cumsum(lengths + 1), at[:, 0], side="right")  # of the word's text, and of the line feeds before it
    at = at - number[:, None]
    rows = (sums[at[:, 1]] - sums[at[:, 0]]) / (at[:, 1] - at[:, 0])[:, None]
    rows = np.maximum(rows - rows.max(axis=1, keepdims=True), -PER_WORD)
    return np.split(rows, np.cumsum(np.bincount(number, minlength=len(texts)))[:-1])


def best_path(scores: np.ndarray, switch: float = SWITCH) -> list[int]:
    """The languages of a sequence of score rows, with a price for each change; the first on ties."""
    rows = scores.tolist()
    value, came = rows[0], []
    for row in rows[1:]:
        top = value.index(max(value))
        least = value[top] - switch
        came.append([i if v >= least else top for i, v in enumerate(value)])
        value = [(v if v >= least else least) + x for v, x in zip(value, row)]
    path = [value.index(max(value))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]


class Reader:
    """Segments of texts by a network; remembers the units it has read."""

    def __init__(self, net: Network):
        self.net = net
        self.memory: dict[str, list] = {}

    def learn(self, wanted: set[str]) -> None:
        """Read the units that are not known yet, in batches of like length."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        for part in batches([u for u in wanted if u not in self.memory]):
            for u, w in zip(part, word_scores(self.net, part)):
                self.memory[u] = self.parts(w if u.rstrip().endswith((".", "!", "?")) else w * (len(w) / (len(w) + NAMED)))

    @staticmethod
    def parts(words: np.ndarray) -> list[tuple[float, float, int, np.ndarray]]:
        """(from, to, best language, scores) of the parts of a unit, as shares of its words: one, or several where it changes its language.

        The best word is worth 0, so no cut pays its price where one language is less than that behind.
        """
        n = len(words)
        if not n:
            return []
        total = words.sum(0)
        if total.max() >= -2 * SWITCH:
            return [(0.0, 1.0, int(total.argmax()), total)]
        path = best_path(words, 2 * SWITCH)
        cuts = [0, *(i for i in range(1, n) if path[i] != path[i - 1]), n]
        totals = [words[a:b].sum(0) for a, b in zip(cuts, cuts[1:])]
        return [(a / n, b / n, int(t.argmax()), t) for a, b, t in zip(cuts, cuts[1:], totals)]

    def segments(self, found: list[tuple[int, int, str]]) -> list[tuple[str, int, int, float]]:
        """(language, start, end, confidence) of the longest runs of one language."""
        spans, best, rows = [], [], []
        for start, end, u in found:
            for a, b, y, s in self.memory[u]:
                spans.append((start + int(a * (end - start)), start + int(b * (end - start))))
                best.append(y)
                rows.append(s)
        if not rows:
            return []
        # where every unit speaks for the same language, so does the best path
        path = best if best.count(best[0]) == len(best) else best_path(np.array(rows))
        out, i = [], 0
        for j in range(1, len(path) + 1):
            if j == len(path) or path[j] != path[i]:
                total = np.sum(rows[i:j], axis=0)
                e = np.exp(total - total.max())
                out.append((LANGS[path[i]], spans[i][0], spans[j - 1][1], float(e[path[i]] / e.sum())))
                i = j
        return out


_readers: dict[int, tuple[Reader, dict[str, str]]] = {}


def reader_of(weights: dict[str, np.ndarray]) -> tuple[Reader, dict[str, str]]:
    """The reader of a worker process for these weights, and its memory of plain forms; kept from one task to the next."""
    key = hash(weights["E"].tobytes())
    if key not in _readers:
        _readers.clear()
        net = Network()
        net.p = weights
        _readers[key] = Reader(net), {}
    return _readers[key]


def training_units(docs: DataFrame, sample: int = SAMPLE, each: int = SAMPLE_EACH, sentences: int = SENTENCES) -> list[tuple[str, int]]:
    """(plain unit, language number) from the bounded sample of labelled documents."""
    codes = F.create_map(*(F.lit(x) for n, c in _CODE.items() for x in (n, c)))
    label = F.lower(F.trim("lang"))
    code = F.coalesce(codes[label], codes[F.split(F.regexp_replace(label, "_", "-"), "-")[0]])
    named = docs.select("doc_id", code.alias("code"), F.xxhash64("doc_id", F.lit(10)).alias("h")).where("code is not null")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h", "doc_id"))
    chosen = named.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "code")
    chosen = chosen.unionByName(named.orderBy("h", "doc_id").limit(sample).select("doc_id", "code")).distinct()

    def cut_up(batches):
        for b in batches:
            us, cs = [], []
            for t, c, d in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = [p for p in (plain(u) for _, _, u in units(t or "")) if len(_WORD.findall(p)) >= 4]
                rng = np.random.default_rng(abs(d) if d is not None else 0)
                for k in rng.permutation(len(got))[:sentences]:
                    us.append(got[k])
                    cs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array(cs, pa.string())], ["unit", "code"])

    # at most SAMPLE rows and SAMPLE_EACH a language are broadcast
    picked = docs.select("text", "doc_id").join(F.broadcast(chosen), "doc_id").select("text", "code", "doc_id")
    rows = picked.mapInArrow(cut_up, "unit string, code string").collect()
    return sorted((r[0], LANGS.index(r[1])) for r in rows)


def segment_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, label, seg_no, segments, lang, start, end, confidence) of every segment of every document."""
    schema = "doc_id bigint, label string, seg_no bigint, segments int, lang string, `start` int, `end` int, confidence double"
    weights = net.p

    def run(batches):
        reader, form = reader_of(weights)
        for whole in batches:
            # as many documents at once as have GATHERED bytes, one at least
            part = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy(zero_copy_only=False)) // GATHERED
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                b = whole.slice(start, stop - start)
                found, wanted = [], set()
                if len(form) > REMEMBERED:
                    form.clear()
                for t in b.column(2).to_pylist():
                    own = []
                    for s, e, u in units(t or ""):
                        p = form.get(u)
                        if p is None:
                            p = form[u] = plain(u)
                        own.append((s, e, p))
                        wanted.add(p)
                    found.append(own)
                if len(reader.memory) > REMEMBERED:
                    reader.memory.clear()
                reader.learn(wanted)
                out = []
                for d, label, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found):
                    got = reader.segments(own)
                    out += [(d, label_code(label), k + 1, len(got), *s) for k, s in enumerate(got)]
                cols = list(zip(*out)) if out else [()] * 8
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "label", "seg_no", "segments", "lang", "start", "end", "confidence"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def trained(spark, examples: list[tuple[str, int]]) -> Network:
    """The network fitted to these examples: read from the shared folder where an earlier query left it there, else fitted and left there."""
    marks = (WIDTH, CROP, BATCH, STEPS, RATE, CLEAR, LANGS, examples)
    path = f"{shared_folder(spark).rstrip('/')}/language-{hashlib.sha1(repr(marks).encode()).hexdigest()}"
    net = Network()
    try:
        for name, data, shape in spark.read.parquet(path).collect():  # one row per array of weights
            net.p[name] = np.frombuffer(data, dtype=np.float32).reshape(shape).copy()
        return net
    except AnalysisException:
        net = train(examples)
    kept = [(k, v.astype(np.float32).tobytes(), list(v.shape)) for k, v in net.p.items()]
    spark.createDataFrame(kept, "name string, data binary, shape array<int>").coalesce(1).write.mode("ignore").parquet(path)
    return net


def p10_segments(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    docs = table(spark, sf_dir, "documents")
    return segment_documents(docs, trained(spark, training_units(docs)))


def p10_found(spark, sf_dir: str) -> DataFrame:
    """Segments of documents whose label is missing or denotes another language, and of all documents in several languages."""
    return p10_segments(spark, sf_dir).where("segments > 1 or label is null or label <> lang").select("doc_id", "seg_no", "lang")


def p10_documents(spark, sf_dir: str) -> DataFrame:
    """One row per document: its main language (by length), how many segments it has, and the mean confidence; null, 0 and null without words of some language."""
    s = p10_segments(spark, sf_dir).withColumn("width", F.col("end") - F.col("start"))
    by = s.groupBy("doc_id", "lang").agg(F.sum("width").alias("w"), F.sum(F.col("width") * F.col("confidence")).alias("c"), F.max("segments").alias("segments"), F.first("label").alias("label"))
    main = by.groupBy("doc_id").agg(F.max_by("lang", F.struct("w", "lang")).alias("lang"), F.max("segments").alias("segments"), F.first("label").alias("label"), F.round(F.sum("c") / F.greatest(F.sum("w"), F.lit(1)), 4).alias("confidence"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(main, "doc_id", "left").select("doc_id", "lang", F.coalesce("segments", F.lit(0)).alias("segments"), "label", "confidence")
