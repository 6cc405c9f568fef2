"""Long texts are bounded by common subsequences as well."""

from __future__ import annotations

import random

from parcelforge.functions.similarity import _Common, _Texts, may_be_alike


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequences_of_long_texts():
    r = random.Random(3)
    texts = ["".join(r.choice("abcd ") for _ in range(n)) for n in (1, 5, 63, 64, 65, 100, 127, 128, 129, 190, 256)]
    x = _Texts(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    import numpy as np

    got = _Common(x, x)(*(np.array(c) for c in zip(*pairs)))
    assert got.tolist() == [plain(texts[i], texts[j]) for i, j in pairs]


def test_few_long_addresses_are_compared():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("aeioutrnls") for _ in range(n))
    texts = [f"{word(10)} {word(8)} distribution centre no {r.randint(1, 250)} {word(11)} crescent {word(10)} xw5 {r.randint(1, 9)}jj" for _ in range(200)]
    i, j, _ = may_be_alike(texts, texts, 0.85)
    assert sum(a != b for a, b in zip(i.tolist(), j.tolist())) < 40  # without the bound thousands were
