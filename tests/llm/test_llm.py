from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.llm import authored, encoding, language, match, packing, same_address, survivor
from tests.conftest import rows

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")


# --- same address -----------------------------------------------------------------------------------------------------------------------------
def test_p1(spark, data):
    got = rows(same_address.p1_found(spark, data))
    assert got == [("deal-1", "inv-3"), ("deal-1", "inv-4"), ("deal-1", "inv-5"), ("inv-3", "inv-4"), ("inv-3", "inv-5"), ("inv-4", "inv-5"), ("occ-1", "occ-2"), ("occ-1", "occ-9"), ("occ-2", "occ-9"), ("occ-4", "occ-5")]


def resolved(spark, records):
    """street_id of (town, stype, street, number, pc, rival, lead) records."""
    df = spark.createDataFrame([(f"r{i}", *x) for i, x in enumerate(records)], "rec string, town string, stype string, street string, number string, pc string, rival string, lead float")
    return {r["rec"]: r["street_id"] for r in same_address.resolve(df).collect()}


def test_beam_prefers_the_street_that_has_the_number_and_postcode(spark):
    base = [("Ashby", "lane", "pellworth", "12", "QX1 2AB")] * 4 + [("Ashby", "lane", "pollworth", "30", "QX1 9ZZ")] * 4 + [("Ashby", "lane", "pllworth", "12", "QX1 2AB")]
    got = resolved(spark, [(*x, "", 0.0) for x in base])
    assert got["r8"] == got["r0"] != got["r4"]


def test_beam_weighs_towns_and_types(spark):
    known = [("Ashby", "lane", "pellworth", "12", "QX1 2AB", "", 0.0)] * 5 + [("Ashby", "road", "pellworth", "7", "QX1 2AC", "", 0.0)] * 5
    odd = [
        ("Corby", "lane", "pellworth", "12", "QX1 2AB", "Ashby", 0.5),  # number and postcode speak for the rival town
        ("Corby", "lane", "pellworth", "99", "", "Ashby", 3.0),  # nothing does
        ("Ashby", "road", "pellworth", "12", "QX1 2AB", "", 0.0),  # ... for the other street type
        ("Ashby", "", "pellworth", "12", "", "", 0.0),  # no type read
        ("", "lane", "pellworth", "12", "", "", 0.0),
    ]
    got = resolved(spark, known + odd)
    assert got["r10"] == got["r0"] != got["r11"] and got["r12"] == got["r0"] != got["r5"] and got["r13"] == got["r0"] and got["r14"] is None


# --- survivor ---------------------------------------------------------------------------------------------------------------------------------
def test_consensus():
    assert survivor.closest([("Oak Mill Ltd", 25), ("Oaak Mill Ltd", 12), ("OAK MILL", 11)]) == "Oak Mill Ltd"
    assert survivor.closest([("a b c", 1), ("a x c", 1), ("a x d", 1)]) == "a x c"
    assert survivor.closest([]) is None
    assert survivor.consensus([("1 High St", 10), ("1 High St Bath", 6), ("1 High St, Bath", 5)]) == ["1", "High", "St", "Bath"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab1 ", max_size=6), min_size=1, max_size=90, unique=True))
def test_recency_weights_make_the_newest_value_win(values):
    entries = [(i + 1, i, v, 1) for i, v in enumerate(values)]
    won = survivor.choose(entries, recency=True)[2]
    assert survivor.tokens(won) == survivor.tokens(values[-1])


def test_the_survivor_is_what_the_alignment_votes_for(monkeypatch):
    """Every group of several values is aligned, and the outcome follows the weights of the votes."""
    seen, real = [], survivor.consensus
    monkeypatch.setattr(survivor, "consensus", lambda v: seen.append(v) or real(v))
    entries = [(3, 3, "2021-03-25", 1), (2, 2, "2019-03-25", 1), (1, 1, "2019-03-25", 4)]
    assert survivor.choose(entries, recency=True)[1] == 3 and len(seen) == 1
    monkeypatch.setattr(survivor, "weights", lambda values, recency: values)
    assert survivor.choose(entries, recency=True)[1] == 2 and len(seen) == 2


def test_values_updated_at_the_same_instant_are_voted_on(monkeypatch):
    """Where several values were updated last the alignment decides which of them survives; without it another one would."""
    own = [(5, 9, "2020-02-15", 1), (5, 8, "2020-01-15", 1), (1, 1, "2019-01-20", 4)]
    assert survivor.choose([(5, 9, "2020-02-15", 1), (5, 8, "2020-01-15", 3), (1, 1, "2019-01-15", 1)], recency=True)[1] == 8
    assert survivor.choose(own, recency=True)[1] == 8  # the older value speaks for the month
    assert survivor.choose([(6, 9, "2020-02-15", 1), *own[1:]], recency=True)[1] == 9
    # an older value is what all vote for together, and still does not survive
    assert survivor.choose([(5, 9, "2020-02-15", 1), (5, 8, "2021-01-15", 1), (1, 1, "2020-01-15", 9)], recency=True)[1] == 9
    assert survivor.choose([(None, 9, "b", 1), (None, 8, "a", 2)], recency=True)[1] == 8
    monkeypatch.setattr(survivor, "consensus", lambda values: survivor.tokens(values[0][0]))
    assert survivor.choose(own, recency=True)[1] == 9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab1 ", max_size=5), st.integers(1, 3)), min_size=1, max_size=30))
def test_what_survives_was_updated_last(parts):
    entries = [(at, i, v, n) for i, (at, v, n) in enumerate(parts)]
    assert survivor.choose(entries, recency=True)[0] == max(e[0] for e in entries)


def test_p2_rows_updated_at_the_same_instant(spark, data, tmp_path):
    for name in ("place_dim", "raw_occupational_comps"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        if "updated_at" in df.columns:
            df = df.withColumn("updated_at", F.lit("2024-02-01T00:00:00"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(survivor.p2_found(spark, str(tmp_path))) == [(1, "lease_start", 2), (1, "rent_pa", 2)]


def test_p2(spark, data):
    got = rows(survivor.p2_found(spark, data))
    assert got == [(1, "lease_start", 3), (1, "rent_pa", 3)]
    s = {r["group_id"]: r for r in survivor.p2_survivors(spark, data).collect()}
    assert s[1]["members"] == 3 and s[1]["town"] == "Ashby" and s[1]["rent_pa"] == "10100.0"


# --- matching ----------------------------------------------------------------------------------------------------------------------------------
def test_p3(spark, data):
    assert rows(match.p3_found(spark, data)) == [(1, 101), (2, 101), (3, 102)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.randoms(use_true_random=False))
def test_hungarian_is_best(n, m, r):
    if n > m:
        n, m = m, n
    w = [[r.choice([0.0, r.random()]) for _ in range(m)] for _ in range(n)]
    got = match.hungarian(w)
    used = [j for j in got if j >= 0]
    assert len(set(used)) == len(used)
    best = max(sum(w[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
    assert sum(w[i][j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(2))
def test_assignment_has_the_greatest_total(spark, seed):
    r = random.Random(seed)
    edges = {(a, b): round(r.random(), 3) + 0.01 for a in range(6) for b in range(6) if r.random() < 0.4}
    got = rows(match.assign(spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "a bigint, b bigint, conf double")))
    assert len({x[0] for x in got}) == len(got) == len({x[1] for x in got})
    best = max(sum(edges.get((i, j), 0.0) for i, j in enumerate(p)) for p in itertools.permutations(range(6)))
    assert sum(x[2] for x in got) == pytest.approx(best)


def test_records_without_name_match_by_postcode_and_town():
    named, other = ("oakmill", "park", "", "Ashby", "qx1 2ab"), ("", "", "", "Ashby", "qx1 2ab")
    assert match.confidence(named, other) == match.NAMELESS == match.confidence(other, other)
    assert match.confidence(named, ("", "", "", "Ashby", "qx1")) == 0 == match.confidence(named, ("", "", "", "", "qx1 2ab"))


def test_windows_cross_blocks(spark):
    data = [(i, i % 2, f"name{i:04d}", "", "", "Ashby", "") for i in range(90)]
    df = spark.createDataFrame(data, "uid bigint, side int, name string, types string, phase string, town string, code string")
    got = {(a, b) if sa < sb or sa == sb else (a, b) for a, b, sa, sb in rows(match.window_pairs(df, F.col("name"), window=4, block=10), "a", "b", "side_a", "side_b")}
    pairs = {tuple(sorted(p)) for p in got}
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, min(i + 4, 90))}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (52, 51), (60, 60)]
    r.shuffle(edges)
    got = dict(rows(match.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert all(got[i] == 0 for i in range(41)) and got[50] == got[51] == got[52] == 50 and got[60] == 60
    assert match.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- mails --------------------------------------------------------------------------------------------------------------------------------------
def lines_of(body, sender="Nell Fenvale <n@f.example>"):
    return [body.split("\n")[k - 1] for k in authored.new_lines(body, sender)]


def test_layouts():
    top = "[EXTERNAL EMAIL]\n\nHi Tavi,\nNew words here.\n\nBest,\nNell\nSent from my phone\n\nFrom: Tavi Holm <t@x.example>\nSent: 1 May 2024 10:00\nSubject: x\nOld words."
    assert lines_of(top) == ["Hi Tavi,", "New words here."]
    inline = "Tavi Holm wrote on 01/05/2024:\n> Is it fine?\n\nYes it is.\n\n> And the roof?\nDry as well.\nNELL FENVALE\nDirector"
    assert lines_of(inline) == ["Yes it is.", "Dry as well."]
    two = "On Wed, 3 Jan 2024 at 22:55 Tavi Holm\n<t@x.example> wrote:\n> > deep\n> old\nNew."
    assert lines_of(two) == ["New."]
    look = "Regards the roof, it is dry.\n> 7% would do for us\nFrom: the north gate only.\n-- see plan 3 --\nBest bids first, then terms."
    assert lines_of(look) == look.split("\n")
    again = "Thanks, noted for unit 4.\n\nDear Kesh,\nOld words that an earlier mail said."
    assert lines_of(again) == ["Thanks, noted for unit 4."]
    assert lines_of("---------- Forwarded message ---------\nFrom: T H <t@x.example>\nDate: Fri, Dec 15, 2023 at 23:47\nOld.") == []
    assert lines_of("") == [] and authored.new_lines(None, None) == []


@settings(max_examples=100, deadline=None)
@given(st.text("> |\nab:-_.FromSent1", max_size=200))
def test_any_text_parses(body):
    got = authored.new_lines(body, None)
    assert got == sorted(set(got)) and all(body.split("\n")[k - 1].strip() for k in got)


def test_p6(spark, data):
    assert rows(authored.p6_found(spark, data)) == [("a1", 1), ("a1", 2)]


def test_repeated_message_of_the_thread(spark):
    old = "The vendor asks for best and final by Friday.\nPlease hold unit 3 until then."
    mails = [("m1", old, None, "t", "2024-01-01T10:00:00Z"), ("m2", f"Understood, we will revert on unit 3.\n\n{old}", None, "t", "2024-01-02T10:00:00Z"), ("m3", old, None, "u", "2024-01-03T10:00:00Z")]
    df = spark.createDataFrame(mails, "gmail_message_id string, body_preview string, sender string, thread_id string, date string")
    got = {r["gmail_message_id"]: [x["no"] for x in r["lines"]] for r in authored.authored(df).collect()}
    assert got == {"m1": [1, 2], "m2": [1], "m3": [1, 2]}


# --- tokens ---------------------------------------------------------------------------------------------------------------------------------------
def test_rank_queue():
    r = random.Random(2)
    q, plain = encoding.RankQueue(5000), []
    for _ in range(400):
        rank, pos = r.randrange(5000), r.randrange(100)
        q.push(rank, pos)
        plain.append((rank, pos))
    got = []
    while x := q.pop():
        got += [(x[0], p) for p in x[1]]
    assert got == sorted(plain) and q.pop() is None


@needs_vocabulary
def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e, r = encoding.Encoder(), random.Random(3)
    texts = ["", " ", "Hello  world\n\n it's <|endoftext|>", "a" * 5000, "ab" * 3000 + " x", "日本語 é ﬁ 👷🏽 \x1c\x85 x"] + ["".join(r.choice("ab  \n\t'é1½　\xa0€.s") for _ in range(r.randint(0, 50))) for _ in range(500)]
    for x in texts * 2:
        assert list(e.encode(x)) == t.encode(x, add_special_tokens=False).ids
        assert e.count(x) == len(e.encode(x))
    assert list(e.encode(None)) == []


@needs_vocabulary
def test_p8(spark, data):
    got = {r["doc_id"]: r["ids"] for r in encoding.p8_ids(spark, data).collect()}
    assert got[201] == got[202] == [] and len(got[206]) >= 9000 and len(got) == 88


# --- packing --------------------------------------------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_packing_is_whole_and_tight(sizes):
    bins = packing.pack([(s, i) for i, s in enumerate(sizes)], 50)
    assert sorted(x for b in bins for x in b) == sorted((s, i) for i, s in enumerate(sizes))
    assert all(sum(s for s, _ in b) <= 50 for b in bins)
    total = sum(sizes)
    assert len(bins) <= max(1, int(11 / 9 * -(-total // 50)) + 2) or not sizes


def test_local_search_empties_bins():
    b = packing.Bins(10)
    for items in ([(6, 1)], [(4, 2)], [(5, 3), (2, 4)], [(3, 5)]):
        k = b.open()
        for x in items:
            b.put(k, x)
    before = sum(b.fill(k) ** 2 for k in range(4))
    packing.improve(b)
    assert sum(b.fill(k) ** 2 for k in range(4)) > before and sum(bool(x) for x in b.items) == 2


def test_local_search_ends_where_nothing_improves():
    for seed in range(5):
        r = random.Random(seed)
        sizes = [(r.randint(1, 40), i) for i in range(120)]
        b = packing.first_assignment(sizes, 50)
        for k in range(0, len(b.items), 2):  # torn apart, so that there is something to do
            for x in b.items[k][1:]:
                b.take(k, x)
                b.put(b.open(), x)
        packing.improve(b)
        assert all(b.free[k] == 50 - sum(x[0] for x in b.items[k]) == b.spaces[k] for k in range(len(b.items)))
        for k, own in enumerate(b.items):
            for x in own:
                for c, there in enumerate(b.items):
                    if c == k or not there or not own or b.fill(c) < b.fill(k):
                        continue
                    outs = [0, *(y[0] for y in there), *(p[0] + q[0] for p, q in itertools.combinations(there, 2))]
                    assert not [y for y in outs if y < x[0] and x[0] - y <= b.free[c] and x[0]], (k, c)


def test_many_like_items_are_packed_quickly():
    bins = packing.pack([(60 + i % 3, i) for i in range(6000)], 100)
    assert len(bins) == 6000


@needs_vocabulary
def test_p9(spark, data):
    out = packing.p9_packing(spark, data)
    per = out.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    small = {r["doc_id"]: (r["t"], r["n"]) for r in per.where("limit_name = 'small'").collect()}
    large = {r["doc_id"]: (r["t"], r["n"]) for r in per.where("limit_name = 'large'").collect()}
    assert len(small) == len(large) == 88 and all(small[k][0] == large[k][0] for k in small)
    assert small[206][1] == -(-small[206][0] // 64) and small[201] == (0, 1)
    fill = {r["limit_name"]: r for r in packing.p9_fill(spark, data).collect()}
    assert fill["small"]["fullest"] <= 64 and fill["small"]["containers"] <= fill["small"]["bound"] * 1.25 + 2


# --- languages ------------------------------------------------------------------------------------------------------------------------------------
def test_gradients():
    net = language.Network(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y = [b"hello w", b"ab", b"xyzzy quux"], np.array([0, 3, 2])
    _, g = net.gradients(texts, y)
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            i = tuple(r.integers(s) for s in v.shape) if k != "E" else (r.integers(2), ord("l"), r.integers(v.shape[2]))
            v[i] += 1e-4
            a, _ = net.gradients(texts, y)
            v[i] -= 2e-4
            b, _ = net.gradients(texts, y)
            v[i] += 1e-4
            assert g[k][i] == pytest.approx((a - b) / 2e-4, abs=3e-3)


def test_what_texts_share_is_read_once(monkeypatch):
    """Texts that begin or end alike are not read anew; the outcome is that of reading each by itself."""
    net = language.Network(8)
    r = random.Random(4)
    texts = ["", "é", *("the unit is let at " + "".join(r.choice("ab é") for _ in range(r.randint(0, 5))) + " pounds a year to the present tenant." for _ in range(60))]
    coded = [t.encode() for t in texts]
    seen, real = [], net._votes
    monkeypatch.setattr(net, "_votes", lambda side, last, *x: seen.append(len(last)) or real(side, last, *x))
    got = net.read(coded)
    assert len(got) == sum(map(len, coded)) and seen == [len({t[:k] for t in coded for k in range(1, len(t) + 1)}), len({t[k:] for t in coded for k in range(len(t))})]
    assert max(seen) < len(got) / 1.4
    codes, lengths, order = net.batch(coded)
    alone = net.forward(codes, order)[0]
    assert np.allclose(got, np.concatenate([alone[i, :n] for i, n in enumerate(lengths)]), atol=1e-4)
    scores = language.word_scores(net, texts)
    assert [len(x) for x in scores] == [len(language._WORD.findall(t)) for t in texts]
    one = [language.word_scores(net, [t])[0] for t in texts]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(scores, one))


def test_batches_hold_every_text():
    texts = sorted({"x" * n + str(n % 7) for n in range(300)})
    parts = list(language.batches(texts))
    assert sorted(t for p in parts for t in p) == texts and list(language.batches([])) == []


def test_best_path():
    r = np.random.default_rng(1)
    for _ in range(20):
        s = r.normal(0, 3, (6, 3))
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(language.best_path(s, 2.0)) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=6)))


def test_labels_and_units():
    assert [language.label_code(x) for x in ("en-GB", "Deutsch", "POR", "mul", "??", None, "da")] == ["en", "de", "pt", None, None, None, None]
    assert language.plain("- The unit at Oak Mill Park has 1,250 sq ft") == "the unit at x has 0 sq ft"
    assert [u[2] for u in language.units("One two. Three\n\nFour")] == ["One two.", "Three", "Four"]


def test_p10(spark, data):
    got = rows(language.p10_found(spark, data))
    assert [g for g in got if g[0] == 200] == [(200, 1, "en"), (200, 2, "de")]
    assert (204, 1, "de") in got
    assert not [g for g in got if g[0] in (201, 202, 203, 205, 207)] and len([g for g in got if g[0] < 200]) == 0


@pytest.mark.parametrize("which", ["empty", "clashing"])
def test_every_query_runs(spark, which, request, monkeypatch):
    from parcelforge.llm.queries import QUERIES

    monkeypatch.setattr(language, "STEPS", 2)
    d = request.getfixturevalue(which)
    for name, f in QUERIES.items():
        assert f(spark, d).count() >= 0, name
