"""Deals looked up and decided without pairs: stretches and pieces give what the fold in order gives, and what is written grows with the deals."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest

from parcelforge.operators import dedup, threads
from tests.test_operators import deal_match_plain, some_deals

COLS = "id bigint, name string, town string, postcode string"


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that ``dedup`` writes."""
    counts, real = [], dedup.cut

    def counted(df):
        out = real(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(dedup, "cut", counted)
    return counts


@pytest.fixture
def short(monkeypatch):
    """Stretches and pieces of few deals."""
    for name, size in (("FIRST", 8), ("LONGEST", 16), ("NEW", 10), ("HELD", 12)):
        monkeypatch.setattr(dedup, name, size)


def one_kind(n, start=0):
    return [(start + i, f"Place{i:03d} Harbour Distribution", "", "") for i in range(n)]


def test_stretches_decide_as_the_fold(spark, short):
    deals, kept, want = [(i, *d) for i, (_, *d) in enumerate(some_deals(11, 90))], [], {}
    for d in deals:
        hit = next(((k, why) for k in kept if (why := deal_match_plain(d[1:], k[1:]))), None)
        want[d[0]] = (hit[0][0], hit[1]) if hit else (d[0], None)
        kept += [] if hit else [d]
    got = dedup.decide_deals(spark.createDataFrame(deals, COLS)).collect()
    assert {r["id"]: (r["kept_id"], r["reason"]) for r in got} == want


def test_decisions_write_no_pairs(spark, written):
    got = dedup.decide_deals(spark.createDataFrame(one_kind(200), COLS)).collect()
    assert {r["kept_id"] for r in got} == {0} and len(got) == 200
    assert max(written) <= 200  # 19,900 pairs match


def test_likeness_is_that_of_the_later_deal_to_the_earlier(spark):
    """The ratio of two texts depends on their order: only one of the two reaches the bound."""
    earlier, later = "Harnorcombe Airfield Industrial Park", "Jarrmpen Airfield Industrial Estate"
    x, y = "airfield harnorcombe", "airfield jarrmpen"
    assert SequenceMatcher(None, y, x).ratio() >= dedup.DEAL > SequenceMatcher(None, x, y).ratio()
    got = dedup.decide_deals(spark.createDataFrame([(1, earlier, "", ""), (2, later, "", "")], COLS)).collect()
    assert {r["id"]: (r["kept_id"], r["reason"]) for r in got} == {1: (1, None), 2: (1, "alike")}


def test_pieces_look_up_as_the_fold(spark, short):
    new, known = some_deals(12, 70), some_deals(13, 70)
    want = {}
    for d in new:
        if hit := next(((k[0], why) for k in sorted(known) if (why := deal_match_plain(d[1:], k[1:]))), None):
            want[d[0]] = hit
    got = dedup.lookup_deals(spark.createDataFrame(new, COLS), spark.createDataFrame(known, COLS)).collect()
    assert {r["new_id"]: (r["known_id"], r["reason"]) for r in got} == want


def test_lookups_write_no_pairs(spark, written):
    got = dedup.lookup_deals(spark.createDataFrame(one_kind(150), COLS), spark.createDataFrame(one_kind(150, 1000), COLS)).collect()
    assert {(r["new_id"], r["known_id"]) for r in got} == {(i, 1000) for i in range(150)}  # that of equal name too: the first counts
    assert max(written) <= 150  # 22,500 pairs match


def test_appended_deals_write_no_pairs(spark, written):
    sheet = spark.createDataFrame([(i, n, "", "") for i, n, *_ in one_kind(120)], "row bigint, asset_name string, town string, address string")
    numbers = ["area_acres", "area_sqft", "rent_pa", "rent_psf", "asking_price", "net_yield", "reversionary_yield", "capval_psf"]
    new = spark.createDataFrame([(1, "Place001 Harbour Distribution"), (2, "Elsewhere Oddment"), (3, "Elsewhere Oddment")] + [(i, f"Spot{i:03d} Quarry Enterprise") for i in range(10, 130)], "deal_id bigint, asset_name string")
    new = new.selectExpr("*", *(f"'' as {c}" for c in ("town", "postcode", "address", "date", "agent", "country", "classification", "comment", "also_introduced_by")), *(f"0D as {c}" for c in numbers), "false as has_brochure", "false as brochure_scraped")
    assert sorted(r["deal_id"] for r in dedup.append_deals(sheet, new).collect()) == [2, 10]
    assert max(written) <= 123


def test_threads_of_one_kind_write_no_pairs(spark, short, written):
    data = [(f"t{i:03d}", f"{i % 28 + 1:02d}/02/2024", n, "", float(i), ["a.example"]) for i, n, *_ in one_kind(60)]
    df = spark.createDataFrame(data, "thread_id string, latest_date string, name string, town string, score double, domains array<string>").withColumn("pos", threads.newest_first())
    got = threads.group_properties(df).collect()
    assert {r["group_id"] for r in got} == {"t027"} and [r["thread_id"] for r in got if r["is_winner"]] == ["t059"]
    assert max(written) <= 60
