from __future__ import annotations

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.functions import dates, flexdate, jsonx, mime, numbers, postcodes, predicates, similarity, text, units
from parcelforge.functions.address import AddressReader, distance, unit_code
from parcelforge.functions.names import deal_key, occupier_key


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, day, instant",
    [
        ("2021-07-04T23:00:00.000Z", "2021-07-05", "2021-07-04T23:00:00Z"), ("36162", "1999-01-02", None), ("Q3/2020", "2020-07-01", None), ("Apr-21", "2021-04-01", None), ("07/10/25", "2025-10-07", "2025-10-07"),
        ("31/02/2024", None, None), ("2024-13-05", None, None), (None, None, None), ("", None, None), ("1749476019", "2025-06-09", "2025-06-09T13:33:39Z"), ("2024-10-27 01:30:00", "2024-10-27", "2024-10-27T00:30:00Z"),
        ("2024-03-31 01:30:00", None, None), ("1 Apr 2023 11:24 BST", "2023-04-01", "2023-04-01T10:24:00Z"), ("03 October 2024, 12:42 am", "2024-10-03", "2024-10-02T23:42:00Z"), ("Fri, 1 Aug 2025 05:39:39 +0000 (UTC)", "2025-08-01", "2025-08-01T05:39:39Z"),
    ],
)
def test_dates_of_many_forms(value, day, instant):
    assert flexdate.day_of(value) == day
    assert flexdate.instant_of(value) == instant


@pytest.mark.parametrize("value, out", [("05/03/2021", "2021-03-05"), ("31/02/2024", "31/02/2024"), ("03/2024", "2024-03-01"), ("Jan 2025", "2025-01-01"), ("q2-2025", "2025-04-01"), ("1999", "1999-01-01"), ("soon", "soon"), ("", None), (None, None)])
def test_iso_date(spark, value, out):
    assert one(spark, dates.iso_date, value) == out


@pytest.mark.parametrize("value, loose, checked", [("2025 q1", "2025 Q1", "2025 Q1"), ("Q2-2025", "2025 Q2", "2025 Q2"), ("15/03/2025", "2025 Q1", "2025 Q1"), ("13/2025", "2025 Q5", None), ("2025", None, None), (None, None, None)])
def test_quarters(spark, value, loose, checked):
    assert one(spark, lambda c: dates.quarter_text(c, False), value) == loose
    assert one(spark, lambda c: dates.quarter_text(c, True), value) == checked


@pytest.mark.parametrize("value, out", [("£1,250.50", 1250.5), ("tbc", None), ("12d", None), ("0", 0.0), ("", None), (None, None), ("1e3", 1000.0), ("1_000", None)])
def test_to_float(spark, value, out):
    assert one(spark, numbers.to_float, value) == out


@pytest.mark.parametrize("value, out", [("c. 2.5 acres of yard", 108900.0), ("1,200 acres", 52272.0), ("0.5ac", 21780.0), ("none", None), (None, None)])
def test_acres(spark, value, out):
    assert one(spark, numbers.acres_to_sqft, value) == out


@pytest.mark.parametrize("value, out", [("  Holt & Sons, Ltd. ", "holt sons"), ("HOLT PLC", "holt"), (None, None)])
def test_tenant_key(spark, value, out):
    assert one(spark, text.tenant_key, value) == out


def test_unit_key_and_words(spark):
    assert one(spark, text.unit_key, "Unit 07, Plot 2") == "7 2"
    assert one(spark, text.telling_words, "The Oak Park and Oak Mill") == ["oak", "mill"]
    assert one(spark, text.subject_name, "RE: FW: Some Place - Subject to Contract") == "Some Place"
    assert one(spark, text.subject_name, None) == ""


def test_before_reply(spark):
    assert one(spark, text.before_reply, "New.\n\nFrom: A\nSent: today\nold") == "New."
    assert one(spark, text.before_reply, "From: A\nSent: today\nold").startswith("From: A")


def test_postcodes(spark):
    assert one(spark, postcodes.tidy_postcode, " ab12cd ") == "AB1 2CD"
    assert one(spark, postcodes.tidy_postcode, "n/a") == "N/A"
    assert one(spark, postcodes.cut_postcode, "1 High St, AB1 2CD, Town") == "1 High St, Town"
    df = spark.createDataFrame([("1 High St, Bath", "Bath", None), (None, "Bath", "AB1 2CD")], "a string, t string, p string")
    assert [r[0] for r in df.select(postcodes.total_address("a", "t", "p")).collect()] == ["1 High St, Bath", "Bath, AB1 2CD"]


def test_html_and_base64(spark):
    assert one(spark, text.html_text, "<p>A<br/>B &amp; C&#39;</p>") == "A\nB & C"
    assert one(spark, text.decode_url64, "aGk_") == "hi?"


def test_json_recovery():
    assert jsonx.recover('Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert jsonx.recover('x {"a": "}\\"", "b": [1]} y') == '{"a": "}\\"", "b": [1]}'
    assert jsonx.recover("the list [1, 2] is {done}") == "[1, 2]"
    assert jsonx.recover("nothing") is None and jsonx.recover(None) is None


def test_mime():
    part = lambda kind, data, **k: {"mimeType": kind, "body": {"data": data}, **k}
    import json

    tree = {"mimeType": "multipart/mixed", "parts": [part("text/html", "PGI-eDwvYj4="), {"mimeType": "multipart/x", "parts": [part("text/plain", "b25l"), part("text/plain", "dHdv")]}, {"mimeType": "application/pdf", "filename": "a.pdf"}]}
    assert mime.bodies(json.dumps(tree)) == ("one", "one\n\ntwo", ["a.pdf"])
    assert mime.bodies("broken") == ("", "", [])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=12), st.text("abc ", max_size=12)), min_size=1, max_size=8), st.sampled_from([0.65, 0.85, 0.9]))
def test_likeness_and_its_bound(spark, pairs, least):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity.ratio("a", "b").alias("r"), similarity.can_reach(F.col("a"), F.col("b"), least).alias("c")).collect():
        true = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["r"] == pytest.approx(true)
        assert r["c"] or true < least


def test_filters(spark):
    df = spark.createDataFrame([("a.firm.example", "Please INTRODUCE us"), ("firm.example.org", None)], "d string, t string")
    got = df.select(predicates.from_domains("d", ["@firm.example"]).alias("f"), predicates.keywords_in(F.col("t"), ["introduce", "x"]).alias("k")).collect()
    assert [(r["f"], r["k"]) for r in got] == [(True, ["introduce"]), (False, [])]


@pytest.fixture(scope="module")
def reader():
    from tests.conftest import PLACES

    return AddressReader(PLACES)


@pytest.mark.parametrize(
    "address, unit, number, street, kind, town",
    [
        ("Unit No. 05, Oakmere Retail Park, 12-14 Pellworth Ln, Ashby, QX1 2AB", "5", "12-14", "pellworth", "lane", "Ashby"), ("U2 - 9 Dunn Close - Brindelford", "2", "9", "dunn", "close", "Brindleford"),
        ("UE, 252 B Urdun St.", "e", "252b", "urdun", "street", ""), ("Pellworth Way, 7 (see plan)", "", "7", "pellworth", "way", ""), ("nos 3 to 5 elm court;zt5 1aa", "", "3-5", "elm", "court", "Carrowick"), (None, "", "", "", "", ""), ("n/a", "", "", "", "", ""),
    ],
)
def test_addresses(reader, address, unit, number, street, kind, town):
    r = reader.read(address)
    assert (r.unit, r.number, r.street, r.street_type, reader.town(r, None, None)) == (unit, number, street, kind, town)


def test_town_votes(reader):
    assert reader.town(reader.read("1 Elm Court"), "Nr Ashby, Kestmoor", None) == "Ashby"
    assert reader.town(reader.read("1 Elm Court, Carrowick"), "Ashby", None) == "Carrowick"


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_distance(a, b):
    import functools

    @functools.lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        return min(best, d(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else best

    assert distance(a, b, 3) == min(d(len(a), len(b)), 4)


def test_names():
    assert deal_key("Ashby - Oakmere Park Phase II (2026 Q3)") == deal_key("OAKMERE PARK PHASE 2, ashby")
    assert occupier_key("The Holt Foods Co") == occupier_key("Holt Foods (UK) Ltd t/a Holt") == "holt foods"
    assert occupier_key("Vacant - 12m guarantee") == occupier_key(None) == ""
    assert unit_code("Unit: 07") == "7" and unit_code("UC") == "c" and unit_code(None) == ""


def test_units():
    u = units.parse_unit
    assert u("sq m").dim == u("m²").dim == u("square metres").dim == (2, 0, 0, 0)
    assert u("acres").to(1, u("sq ft")) == pytest.approx(43560)
    assert u("°f").to(212, u("°c")) == pytest.approx(100)
    assert u("kg/m2").dim == (-2, 1, 0, 0) and u("cubic ft").dim == (3, 0, 0, 0) and u("furlongs") is None
    got = units.quantities("c. 1.2k sq ft; Eaves 6.5m")
    assert [(q.value, q.thousands, q.unit.dim) for q in got] == [(1.2, True, (2, 0, 0, 0)), (6.5, False, (1, 0, 0, 0))]
    assert units.quantities(None) == []
    with pytest.raises(ValueError):
        u("m").to(1, u("kg"))
