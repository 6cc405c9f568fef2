from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parcelforge import extract
from parcelforge.functions import mime, predicates
from parcelforge.operators import archive, clean, dedup, ledger, reports, threads, timestamps
from parcelforge.runtime import shared_folder, table
from parcelforge.sources import mailbox
from tests.conftest import rows

INV = "row_no bigint, address string, price double, quarter string, town string, yield_niy double"


# --- cleaning ---------------------------------------------------------------------------------------------------------------------------------
def test_rent_from_price_and_yield(spark):
    cols = "row_no bigint, address string, date string, quarter string, area_sqft double, rent_pa double, rent_psf double, price double, yield_niy double, capval_psf double"
    df = spark.createDataFrame([(1, "a", None, None, 1000.0, None, None, 1e6, 0.06, None), (2, "a", None, None, 1000.0, 0.0, 5.0, 1e6, 0.0, None), (3, "", None, None, None, None, None, 1e6, 0.06, None)], cols)
    got = {r["row_no"]: r for r in clean.clean_investment(df).collect()}
    assert got[1]["rent_pa"] == 64080.0 and got[1]["rent_psf"] == 64.08 and got[1]["capval_psf"] == 1000.0
    assert got[2]["rent_pa"] == 5000.0 and 3 not in got


def test_settlements_and_places(spark):
    assert clean.SETTLEMENTS == ["City", "Town", "Suburban Area", "Village", "Hamlet", "Other Settlement", "Section of Named Road"]
    parts = [("Ashby", True), ("Ab", False), ("1 Ashby", False), ("Ashby 2", False), ("Élan", True), ("QX1 2AB", False), ("", False), ("-Ashby", False)]
    df = spark.createDataFrame(parts, "p string, want boolean")
    assert df.where(F.coalesce(clean.place_like(F.col("p")), F.lit(False)) != F.col("want")).count() == 0


def test_inferred_postcodes(spark, data):
    places = table(spark, data, "place_dim")
    cols = "id bigint, address string, town string, postcode string, total_address string, changes int"
    df = spark.createDataFrame([(1, "12 Pellworth Lane", "", None, "", 0), (2, " 12 Pellworth Lane ", None, " ", "", 0), (3, "Elsewhere", "Bath", "", "", 0), (4, None, None, None, "", 0), (5, "x", "y", "ZZ9 9ZZ", "", 0), (6, "Nowhere", "", "", "", 0)], cols)
    requests, asked = clean.open_locations(df)
    assert rows(requests, "address", "town", "rows") == [("12 Pellworth Lane", "", 2), ("Elsewhere", "Bath", 1), ("Nowhere", "", 1)]
    say = {"12 Pellworth Lane": "qx12ab", "Elsewhere": "ZZ1 1ZZ", "Nowhere": "no idea"}
    replies = requests.select("request_key", F.create_map(*(F.lit(x) for kv in say.items() for x in kv))[F.col("address")].alias("response"))
    got = {r["id"]: r for r in clean.infer_postcodes(df, places, extract.ReplayExtractor(replies)).collect()}
    assert got[1]["postcode"] == got[2]["postcode"] == "QX1 2AB" and got[1]["town"] == got[2]["town"] == "Ashby" and got[1]["changes"] == 2
    assert got[1]["total_address"] == "12 Pellworth Lane, Ashby, QX1 2AB"
    assert got[3]["postcode"] == "" and got[5]["postcode"] == "ZZ9 9ZZ" and got[6]["postcode"] == "" and len(got) == 6


# --- threads ------------------------------------------------------------------------------------------------------------------------------------
def test_property_groups(spark):
    cols = "thread_id string, latest_date string, name string, town string, score double, domains array<string>"
    data = [
        ("t1", "01/02/2024", "Oak Mill Estate", "", 1.0, ["a.example", "b.example"]), ("t2", "05/02/2024", "oak mill estate", "", 2.0, ["b.example", "c.example"]),
        ("t3", "03/02/2024", "Oak Mill Estate and Yard", "", 9.0, ["d.example", "c.example"]), ("t4", None, "Far Place", "", 0.0, []), ("t5", "01/01/2020", "", "", 0.0, ["e.example"]),
    ]
    df = spark.createDataFrame(data, cols).withColumn("pos", threads.newest_first())
    got = {r["thread_id"]: r for r in threads.group_properties(df).collect()}
    assert {t: r["group_id"] for t, r in got.items()} == {"t1": "t2", "t2": "t2", "t3": "t2", "t4": "t4", "t5": "t5"}  # the newest thread leads
    assert [t for t in got if got[t]["is_winner"]] and got["t3"]["is_winner"] and not got["t2"]["is_winner"]
    assert got["t1"]["reason"] == "exact match" and got["t3"]["reason"] == "contained" and got["t2"]["reason"] is None
    assert got["t3"]["also_introduced_by"] == ["b.example", "a.example"] and got["t1"]["also_introduced_by"] is None and got["t4"]["also_introduced_by"] == []


def test_thread_scores_count_text(spark):
    mails = spark.createDataFrame([("m1", "t", "01/01/2024", "s", "x.example", "b" * 2000, ["a.pdf"], [], True, False), ("m2", "t", "02/01/2024", "s", "x.example", None, [], [], None, False)],
        "gmail_message_id string, thread_id string, date string, subject string, sender_domain string, body_preview string, attachment_names array<string>, matched_keywords array<string>, matched_sender boolean, matched_label boolean")
    assert threads.group_threads(mails).select(threads.thread_score()).first()[0] == 5 + 6 + 2


# --- sheets -------------------------------------------------------------------------------------------------------------------------------------
def insert_plain(old, new):
    """The fold, one comparable after the other."""
    import re
    from difflib import SequenceMatcher

    from parcelforge.functions.text import STOP_WORDS

    key = lambda s: " ".join(re.sub(r"[^\w\s]", " ", (s or "").lower()).split())
    telling = lambda s: {w for w in key(s).split() if len(w) > 1 and w not in STOP_WORDS}
    ordinal = lambda q: int(q[:4]) * 4 + int(q[-1]) if q else None

    def alike(a, b):
        x, y = key(a), key(b)
        if not x or not y:
            return False
        short, long = sorted((x, y), key=len)
        p, q = telling(a), telling(b)
        return x == y or (len(short.split()) >= 2 and short in long) or (len(p & q) >= 2 and len(p & q) / min(len(p), len(q)) >= 0.6) or SequenceMatcher(None, x, y).ratio() >= 0.85

    def match(c, r):
        if not (r["address"] or "").strip():
            return False
        a, b = c["price"] or None, r["price"] or None
        if (a is None) != (b is None) or (a and abs(a - b) / ((a + b) / 2) > 0.05):
            return False
        p, q = ordinal(c["quarter"]), ordinal(r["quarter"])
        return not (p is not None and q is not None and abs(p - q) > 1) and alike(c["address"], r["address"])

    sheet, out = [dict(r) for r in old], {}
    for c in new:
        r = next((r for r in sheet if match(c, r)), None)
        if r is None:
            sheet.append(dict(c))
            out[c["row_no"]] = ("inserted", None)
            continue
        fills = [f for f in ("address", "price", "quarter", "town", "yield_niy") if r[f] in (None, "") and c[f] not in (None, "")]
        r |= {f: c[f] for f in fills}
        out[c["row_no"]] = ("merged" if fills else "duplicate", r["row_no"])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_insert_investments_is_the_fold_in_order(spark, seed):
    r = random.Random(seed)
    names = ["Oak Mill Estate", "oak mill", "Oakmill Estate", "12 Pellworth Lane", "Pellworth Lane, 12", "Fernhill Works", "Fern Hill Works", "", None]

    def some(i):
        return {"row_no": i, "address": r.choice(names), "price": r.choice([None, None, 0.0, 1e6, 1.03e6, 1.07e6]), "quarter": r.choice([None, None, "2024 Q1", "2024 Q2", "2024 Q4"]), "town": r.choice([None, "Ashby", ""]), "yield_niy": r.choice([None, 5.0])}

    all_ = [some(i) for i in range(60)]
    r.shuffle(all_)
    old, new = sorted(all_[:15], key=lambda x: x["row_no"]), sorted(all_[15:], key=lambda x: x["row_no"])
    frame = lambda xs: spark.createDataFrame([tuple(x.values()) for x in xs], INV)
    got = {x["id"]: (x["action"], x["match_id"]) for x in dedup.insert_investments(frame(old), frame(new)).collect()}
    assert got == insert_plain(old, new)


def test_append_deals(spark):
    sheet = spark.createDataFrame([(12, "Oak Mill Estate", "Ashby", "12 Pellworth Lane, QX1 2AB"), (13, None, "Ashby", "x, ZT5 1AA")], "row bigint, asset_name string, town string, address string")
    cols = "deal_id bigint, date string, agent string, asset_name string, country string, town string, address string, postcode string, classification string, area_acres double, area_sqft double, rent_pa double, rent_psf double, asking_price double, net_yield double, reversionary_yield double, capval_psf double, has_brochure boolean, brochure_scraped boolean, comment string, also_introduced_by string"
    d = lambda i, name, town="", code="", date="01/02/2024": (i, date, "ag", name, "England", town, "9 Far Road", code, "x", None, None, None, None, 1e6, 6.5, None, None, i == 2, None, "", "b.example")
    new = spark.createDataFrame([d(1, "OAK MILL estate"), d(2, "Fernhill Works", "Bath", "BA1 1AA"), d(3, "Fernhill Works", "Bath"), d(4, ""), d(5, "Zed", code="qx1 2ab"), d(6, "Kestrel Point", date="spring")], cols)
    got = {r["deal_id"]: r for r in dedup.append_deals(sheet, new).collect()}
    assert sorted(got) == [2, 4, 6]
    assert got[2]["date"] == "2024-02-01" and got[2]["address"] == "9 Far Road, BA1 1AA" and got[2]["net_yield"] == 0.065 and got[2]["brochure_stored"] == "Yes" and got[2]["brochure_scraped"] == "No"
    assert got[6]["date"] == "spring" and got[6]["status"] == "New" and got[6]["comment"] is None and got[6]["also_introduced_by"] == "b.example"


# --- archive, mailbox, reports --------------------------------------------------------------------------------------------------------------------
def test_archive_never_overwrites(spark, tmp_path):
    deals = spark.createDataFrame([(1, "Ashby", "Oak Mill", "St. John", "2024-01-01"), (2, "Ashby", "Oak Mill", "St. John", "2024-01-01")], "deal_id bigint, town string, asset_name string, agent string, date string")
    plan = archive.archive_plan(deals, "2026-06-30")
    assert [r["subfolder"] for r in plan.orderBy("deal_id").collect()] == ["2024-01-01 - St. John", "2024-01-01 - St. John (2)"]
    bodies = spark.createDataFrame([(1, "m1", "one", "{}"), (2, "m2", "two", "{}")], "deal_id bigint, gmail_message_id string, body string, metadata string")
    same = plan.withColumn("subfolder", F.lit("2024-01-01 - St. John"))
    for _ in range(2):  # a second run changes nothing
        archive.write_archive(same.coalesce(1), bodies, str(tmp_path))
    found = sorted((p.parent.name, p.read_text()) for p in tmp_path.rglob("body.txt"))
    assert sorted(x[1] for x in found) == ["one", "two"] and [x[0] for x in found] == ["2024-01-01 - St. John", "2024-01-01 - St. John (2)"]


def test_quarter_folders_come_last(spark):
    folders = spark.createDataFrame([("Ashby, Oak Mill (2024 Q1)", "", "", None), ("Ashby, Oak Mill (2025 Q2)", "", "", None), ("Bath, Fernhill", "Bath", "BA1 1AA", None)], "folder string, town string, postcode string, latest date")
    deals = spark.createDataFrame([(1, "Ashby, Oak Mill", "", ""), (2, "Bath, Fern Hill", "Bath", ""), (3, "Nowhere", "", ""), (4, None, None, None)], "deal_id bigint, folder_name string, town string, postcode string")
    assert rows(ledger.folder_lookup(deals, folders)) == [(1, "Ashby, Oak Mill (2025 Q2)", "quarter"), (2, "Bath, Fernhill", "alike"), (3, None, "new"), (4, None, "new")]


def test_mailbox_scan_is_whole_and_ordered(spark, tmp_path):
    lines = [{"id": f"m{i}", "threadId": "t", "internalDate": 1_700_000_000_000 + i * 86_400_000, "labelIds": ["Intro", "Inbox"] if i % 2 else ["Inbox"], "payload": {"n": i}} for i in range(6)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    found = mailbox.scan(spark, str(tmp_path), label="Intro")
    assert found.count() == 6
    assert [r["id"] for r in mailbox.capped(found, 2).orderBy("position").collect()] == ["m5", "m3", "m4"]


def test_html_bodies_and_headers(spark):
    from parcelforge.__main__ import header

    import base64

    html = base64.urlsafe_b64encode(b"<p>A &amp; B<br>C</p>").decode()
    payload = json.dumps({"mimeType": "text/html", "body": {"data": html}, "headers": [{"name": "From", "value": "first"}, {"name": "FROM", "value": "last"}]})
    assert mime.bodies(payload)[:2] == (" A &amp; B C ", "A & B\nC")
    df = spark.createDataFrame([(payload,), ("{}",)], "payload string")
    assert [r[0] for r in df.select(header("payload", "from")).collect()] == ["last", None]


def test_routes_models_and_reports(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (0, True, False, "x"), (None, False, False, "x"), (0, False, True, "FW: Comps"), (0, False, True, "Oak Mill")], "deals int, intro boolean, files boolean, name string")
    assert [r[0] for r in df.select(predicates.route(F.col("deals"), F.col("intro"), F.col("files"), F.col("name"))).collect()] == ["deals", "error", "not introduction", "not a stub", "stub"]
    names = spark.createDataFrame([("Cash Flow v2.xlsx",), ("Brochure.pdf",), (None,)], "n string")
    assert [r[0] for r in names.select(predicates.financial_model("n")).collect()] == [True, False, None]
    res = spark.createDataFrame([(f"t{i:02d}", "error" if i < 12 else "processed", i % 2 == 0, 1, None, 2, 0, 3, f"e{i}") for i in range(20)],
        "thread_id string, status string, is_introduction boolean, pipeline_rows_added int, archived int, brochures_parsed int, investment_comps int, occupational_comps int, error_message string")
    r = reports.run_report(res)
    assert r.first()["errors"] == 12 and r.first()["more_errors"] == 2 and r.first()["error_details"] == [f"e{i}" for i in range(10)] and r.first()["occupational_comps_added"] == 60
    assert reports.report_lines(r)[-1] == "  and 2 more"
    none = reports.run_report(res.limit(0)).first()
    assert none["threads_processed"] == 0 and none["error_details"] == []
    folders = spark.createDataFrame([("Oak", "Ashby, Oak"), ("Ok", "Ashby, Oak"), ("Elm, Bath", "Elm"), ("A", "Oak")], "folder string, ideal string")
    assert rows(reports.renames(folders)) == [("Oak", "Ashby, Oak")]
    b = reports.batches_of(spark.range(57), "id", 10).groupBy("batch").count().collect()
    assert sum(x["count"] for x in b) == 57 and max(x["count"] for x in b) <= 10


def test_shared_folder(spark):
    assert shared_folder(spark)


# --- zones --------------------------------------------------------------------------------------------------------------------------------------
def test_planted_zones_are_found(spark):
    """Domains whose clocks stand in other zones: the estimate finds them from thread order, and without it their times are off by hours."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    zones = {"ny.example": "America/New_York", "in.example": "Asia/Kolkata", "uk.example": "Europe/London", "la.example": "America/Los_Angeles"}
    r, data, truth = random.Random(5), [], {}
    for dom, zone in zones.items():
        for i in range(60):
            first = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=r.randrange(500_000))
            reply = first + timedelta(minutes=r.randint(5, 90))
            t, local = f"{dom}-{i}", first.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")
            # half of the zoneless mails come first, half answer
            if i % 2:
                data += [(f"{t}-a", local, dom, "Deal", t), (f"{t}-b", reply.strftime("%Y-%m-%dT%H:%M:%SZ"), "other.example", "RE: Deal", t)]
                truth[f"{t}-a"] = first
            else:
                late = reply.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")
                data += [(f"{t}-a", first.strftime("%Y-%m-%dT%H:%M:%SZ"), "other.example", "Deal", t), (f"{t}-b", late, dom, "RE: Deal", t)]
                truth[f"{t}-b"] = reply
    df = spark.createDataFrame(data, "gmail_message_id string, date string, sender_domain string, subject string, thread_id string")
    want = {k: v.strftime("%Y-%m-%dT%H:%M:%SZ") for k, v in truth.items()}
    got = {x["gmail_message_id"]: x["iso"] for x in timestamps.mail_times(df).collect()}
    right = sum(got[k] == v for k, v in want.items()) / len(want)
    assert right >= 0.98, right


def test_commands(spark, data, tmp_path, capsys):
    from parcelforge.__main__ import main

    spark.createDataFrame([("m1", "processed", True, True), ("m2", "error", None, None)], "gmail_message_id string, status string, is_introduction boolean, pipeline_row_added boolean").write.parquet(str(tmp_path / "ledger"))
    main(["stats", str(tmp_path / "ledger")])
    main(["dedup", data])
    assert "rows_scanned" in capsys.readouterr().out
    main(["dedup", data, "--out", str(tmp_path / "kept")])
    kept = {r["id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()}
    assert 1 in kept and 2 not in kept
    for name in ("Brochure.pdf", "Cash Flow.xlsx", "notes.txt"):
        p = tmp_path / "archive" / "Ashby, Oak Mill" / "2024-01-01 - x" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    main(["files", str(tmp_path / "archive")])
    out = capsys.readouterr().out
    assert "Brochure.pdf" in out and "Cash" not in out
