from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PLACES = [("Ashby", "Kestmoor", "QX1"), ("Ashby", "Kestmoor", "ZB1"), ("Brindleford", "Kestmoor", "QX2"), ("Carrowick", "Lowshire", "ZT5")]


@pytest.fixture(scope="session")
def data(spark, tmp_path_factory):
    """A small data directory: every table, with nulls, blanks, copies, ties and one odd column."""
    from parcelforge import schemas

    d = tmp_path_factory.mktemp("data")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{d}/{name}.parquet")
    put("place_dim", [(n.lower(), n, "Town", c, "North", o) for n, c, o in PLACES], "candidate string, name string, local_type string, county string, region string, outcode string")
    occ = "id bigint, " + schemas.OCCUPATIONAL_COMP + ", tenant_name_norm string, unit_name_norm string, extraction_date string, created_at string, updated_at string"
    names = [x.strip().split()[0] for x in occ.split(",")]

    def o(i, **k):
        base = dict.fromkeys(names)
        base |= {"id": i, "source_deal": "Ashby, Oakmere Retail Park", "entry_type": "tenancy", "created_at": "2024-01-01T00:00:00", "updated_at": f"2024-01-{i % 28 + 1:02d}T00:00:00"}
        return tuple((base | k)[n] for n in names)

    rows = [
        o(1, tenant_name="Holt Foods Ltd", unit_name="Unit 3", address="Unit 3, Oakmere Retail Park, 12 Pellworth Lane, Ashby, QX1 2AB", town="Ashby", postcode="QX1 2AB", size_sqft=1000.0, rent_pa=10000.0, rent_psf=10.0, lease_start="2020-01-15", lease_expiry="2030-01-15"),
        o(2, tenant_name="HOLT FOODS LIMITED", unit_name="U3", address="U3, 12 Pelworth Ln., Ashby", town="n/a", postcode="", size_sqft=92.9, rent_pa=10000.0, rent_psf=10.0, lease_start="15/01/2020", notes="Areas stated in sq m"),
        o(3, tenant_name="Holt Foods plc", unit_name="Unit 03", address=None, town="Ashby", rent_pa=10100.0, lease_start="Jan 2020", lease_expiry="2030-01-15"),
        o(4, tenant_name="Merle Glass", unit_name="Unit 4", address="Unit 4 - 12 Pellworth Lane - Ashby", rent_pa=-1.0, notes="Let area 2,000 sq ft (unverified)", comp_date="Q3 2021"),
        o(5, tenant_name="Merle Glass", unit_name="Unit 4", address="Unit 4 - 12 Pellworth Lane - Ashby", rent_pa=-1.0, notes="Let area 2,000 sq ft (unverified)", comp_date="Q3 2021"),
        o(6, tenant_name="Vacant", unit_name="Unit 5", address="12 Pellworth Lane, Unit 5, QX1 2AB", notes="yield 5%", lease_start="31/02/2024"),
        o(7), o(8, tenant_name="", unit_name=" ", address=" ", town=" ", postcode="-", notes="x" * 20000, source_deal=None),
        o(9, tenant_name="Tarn Cycles", unit_name="Unit 3", address="Unit 3, 12 Pellworth Lane, Ashby", rent_pa=30000.0, rent_psf=30.0, lease_start="2010-05-01", lease_expiry="2015-05-01", size_sqft=1.0, notes="Sizes in 000s sq ft"),
    ]
    put("raw_occupational_comps", rows, occ)
    inv = "row_no bigint, " + schemas.INVESTMENT_COMP
    cols = [x.strip().split()[0] for x in inv.split(",")]
    i = lambda n, **k: tuple((dict.fromkeys(cols) | {"row_no": n} | k)[c] for c in cols)
    put("investment_comps", [
        i(3, town="Ashby", address="Oakmere Retail Park, 12 Pellworth Lane, Ashby", price=1e6, date="01/08/2023", area_sqft=5000.0), i(4, town="Ashby", address="Oakmere Retail Pk, No. 12 Pellworth La.", price=1.02e6, quarter="Q3 2023"),
        i(5, address="Oakmere Retail Park, 12 Pellworth Lane, Ashby", price=2e6), i(6), i(7, address="  ", price=0.0),
    ], inv)
    deal = "deal_id bigint, gmail_message_id string, " + schemas.DEAL + ", area_quoted string"
    dc = [x.strip().split()[0] for x in deal.split(",")]
    k = lambda n, **x: tuple((dict.fromkeys(dc) | {"deal_id": n} | x)[c] for c in dc)
    put("deals", [
        k(1, asset_name="Oakmere Retail Park", town="Ashby", postcode="QX1 2AB", address="Oakmere Retail Park, 12 Pellworth Lane, Ashby", date="1st March 2024", area_acres=1.76, area_quoted="1.76 Ha (4.35 acres)", confidence=0.5),
        k(2, asset_name="Land at Oakmer Retail Pk", town="", postcode="qx12ab", date="2024-03-01", area_quoted="site of 1.8acres", confidence=0.4),
        k(3, asset_name="Oakmere Retail Park Phase 2", town="Ashby", date="45352"), k(4), k(5, asset_name=" ", area_acres=0.0, area_quoted="not stated"),
    ], deal)
    bro = "brochure_deal_id bigint, file_path string, " + schemas.DEAL
    bc = [x.strip().split()[0] for x in bro.split(",")]
    b = lambda n, **x: tuple((dict.fromkeys(bc) | {"brochure_deal_id": n} | x)[c] for c in bc)
    put("brochure_deals", [b(101, asset_name="OAKMERE R/PARK", town="Ashby", postcode="QX1 2AB"), b(102, asset_name="Oakmere Retail Park (Phase II)", town="Ashby", postcode="QX1"), b(103, asset_name="Fernhill Works", town="Carrowick"), b(104)], bro)
    m = schemas.MAIL
    mc = [x.strip().split()[0] for x in m.split(", ")]
    e = lambda n, **x: tuple((dict.fromkeys(mc) | {"gmail_message_id": n, "sender": "Nell Fenvale <nell.fenvale@firm.example>", "sender_domain": "firm.example", "attachment_names": [], "matched_keywords": []} | x)[c] for c in mc)
    body = "Hi Tavi,\nThe roof is fine.\n\nKind regards,\nNell Fenvale\nPartner\n\nOn Mon, 1 Jan 2024 at 10:00, Tavi Holm <t@x.example> wrote:\n> Dear Nell,\n> Is the roof fine?"
    put("email_summaries", [
        e("a1", subject="RE: Oakmere", date="2024-07-01 10:00:00", body_preview=body, thread_id="t1"), e("a1", subject="RE: Oakmere", date="2024-07-01 10:00:00", body_preview=body, thread_id="t1", matched_label=True),
        e("a2", subject="Oakmere", date="Mon, 01 Jul 2024 08:00:00 +0000", body_preview="", thread_id="t1", attachment_names=["logo.png", "plan.pdf"]), e("a3", date="yesterday", thread_id=" "), e("a4", date="2024-07-01", body_preview=None), e(None, date="1 July 2024"),
    ], m)
    en = "The lease expires in {} with a tenant break option on six months notice. Investor demand for multi let estates remains strong. "
    de = "Das Dach über der Lagerhalle wurde im Jahr {} vollständig erneuert. Die Heizungsanlage ist veraltet und müsste bald ausgetauscht werden. "
    doc = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_kind string, source_deal string, received_at timestamp"
    texts = [(n, en.format(2000 + n) * 2, "en") for n in range(40)] + [(100 + n, de.format(2000 + n) * 2, "de") for n in range(40)]
    texts += [(200, en.format(1) + "\n\n" + de.format(2), None), (201, None, "en"), (202, "", "fr"), (203, "   ", None), (204, de.format(7), "en"), (205, "12345 £££ !!!", "??"), (206, "word " * 9000, "en"), (207, en.format(2001) * 2, "English")]
    put("documents", [(n, t, g, "s", len(t or ""), "memo", None, None) for n, t, g in texts], doc)
    put("pack_limits", [("small", "byte_bpe_50k", 64), ("large", "byte_bpe_50k", 512)], "limit_name string, tokenizer string, capacity bigint")
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, data, tmp_path_factory):
    """The same tables without rows."""
    d = tmp_path_factory.mktemp("empty")
    for p in Path(data).iterdir():
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(f"{d}/{p.name}")
    spark.read.parquet(f"{data}/place_dim.parquet").write.mode("overwrite").parquet(f"{d}/place_dim.parquet")
    spark.read.parquet(f"{data}/pack_limits.parquet").write.mode("overwrite").parquet(f"{d}/pack_limits.parquet")
    return str(d)


@pytest.fixture(scope="session")
def clashing(spark, data, tmp_path_factory):
    """The same tables with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    d = tmp_path_factory.mktemp("clashing")
    for p in Path(data).iterdir():
        df = spark.read.parquet(str(p))
        for c in ("rank", "key", "n", "unit", "number", "street", "sig", "block", "score", "tokens", "ids", "pos", "code", "band"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{d}/{p.name}")
    return str(d)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)
