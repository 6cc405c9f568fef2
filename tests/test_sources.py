from __future__ import annotations

import json

from pyspark.sql import functions as F

from parcelforge import extract
from parcelforge.sources import files, mailbox, versions
from parcelforge.streaming import ingest
from tests.conftest import rows


def test_mailbox(spark, tmp_path):
    ms = lambda d: 1704067200000 + d * 86400000
    lines = [{"id": "a", "threadId": "t", "internalDate": str(ms(0)), "labelIds": ["In box", "X"], "payload": {"headers": []}}, {"id": "b", "internalDate": str(ms(5)), "labelIds": []}, {"id": "c", "internalDate": str(ms(9)), "labelIds": ["X"]}]
    (tmp_path / "1.jsonl").write_text("\n".join([*map(json.dumps, lines), "broken"]))
    assert rows(mailbox.scan(spark, str(tmp_path), after="2023-12-31", before="2024-01-10", label="X"), "id", "labelled") == [("a", True), ("b", False)]
    assert mailbox.query_text("2024/01/01", None, "my label") == "after:2024/01/01 label:my-label"
    empty = tmp_path / "none"
    empty.mkdir()
    assert mailbox.scan(spark, str(empty)).count() == 0


def test_archive(spark, tmp_path):
    (tmp_path / "Deal A" / "2024").mkdir(parents=True)
    (tmp_path / "Deal A" / "2024" / "x.PDF").write_bytes(b"12")
    (tmp_path / "Deal A" / "2024" / "metadata.json").write_text('{"gmail_message_id": "m", "deal_extraction": {"postcode": "AB1 2CD"}}')
    (tmp_path / "loose.xlsx").write_bytes(b"1")
    assert rows(files.archive_files(spark, str(tmp_path)), "name", "size", "deal", "kind") == [("loose.xlsx", 1, "loose", "sheet"), ("x.PDF", 2, "Deal A", "pdf")]
    assert files.archive_files(spark, str(tmp_path), depth=2).count() == 1
    assert rows(files.metadata(spark, str(tmp_path)), "gmail_message_id", "postcode", "agent") == [("m", "AB1 2CD", None)]


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,Price\nOak,\"£1,200\"\n ,5\nElm,0\n")
    got = rows(files.sheet(spark, str(tmp_path / "s.csv"), {"name": "STRING", "price": "DOUBLE"}, key="name"), "row", "name", "price")
    assert got == [(2, "Oak", 1200.0), (4, "Elm", None)]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.read_latest(spark, root, "a bigint").count() == 0
    for n in range(1, 5):
        versions.write_version(spark.range(n).withColumnRenamed("id", "a"), root, keep=2)
    assert versions.versions(spark, root) == [3, 4]
    assert versions.read_latest(spark, root, "a bigint").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    src, led, out, cp = (str(tmp_path / x) for x in ("src", "ledger", "out", "cp"))
    schema = "gmail_message_id string, subject string"
    for part in ([("a", "1"), ("a", "2"), ("b", "1")], [("b", "9"), ("c", "1")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.run_stream(spark, src, schema, led, out, cp).awaitTermination()
    assert rows(spark.read.parquet(out), "gmail_message_id") == [("a",), ("b",), ("c",)]
    assert ingest.ingest_batch(spark.createDataFrame([("c", "x"), ("d", "y")], schema), led, 99).count() == 1


def test_sessions(spark):
    df = spark.createDataFrame([("t", "2024-01-01"), ("t", "2024-02-01"), ("t", "2024-08-01")], "thread_id string, d string").withColumn("at", F.to_timestamp("d"))
    assert sorted(r["mails"] for r in ingest.thread_windows(df, "at").collect()) == [1, 2]


def test_extraction(spark):
    ddl = "unit_name STRING, rent_pa DOUBLE"
    asks = spark.createDataFrame([("a",), ("b",), ("c",)], "request_key string")
    replies = spark.createDataFrame([("a", 'Here: {"comparables": [{"unit_name": "U1", "rent_pa": "£1,000"}, {"unit_name": "None", "rent_pa": null}]}'), ("b", "sorry")], "request_key string, response string")
    got = extract.ReplayExtractor(replies).ask(asks)
    assert rows(extract.records(got, "request_key", ddl)) == [("a", 0, "U1", 1000.0), ("a", 1, "", None)]
    comps = extract.records(got, "request_key", ddl)
    verdicts = spark.createDataFrame([("a", 2, "Remove")], "request_key string, pos int, verdict string")
    assert extract.judged(comps, verdicts, "request_key").count() == 1 and extract.judged(comps, verdicts.limit(0), "request_key").count() == 2


def test_scan_command(spark, tmp_path):
    from argparse import Namespace

    from parcelforge.__main__ import scan

    mail = lambda i, sender, subject, labels=(): {"id": i, "threadId": i, "internalDate": "1704067200000", "labelIds": list(labels), "payload": {"headers": [{"name": "From", "value": sender}, {"name": "Subject", "value": subject}], "mimeType": "text/plain", "body": {"data": ""}}}
    (tmp_path / "1.jsonl").write_text("\n".join(json.dumps(x) for x in [mail("a", "N <n@firm.example>", "hello"), mail("b", "x@other.example", "To introduce Oak"), mail("c", "x@other.example", "no"), mail("d", "x@other.example", "no", ["L"])]))
    args = Namespace(dump=str(tmp_path), after=None, before=None, label="L", senders="firm.example", keywords="introduce", all=False, max=10)
    assert rows(scan(spark, args), "id") == [("a",), ("b",), ("d",)]
    args.all = True
    assert rows(scan(spark, args), "id") == [("d",)]


def test_workbooks(spark, tmp_path):
    from parcelforge.sources import workbook

    df = spark.createDataFrame([(2, "Oak & <Mill>", 1200.0), (1, None, 0.0), (3, " ", 5.0)], "n int, name string, price double")
    at = str(tmp_path / "a.xlsx")
    assert workbook.write_workbook(df, at, "Data", ["name", "price"], ["Name", "Price"], order="n") == 3
    assert rows(workbook.workbook_table(spark, at, "Data", {"name": "STRING", "price": "DOUBLE"}, key="name"), "row", "name", "price") == [(3, "Oak & <Mill>", 1200.0)]
    assert workbook.workbook_table(spark, at, "Other", {"name": "STRING"}).count() == 0
    (tmp_path / "broken.xlsx").write_bytes(b"no")
    texts = dict(rows(workbook.workbook_texts(spark.read.format("binaryFile").load(str(tmp_path)))))
    assert sorted(texts.values()) == ["", "--- Sheet: Data ---\nName | Price\n0.0\nOak & <Mill> | 1200.0\n5.0"]
    assert workbook.column_number("AB12") == 27


def test_documents(spark, tmp_path):
    from parcelforge.sources import documents

    (tmp_path / "a.pdf").write_bytes(b"short")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = documents.document_texts(files, {"pdf": lambda d: d.decode() * 30, "sheet": documents.READERS["sheet"]})
    assert sorted(r["route"] for r in got.collect()) == ["none", "none", "text"]
    assert sorted(r["route"] for r in documents.document_texts(files).collect()) == ["images", "none", "none"]
