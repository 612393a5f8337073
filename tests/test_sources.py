import json

from pyspark.sql import functions as F

from cindersift.plans import scan
from cindersift.operators import scoring
from cindersift.sources import readers, sinks
from cindersift.streaming import tape


def one(spark, text, **more):
    return spark.createDataFrame([(*more.values(), text)], ", ".join(f"{k} string" for k in (*more, "value")))


def test_ownership_xml(spark):
    row = "<nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10,000</value></transactionShares><transactionPricePerShare><value>2.50</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"
    doc = f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><officerTitle>CEO</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{row}</nonDerivativeTable><footnotes><footnote id='F1'>a 10b5-1 plan</footnote></footnotes></ownershipDocument>"
    got = readers.ownership_xml(one(spark, doc, cik="1", accession="a")).collect()
    assert [(r.insider, r.role, r.code, r.value, r.is_10b5_1) for r in got] == [("Doe", "CEO", "P", 25000.0, True)]
    assert readers.ownership_xml(one(spark, "<ownershipDocument><broken", cik="1", accession="a")).count() == 0


def test_suspension_page_drops_impossible_dates(spark):
    html = "<tr><td>Feb. 30, 2024</td><td>Bad Co.</td><td>Release No. 34-1</td></tr>\n<tr><td>September 6, 2023</td><td>Good, Inc.</td><td>Release No. 34-99</td></tr>"
    assert [tuple(r) for r in readers.suspensions(one(spark, html)).collect()] == [("Good, Inc.", "2023-09-06", "34-99")]


def test_fails_file_by_header_names(spark):
    lines = ["Date|Ticker|Qty", "20240102|abc|1,500", "20240102||7", "20240103|ABC|x"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no long, value string")
    assert [(r.symbol, r.quantity, r.price) for r in readers.fails(df).collect()] == [("ABC", 1500.0, None)]
    assert readers.ftd_periods(2024, 2, 2) == ["202401b", "202401a", "202312b", "202312a"]


def test_universe_last_duplicate_wins(spark):
    doc = json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [[1, "a", "aa", "OTC"], [2, "b", "AA", "NYSE"], ["x", "c", "cc", ""]]})
    assert [tuple(r) for r in readers.universe(one(spark, doc)).collect()] == [("AA", "0000000002", "NYSE", "b")]


def test_units_by_prefix(spark):
    doc = json.dumps({"cik": "7", "entityName": "E", "facts": {"us-gaap": {"A": {"units": {"USD/x": [{"end": "2023-12-31", "val": 1}], "USD": [{"end": "2023-12-31", "val": 2}, {"end": "2022-12-31"}]}}, "B": {"units": {"USDz": [{"end": "2023-12-31", "val": 3}]}}}}})
    got = readers.one_unit(readers.company_facts(one(spark, doc))).collect()
    assert sorted((r.tag, r.unit, r.val) for r in got) == [("A", "USD", 2.0), ("B", "USD", 3.0)]


def test_search_hits_fall_back(spark):
    doc = json.dumps({"hits": {"hits": [{"_id": "acc-1:doc.htm", "_source": {"root_forms": ["8-K"], "file_date": "2024-01-01"}}, {"_id": "z", "_source": {"form": "10-K", "adsh": "acc-2"}}]}})
    assert sorted((r.form, r.accession) for r in readers.search_hits(one(spark, doc)).collect()) == [("10-K", "acc-2"), ("8-K", "acc-1")]


def test_exports(spark, sf, tmp_path):
    ranked, _ = scan.run(scan.signals(spark, sf))
    rec = sinks.records(ranked).cache()
    sinks.write_parquet(rec, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == rec.count() and sinks.read_disclaimer(back) == sinks.DISCLAIMER
    sinks.write_csv(rec, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).where(F.col("value").startswith("# ")).count() >= 1
    sinks.write_json(rec, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == rec.count()
    assert json.loads(sinks.payload(rec, preset="penny"))["preset"] == "penny" and sinks.markdown(rec, 3).count("\n") == 4
    assert sinks.failure_share(2, 1) and not sinks.failure_share(3, 1) and not sinks.failure_share(0, 0)


def test_scan_requests(spark, sf):
    s = scan.signals(spark, sf).cache()
    everyone = s.count()
    for request in (scan.Request(), scan.Request("trader", "broad", exclude_flagged=True), scan.Request(no_serial_splitter=True, need_insider_buying=True)):
        ranked, excluded = scan.run(s, request)
        assert ranked.count() + excluded.count() == everyone
    scored = scoring.compose(s)
    growth = [r.add_growth for r in scoring.top(scored, None, "growth").collect()]
    assert growth == sorted(growth, reverse=True)


def test_streaming_diff_equals_batch(spark, tmp_path):
    rows = [("A", "2024-01-01", 2.0, ["x"]), ("A", "2024-01-02", -1.0, ["y"]), ("B", "2024-01-01", 1.0, [])]
    kind = "ticker string, scanned_at string, score double, flags array<string>"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = tape.snapshot_diffs(spark.readStream.schema(kind).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("diffs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.ticker, r.scanned_at): (r.delta, r.new_flags) for r in spark.table("diffs").collect()}
    assert got == {("A", "2024-01-01"): (None, []), ("A", "2024-01-02"): (-3.0, ["y"]), ("B", "2024-01-01"): (None, [])}
