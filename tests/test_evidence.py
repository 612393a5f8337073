import datetime
import json

from pyspark.sql import functions as F

from cindersift.functions.constants import CORE_INPUTS
from cindersift.operators import evidence, watch
from cindersift.plans import scan
from cindersift.sources import readers, sinks


def test_candidates_keep_their_first_place(spark):
    rows = [(" bbb ", 0), ("AAA", 1), ("BBB", 2), ("", 3), (None, 4), ("aaa", 5)]
    got = evidence.candidates(spark.createDataFrame(rows, "ticker string, pos int")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("BBB", 0), ("AAA", 1)]


def test_own_number_comes_first(spark):
    asked = spark.createDataFrame([("A", "7"), ("B", " "), ("C", None)], "ticker string, cik string")
    known = spark.createDataFrame([("A", "1"), ("B", "2")], "ticker string, cik string")
    assert {r.ticker: r.cik for r in evidence.resolve(asked, known).collect()} == {"A": "7", "B": "2", "C": None}


def test_notes(spark):
    schema = "n int, reason string, t struct<" + ", ".join(f"{c}: double" for c in CORE_INPUTS) + ">"
    full, half = [1.0] * 8, [None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None]
    df = spark.createDataFrame([(0, None, full), (1, None, half), (2, None, full), (2, "no CIK", half)], schema)
    notes = evidence.fundamentals_notes(F.col("n"), F.lit("2023-12-31"), evidence.missing_inputs(F.col("t")))
    got = [r.x for r in df.select(evidence.completeness(F.col("reason"), notes).alias("x")).collect()]
    assert got[0] == ["fundamentals suppressed (no annual 10-K period in companyfacts)"]
    assert got[1] == ["fundamentals limited to one annual period (prior year unavailable)", "core inputs unavailable for 2023-12-31: total_assets, revenue (dependent metrics suppressed)"]
    assert got[2:] == [[], ["degraded: no CIK"]]


def test_freshness_takes_the_first_that_is_there(spark):
    now = F.lit(datetime.datetime(2024, 1, 2, 3, 4))
    kind = "pos int, financials_period string, financials_filed string, institutional boolean"
    got = evidence.freshness(spark.createDataFrame([(0, "", "2024-02-01", False), (1, "2023-12-31", None, None), (2, "2022-12-31", "x", True)], kind), now, cached=True).collect()
    assert [r.domain for r in got] == ["filings/news", "financials", "institutional (13F)"]
    assert got[1].line.startswith("financials: latest filed 2023-12-31 (filed 2024-02-01) (cached)")
    assert [r.domain for r in evidence.freshness(spark.createDataFrame([], kind), now).collect()] == ["filings/news"]


def test_probes_heed_form_window_and_company(spark):
    rows = [("1", "8-K", "2024-01-05", "must REGAIN compliance"), ("1", "10-K", "2024-01-05", "regain compliance"), ("2", "S-1", "2024-01-31", "Beneficial Ownership Limitation"), ("2", "8-K", "2023-01-01", "minimum bid price"), ("3", "8-K", "2024-01-09", None)]
    filed = spark.createDataFrame(rows, "cik string, form string, filing_date string, text string")
    window = F.lit("2024-01-01"), F.lit("2024-01-31")
    assert sorted(map(tuple, readers.stock_probes(filed, *window).collect())) == [("1", "delisting", 1), ("2", "toxic", 1)]
    assert [r.cik for r in readers.stock_probes(filed, *window, cik="2").collect()] == ["2"]


def test_first_provider_with_an_answer(spark):
    keys = spark.createDataFrame([("A",), ("B",), ("C",)], "k string")
    one, two = spark.createDataFrame([("A", 1)], "k string, v int"), spark.createDataFrame([("A", 2), ("B", 3), ("B", 4)], "k string, v int")
    got = {r.k: (r.provider, r.v, r.failure) for r in readers.cascade(keys, "k", {"one": one, "two": two}).collect()}
    assert got == {"A": ("one", 1, None), "B": ("two", 3, None), "C": (None, None, "no answer from one, two")}


def test_a_bad_payload_stops_no_other(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "value string")
    assert [(r.parsed.a if r.parsed else None, r.failure) for r in readers.isolated(df, "a int").collect()] == [(1, None), (None, "unreadable payload"), (None, "unreadable payload")]


def test_watchlist_order(spark):
    df = spark.createDataFrame([("B", "2"), ("C", "1"), ("A", "2")], "ticker string, added_at string")
    assert [r.ticker for r in watch.listing(df).collect()] == ["C", "A", "B"]


def test_whole_scan_is_written(spark, sf, tmp_path):
    ranked, excluded = scan.run(scan.signals(spark, sf))
    assert sinks.write_scan(ranked, excluded, str(tmp_path / "s"), preset="penny")
    assert spark.read.json(str(tmp_path / "s/results")).count() == ranked.count()
    assert json.loads(spark.read.text(str(tmp_path / "s/meta")).first().value)["preset"] == "penny"
    assert not sinks.write_scan(ranked.limit(0), excluded, str(tmp_path / "none")) and not (tmp_path / "none").exists()
    cut = json.loads(sinks.payload(sinks.records(ranked), most=1))
    assert cut["truncated"] and len(cut["results"]) == 1
