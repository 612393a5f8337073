"""What the scan takes from texts, values, insiders and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindersift.operators import dilution
from cindersift.plans import scan

FILING = "cik long, pos int, form string, filing_date string, accession string, items string, text string, offering_amount double"


def test_wording_is_counted_in_one_pass(spark):
    rows = [
        (1, "8-K", "2024-01-31", "to REGAIN compliance"), (1, "8-K", "2023-08-04", "Minimum Bid Price"), (1, "8-K", "2023-08-03", "minimum bid price"),  # 180 days back count, 181 do not
        (1, "10-K", "2024-01-01", "listing qualifications, floorless"), (2, "8-K", None, "regain compliance"), (2, "8-K", "2024-01-01", None), (None, "8-K", "2024-01-01", "floorless"),
    ]
    df = spark.createDataFrame(rows, "cik long, form string, filing_date string, text string")
    assert {r.cik: (r.n_toxic, r.n_language) for r in scan.wording(df, "2024-01-31").collect()} == {1: (1, 2), 2: (0, 0), None: (1, 0)}
    assert scan.wording(df.limit(0), "2024-01-31").count() == 0


def test_a_large_shelf_counts_and_buying_eases(spark):
    filings = spark.createDataFrame([(c, 0, "S-3", "2024-01-01", "a", None, None, 300.0) for c in (1, 2, 3, 4)] + [(5, 0, "S-3ASR", "2024-01-01", "a", None, None, 300.0)], FILING)
    points = spark.createDataFrame([], "cik long, period_end string, shares double")
    tape = spark.createDataFrame([], "cik long, ever_401 long, ever_402 long, ever_506 long")
    words = spark.createDataFrame([], "cik long, n_toxic long, n_language long")
    values = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 300.0), (4, 0.0), (5, 100.0)], "cik long, market_cap double")
    people = spark.createDataFrame([(2, True), (3, True)], "cik long, insider_buying boolean")
    got = {r.cik: (r.dilution_score, r.dilution_flags) for r in scan.dilution_profile(points, filings, tape, words, "2024-01-31", values=values, people=people).collect()}
    large = ["DILUTION-SHELF-LARGE"]
    assert got == {1: (15, large), 2: (5, large), 3: (0, []), 4: (0, []), 5: (0, [])}  # equal to the value, no value, a seasoned issuer
    bare = scan.dilution_profile(points, filings, tape, words, "2024-01-31")
    assert bare.agg(F.sum("dilution_score")).first()[0] == 0


def test_the_last_split_is_told(spark):
    rows = [(1, "2020-03-31", 100.0), (1, "2020-06-30", 10.0), (1, "2021-06-30", 30.0), (1, "2022-06-30", 3.0), (1, "2023-06-30", 3.0)]
    got = dilution.reverse_splits(spark.createDataFrame(rows, "cik long, period_end string, shares double")).first()
    assert (got.n_splits, got.since_year, got.last_split) == (2, "2020", "2022-06-30")
