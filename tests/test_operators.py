import datetime

from pyspark.sql import functions as F

from cindersift.operators import dilution, events, facts, insider, market, scoring, watch
from cindersift.operators.ordering import global_rank



def points(spark, *shares):
    dates = [(datetime.date(2022, 12, 31) + datetime.timedelta(days=92 * i)).isoformat() for i in range(len(shares))]
    return spark.createDataFrame([(1, d, float(s)) for d, s in zip(dates, shares, strict=True)], "cik long, period_end string, shares double")


def test_reverse_splits_multiply(spark):
    got = dilution.reverse_splits(points(spark, 100e6, 10e6, 30e6, 6e6)).first()
    assert (got.n_splits, got.serial, round(got.cumulative, 6)) == (2, True, 50.0)
    assert dilution.reverse_splits(points(spark, 100e6, 1e5)).count() == 0  # an implausible fall is an error in the data


def test_velocity_and_its_trend(spark):
    got = dilution.velocity(points(spark, 100, 110, 150)).first()
    assert round(got.qoq, 6) == round(40 / 110, 6) and got.death_spiral and got.trend == "accelerating"
    assert dilution.velocity(points(spark, 100)).first().low_confidence


def test_year_before_leap_day_is_unknown(spark):
    got = spark.range(1).select(dilution.year_before(F.lit("2024-02-29")).alias("a"), dilution.year_before(F.lit("2024-03-31")).cast("string").alias("b")).first()
    assert got.a is None and got.b == "2023-03-31"


def test_ties_keep_the_first_or_the_last_row(spark):
    rows = [(1, "us-gaap", "Revenues", "USD", 0, "2023-01-01", "2023-12-31", 5.0, "FY", "10-K", "2024-03-01", "a"), (1, "us-gaap", "Revenues", "USD", 1, "2023-01-01", "2023-12-31", 6.0, "FY", "10-K", "2024-03-01", "b"),
            (1, "dei", "EntityCommonStockSharesOutstanding", "shares", 0, None, "2023-12-31", 7.0, "FY", "10-K", "2024-03-01", "c"), (1, "dei", "EntityCommonStockSharesOutstanding", "shares", 1, None, "2023-12-31", 8.0, "FY", "10-K", "2024-03-01", "d"),
            (1, "us-gaap", "Assets", "USD", 2, None, "2030-12-31", 1.0, "FY", "10-K", "2024-03-01", "e")]
    f = spark.createDataFrame(rows, "cik long, taxonomy string, tag string, unit string, row_pos int, start string, end string, val double, fp string, form string, filed string, accn string")
    ends = facts.fiscal_year_ends(f)
    assert [r.end for r in ends.collect()] == ["2023-12-31"]
    assert [r.val for r in facts.at_ends(f, ends).where("concept = 'revenue'").collect()] == [5.0]
    assert facts.shares_as_of(f, ends).first().shares == 7.0 and facts.share_series(f).first().shares == 8.0


def test_event_takes_the_first_code_of_the_worst_severity(spark):
    rows = [(1, 0, "8-K", "2024-06-01", "a", "1.01,3.02,9.01"), (1, 1, "8-K/A", "bad date", "b", " Item 4.02 , 1.03"), (1, 2, "8-K", "2023-01-01", "c", "6.99"), (1, 3, "10-K", "2024-01-01", "d", "1.03"), (1, 4, "8-K", "2024-06-02", "e", None)]
    got = {r.accession: r for r in events.build(spark.createDataFrame(rows, "cik long, pos int, form string, filing_date string, accession string, items string")).collect()}
    assert (got["a"].category, got["a"].severity, got["a"].codes) == ("financing", 3.0, ["1.01", "3.02", "9.01"])
    assert got["b"].category == "distress" and got["b"].is_amendment and got["c"].category == "uncategorized" and got["e"].severity == 0 and "d" not in got


def test_insider_cluster(spark):
    rows = [(1, "x", "P", 60_000.0, False, False), (1, "y", "P", 60_000.0, False, False), (1, "x", "A", 9.0, False, False), (1, "z", "S", 5.0, True, True)]
    got = insider.profile(spark.createDataFrame(rows, "cik long, insider string, code string, value double, is_10b5_1 boolean, preceded_by_exercise boolean")).first()
    assert (got.buyers, got.net, got.confidence, got.conviction, got.sold_by_plan, got.sold_after_exercise, got.n_excluded) == (2, "bullish", "medium", 40, 5.0, 0.0, 1)


def test_delisting_tiers(spark):
    none, no = F.lit(None), F.lit(False)
    tiers = {}
    for name, args in {"notice": (F.lit(True), none, no, no, no, no), "penny": (no, F.lit(0.05), no, no, no, no), "again": (F.lit(True), none, no, no, F.lit(True), no), "spoken": (F.lit(True), none, F.lit(True), no, no, no)}.items():
        d = market.delisting(args[0], args[1].cast("double"), *args[2:])
        tiers[name] = spark.range(1).select(d["tier"].alias("t"), d["hard_exclude"].alias("h"), d["flags"].alias("f")).first()
    assert (tiers["notice"].t, tiers["penny"].t, tiers["again"].t, tiers["again"].h) == ("deficiency", "imminent", "determination", True)
    assert "DELISTING-LANGUAGE" not in tiers["spoken"].f


def test_company_names_match_without_suffixes(spark):
    c = spark.createDataFrame([("Acme, Inc.",), ("Inc",), ("Other Co",)], "name string")
    s = spark.createDataFrame([("ACME CORP", "2024-06-01"), ("acme", "2020-01-01"), ("LTD", "2024-06-01")], "company string, date string")
    got = {r.name: (r.n_listed, r.suspended) for r in market.suspensions_of(c, s, F.lit("2024-06-30").cast("date")).collect()}
    assert got == {"Acme, Inc.": (2, True), "Inc": (0, False), "Other Co": (0, False)}


def test_fails_to_deliver(spark):
    rows = [("S", "20240102", 150000.0, 1), ("S", "20240105", 200000.0, 2), ("S", "20240105", 9.0, 3)]
    got = market.settlement_stress(spark.createDataFrame(rows, "symbol string, settlement_date string, quantity double, line_no long")).first()
    assert (got.n_dates, got.total_fails, got.latest_fails, got.persistent) == (2, 350009.0, 200000.0, True)


def test_snapshots_alert_against_the_one_before(spark):
    rows = [("A", "2024-01-01", 2.0, ["x"]), ("A", "2024-01-02", -1.0, ["TOXIC-FINANCING"]), ("B", "2024-01-01", None, [])]
    got = {(r.ticker, r.scanned_at): r for r in watch.diff(spark.createDataFrame(rows, "ticker string, scanned_at string, score double, flags array<string>")).collect()}
    assert got["A", "2024-01-01"].alerts == [] and got["A", "2024-01-02"].alerts == ["new flag TOXIC-FINANCING", "score -3"]
    assert got["A", "2024-01-02"].cleared_flags == ["x"]


def test_watchlist_is_idempotent(spark):
    w = spark.createDataFrame([("A", "t0")], "ticker string, added_at string")
    more = watch.add(w, spark.createDataFrame([("a",), (" b ",), ("b",)], "ticker string"), F.lit("t1"))
    assert sorted(map(tuple, more.collect())) == [("A", "t0"), ("B", "t1")]
    assert [r.ticker for r in watch.remove(more, spark.createDataFrame([("a",)], "ticker string")).collect()] == ["B"]


def test_global_rank_equals_one_window(spark):
    df = spark.range(500).select((F.col("id") % 2 == 0).alias("gated"), (F.col("id") * 37 % 101).cast("double").alias("composite"), F.col("id").cast("string").alias("ticker"))
    rows = global_rank(df, "gated", [F.desc("composite"), F.asc("ticker")]).collect()
    for g in (True, False):
        own = sorted((r for r in rows if r.gated == g), key=lambda r: (-r.composite, r.ticker))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


def test_every_profile_and_preset_has_weights():
    for profile in scoring.PROFILES:
        for preset in scoring.PRESETS:
            pos, factor = scoring.weights(profile, preset)
            assert set(pos) == set(scoring.POSITIVES) and set(factor) == set(scoring.MODULES)
    assert scoring.weights("hold", "penny")[1]["sbc_dilution"] is None and scoring.weights("hold", "broad")[1]["dilution"] == 1.6 * 0.1
