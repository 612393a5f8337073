import pytest
from pyspark.sql import functions as F

from cindersift.functions import expr, models

ITEMS = "total_assets current_assets current_liabilities total_liabilities retained_earnings ebit book_equity revenue cogs sga depreciation net_income operating_cash_flow receivables inventory net_ppe gross_ppe long_term_debt total_debt cash shares_outstanding capex interest_expense goodwill intangibles goodwill_impairment sbc operating_lease_expense pension_expense market_cap".split()


def periods(spark, *years):
    kind = "struct<" + ",".join(f"{i}:double" for i in ITEMS) + ">"
    row = tuple(tuple(float(y[i]) if y.get(i) is not None else None for i in ITEMS) if y is not None else None for y in years)
    return spark.createDataFrame([row], ", ".join(f"{n} {kind}" for n in ("t", "t1", "t2")[: len(years)]))


T, T1, T2 = "t", "t1", "t2"
HEALTHY = dict(total_assets=100, current_assets=60, current_liabilities=20, total_liabilities=40, retained_earnings=30, ebit=15, book_equity=60)


def test_altman_by_hand(spark):
    got = periods(spark, HEALTHY).select(models.altman(F.col(T))["value"].alias("z"), models.zone(models.altman(F.col(T))["value"]).alias("zone")).first()
    assert got.z == pytest.approx(6.56 * 0.4 + 3.26 * 0.3 + 6.72 * 0.15 + 1.05 * 1.5) and got.zone == "safe"


@pytest.mark.parametrize("gap", list(HEALTHY))
def test_altman_is_suppressed_not_imputed(spark, gap):
    m = models.altman(F.col(T))
    got = periods(spark, HEALTHY | {gap: None}).select(m["value"].alias("z"), m["missing"].alias("missing")).first()
    assert got.z is None and got.missing == [gap]


def test_altman_gate(spark):
    odd = dict(total_assets=100, current_assets=60, current_liabilities=1, total_liabilities=5, retained_earnings=-50, ebit=-5, book_equity=95)
    m = models.altman(F.col(T))
    got = periods(spark, odd).select(m["value"].alias("z"), m["missing"].alias("missing"), m["x4"].alias("x4")).first()
    assert got.z is None and got.x4 == 19 and got.missing == ["applicability:X4_BE_TL"]


@pytest.mark.parametrize("z,zone,health", [(-3.0, "grey", 0.25), (1.0, "grey", 0.75), (-3.01, "distress", None), (1.01, "safe", None)])
def test_zone_boundaries_are_grey_and_anchor_health(spark, z, zone, health):
    got = spark.range(1).select(models.zone(F.lit(z)).alias("zone"), models.health(F.lit(z)).alias("h")).first()
    assert got.zone == zone and (health is None or got.h == pytest.approx(health, abs=1e-6))


def test_health_is_monotonic_and_null_stays_null(spark):
    rows = spark.createDataFrame([(float(z),) for z in (-284, -30, -3, 0, 1, 13)] + [(None,)], "z double").select("z", models.health(F.col("z")).alias("h")).collect()
    hs = [r.h for r in rows if r.z is not None]
    assert hs == sorted(hs) and rows[-1].h is None


def test_piotroski_full_marks(spark):
    t = HEALTHY | dict(revenue=120, cogs=60, net_income=12, operating_cash_flow=20, long_term_debt=5, shares_outstanding=10)
    t1 = HEALTHY | dict(revenue=100, cogs=60, net_income=5, operating_cash_flow=4, long_term_debt=9, shares_outstanding=10, current_assets=50)
    m = models.piotroski(F.col(T), F.col(T1))
    got = periods(spark, t, t1).select(m["value"].alias("v"), m["flags"].alias("f")).first()
    assert got.v == 9 and got.f == ["value-universe-signal", "strong"]
    assert periods(spark, t | {"cogs": None}, t1).select(m["value"].alias("v")).first().v is None


def test_runway_of_a_cash_generator_is_infinite(spark):
    m = models.runway(F.col(T), F.col(T1), F.lit(False))
    got = periods(spark, dict(cash=10, operating_cash_flow=5), {}).select(m["value"].alias("v"), m["flags"].alias("f")).first()
    assert got.v == float("inf") and got.f == ["cash-generating"]
    got = periods(spark, dict(cash=10, operating_cash_flow=-5), dict(operating_cash_flow=-2)).select(m["value"].alias("v"), m["flags"].alias("f")).first()
    assert got.v == 2 and got.f == ["burn-accelerating", "financing-cliff"]


def test_financial_firms_have_no_ebitda_multiple(spark):
    p = periods(spark, dict(ebit=10, depreciation=5, total_debt=20, cash=5, revenue=50, operating_cash_flow=9, capex=2))
    for sic, multiple in ((6021, None), (3674, 115 / 15)):
        m = models.ev_valuation(F.col(T), F.lit(100.0), F.lit(sic))
        got = p.select(m["value"].alias("v"), m["ev_ebitda"].alias("x"), m["fcf_yield"].alias("y")).first()
        assert got.v == pytest.approx(115 / 50) and got.y == pytest.approx(7 / 115) and got.x == (pytest.approx(multiple) if multiple else None)


def test_null_safe_helpers(spark):
    got = spark.range(1).select(
        expr.ratio(F.lit(1.0), F.lit(0.0)).alias("zero"), expr.clamp(F.lit(None).cast("double")).alias("clamp"), expr.sum_present(F.lit(None).cast("double"), F.lit(2.0)).alias("one"),
        expr.sum_present(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("none"), expr.iso_date(F.lit("2024-02-30")).alias("bad"), expr.iso_date(F.lit("2024")).alias("year"), expr.iso_date(F.lit("2024-02-29")).cast("string").alias("good"),
        expr.number(F.lit("$1,234.5")).alias("n"), expr.number(F.lit("12d")).alias("d"), expr.recent(F.lit("2024-01-31").cast("date"), F.lit("soon"), 5).alias("unknown"), expr.recent(F.lit("2024-01-31").cast("date"), F.lit("2025-01-01"), 5).alias("ahead"),
        expr.recent_between(F.lit("2024-01-31").cast("date"), F.lit("2025-01-01"), 5).alias("between"),
    ).first()
    assert [got.zero, got.clamp, got.none, got.bad, got.year, got.d] == [None] * 6
    assert (got.one, got.good, got.n, got.unknown, got.ahead, got.between) == (2.0, "2024-02-29", 1234.5, True, True, False)
