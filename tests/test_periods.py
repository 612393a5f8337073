from pyspark.sql import functions as F

from cindersift.functions.expr import iso_date
from cindersift.operators import facts
from cindersift.plans import derived

SF = "/root/testdata/sf0.001"


def test_facts_that_lie_by_company_give_the_same_periods(spark):
    years = derived.fund(spark, SF).repartition(4, "cik").cache()
    years.count()
    filed = lambda values: derived.filed_facts(years, values, apart=True)
    whole = filed(derived.FACT_VALUES)
    apart = facts.periods(whole, shares=filed({"shares": derived.FACT_VALUES["shares"]}), by_company=True)
    plain = facts.periods(whole)
    assert apart.exceptAll(plain).isEmpty() and plain.exceptAll(apart).isEmpty() and not apart.isEmpty()
    years.unpersist()


def test_dates_are_exactly_iso(spark):
    texts = ["2001-02-28", "2001-02-30", "2001-1-01", " 2001-01-01", "2001-01-01\n", "2001-01-01T00:00", "0001-01-01", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", iso_date(F.col("t")).cast("string").alias("d"))
    assert {r.i: r.d for r in rows.collect()} == {i: (t if i in (0, 6) else None) for i, t in enumerate(texts)}
