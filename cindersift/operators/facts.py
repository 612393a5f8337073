"""Tagged facts to aligned fiscal periods.

``facts`` is long: cik, taxonomy, tag, unit, row_pos, start, end, val, fp, form, filed, accn, dates as ISO text.
``row_pos`` is the place in the source; ties go to the first row unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import DURATIONS, SHARE_SERIES, TAGS
from ..functions.expr import iso_date, sum_present
from .asof import nearest
from .shared import share


def span_days() -> Column:
    return F.datediff(iso_date(F.col("end")), iso_date(F.col("start")))


def is_instant() -> Column:
    return F.col("start").isNull()


def is_annual() -> Column:
    span = span_days()
    return F.when(span.isNotNull(), span.between(350, 380)).otherwise(F.coalesce((F.col("fp") == "FY") | (F.col("form") == "10-K"), F.lit(False)))


def is_quarterly() -> Column:
    span = span_days()
    return F.when(span.isNotNull(), span.between(80, 100)).otherwise(F.coalesce(F.col("fp").isin("Q1", "Q2", "Q3", "Q4"), F.lit(False)))


def ends_after_filing() -> Column:
    """Whether a fact's period ends after the filing that carries it: a forecast in a footnote."""
    return F.coalesce(iso_date(F.col("end")) > iso_date(F.col("filed")), F.lit(False))


def tag_table(spark: SparkSession, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """The tag dictionary as a table: concept, taxonomy, tag, prio, unit. Its size is fixed."""
    rows = [(c, *(t.split(":") if ":" in t else ("us-gaap", t)), i, "shares" if c == "shares" else "USD") for c, tags in (concepts or TAGS).items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, taxonomy string, tag string, prio int, unit string")


def tagged(facts: DataFrame, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """Facts of the dictionary's tags with ``concept`` and ``prio``; the dictionary is broadcast."""
    return facts.where("val IS NOT NULL").join(F.broadcast(tag_table(facts.sparkSession, concepts)), ["taxonomy", "tag", "unit"])


def fiscal_year_ends(facts: DataFrame) -> DataFrame:
    """Distinct ends of annual periods: cik, end, rank (1 is the newest)."""
    annual = facts.where((F.col("taxonomy") == "us-gaap") & (F.col("fp") == "FY") & F.col("form").startswith("10-K") & (F.col("end") != "") & ~ends_after_filing())
    return annual.select("cik", "end").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("end"))))


def at_ends(facts: DataFrame, ends: DataFrame, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """The value of each concept at each end: cik, end, concept, val, filed.

    The first tag with a match at that end counts, and of its rows the one filed last. The choice is one
    maximum of a struct in one aggregation, so a row moves once at most.
    """
    annual = (span_days().between(350, 380) & span_days().isNotNull()) | ((F.col("fp") == "FY") & F.col("form").startswith("10-K"))
    duration = F.col("concept").isin(DURATIONS)
    fits = F.when(duration, ~is_instant() & F.coalesce(annual, F.lit(False))).otherwise(is_instant())
    rows = tagged(facts, concepts).where(fits).join(ends.select("cik", "end"), ["cik", "end"])
    best = F.max(F.struct((-F.col("prio")).alias("p"), F.coalesce("filed", F.lit("")).alias("filed"), (-F.col("row_pos")).alias("r"), F.col("val").alias("val")))
    return rows.groupBy("cik", "end", "concept").agg(best.alias("b")).select("cik", "end", "concept", F.col("b.val").alias("val"), F.col("b.filed").alias("filed"))


def period_table(facts: DataFrame, ends: DataFrame, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """Line items side by side: cik, end, rank, financials_filed and a column for each concept, with derived
    liabilities and debt."""
    names = [c for c in (concepts or TAGS) if c != "shares"]
    chosen = at_ends(facts, ends, {c: (concepts or TAGS)[c] for c in names})
    wide = chosen.groupBy("cik", "end").agg(*[F.max(F.when(F.col("concept") == c, F.col("val"))).alias(c) for c in names], F.max("filed").alias("financials_filed"))
    out = ends.join(wide, ["cik", "end"], "left")
    if {"total_liabilities", "balance_sheet_total"} <= set(names):
        out = out.withColumn("total_liabilities", derived_liabilities())
    if {"combined_debt", "long_term_debt", "current_debt"} <= set(names):
        out = out.withColumn("total_debt", F.coalesce("combined_debt", sum_present(F.col("long_term_debt"), F.col("current_debt"))))
    return out


def periods(facts: DataFrame, newest: int | None = None, shares: DataFrame | None = None, by_company: bool = False) -> DataFrame:
    """All line items of each fiscal year: cik, end, rank (1 is the newest), a column for each concept, the derived
    liabilities and debt, shares_outstanding and financials_filed; the ``newest`` years of a company, or all.

    The facts are read once. They are reduced to the best of each company, end and concept in the tasks that read
    them, which also tells whether the end is that of a fiscal year, so what moves does not grow with amendments and
    repeats. The items of an end are its columns then; shares come from an as-of lookup.
    ``shares`` has the facts of share counts where they are at hand apart from the others. ``by_company`` says that
    the facts lie partitioned by company, so that none has to move.
    """
    names = [c for c in TAGS if c != "shares"]
    annual = (F.col("taxonomy") == "us-gaap") & (F.col("fp") == "FY") & F.col("form").startswith("10-K") & (F.col("end") != "") & ~ends_after_filing()
    year = (span_days().between(350, 380) & span_days().isNotNull()) | ((F.col("fp") == "FY") & F.col("form").startswith("10-K"))
    dictionary = F.broadcast(tag_table(facts.sparkSession, {c: TAGS[c] for c in names}))
    rows = facts.where("val IS NOT NULL").join(dictionary, ["taxonomy", "tag", "unit"], "left").withColumn("marks", F.coalesce(annual, F.lit(False)))
    fits = F.when(F.col("concept").isin(DURATIONS), ~is_instant() & F.coalesce(year, F.lit(False))).otherwise(is_instant()) & F.col("concept").isNotNull()
    best = F.max(F.when(fits, F.struct((-F.col("prio")).alias("p"), F.coalesce("filed", F.lit("")).alias("filed"), (-F.col("row_pos")).alias("r"), F.col("val").alias("val"))))
    chosen = rows.where("marks OR concept IS NOT NULL").groupBy("cik", "end", "concept").agg(best.alias("b"), F.bool_or("marks").alias("marks"))
    legs = ["balance_sheet_total", "total_equity", "minority_interest", "temporary_equity"]
    of = lambda c: F.col("concept") == c
    read = F.max(F.when(~F.col("concept").isin(*legs, "current_debt"), F.col("b.filed")))
    items = [F.max(F.when(of(c), F.col("b.val"))).alias(c) for c in names]
    years = (chosen if by_company else chosen.repartition("cik")).groupBy("cik", "end").agg(F.bool_or("marks").alias("marks"), *items, read.alias("read"), F.max(F.when(of("current_debt"), F.col("b.filed"))).alias("current_filed")).where("marks")
    ranked = years.withColumn("rank", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("end"))))
    if newest is not None:
        ranked = ranked.where(F.col("rank") <= newest)
    ranked = share(ranked)
    filed = F.greatest("read", F.when(F.col("combined_debt").isNull(), F.col("current_filed")))
    out = ranked.select("cik", "end", F.col("rank").cast("long").alias("rank"), *names, F.nullif(filed, F.lit("")).alias("financials_filed"))
    out = out.withColumn("total_liabilities", derived_liabilities()).withColumn("total_debt", F.coalesce("combined_debt", sum_present(F.col("long_term_debt"), F.col("current_debt"))))
    shares = shares_as_of(facts if shares is None else shares, ranked).withColumnRenamed("shares", "shares_outstanding")
    return out.join(shares, ["cik", "end"], "left")


def derived_liabilities() -> Column:
    """Reported liabilities, else balance sheet total less equity and temporary equity."""
    equity = F.coalesce(F.col("total_equity"), F.col("book_equity") + F.coalesce(F.col("minority_interest"), F.lit(0.0)))
    return F.coalesce(F.col("total_liabilities"), F.col("balance_sheet_total") - equity - F.coalesce(F.col("temporary_equity"), F.lit(0.0)))


def latest_fact(facts: DataFrame, concept: str, kind: str) -> DataFrame:
    """The latest fact of a concept with its provenance: the first tag with any row counts; rows of the kind
    are preferred to others, then the later end, the later filing, the earlier place."""
    test = {"instant": is_instant(), "annual": is_annual(), "quarterly": is_quarterly()}[kind]
    rows = tagged(facts, {concept: TAGS[concept]})
    key = F.struct((-F.col("prio")).alias("p"), test.cast("int").alias("k"), F.coalesce("end", F.lit("")).alias("end"), F.coalesce("filed", F.lit("")).alias("filed"), (-F.col("row_pos")).alias("r"), "val", "tag", "form", "accn")
    return rows.groupBy("cik").agg(F.max(key).alias("b")).select("cik", F.lit(concept).alias("field"), "b.tag", "b.val", F.col("b.end").alias("period_end"), "b.form", "b.filed", F.col("b.accn").alias("accession"))


def annual_series(facts: DataFrame, concept: str = "revenue") -> DataFrame:
    """Annual values by end, of the first tag that has any annual row: cik, tag, end, val."""
    rows = tagged(facts, {concept: TAGS[concept]}).where(is_annual())
    first = F.min("prio").over(Window.partitionBy("cik"))
    best = F.max(F.struct(F.coalesce("filed", F.lit("")).alias("filed"), (-F.col("row_pos")).alias("r"), "val"))
    return rows.withColumn("first", first).where("prio = first").groupBy("cik", "tag", "end").agg(best.alias("b")).select("cik", "tag", "end", "b.val")


def shares_as_of(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """Share count nearest to each end, from 45 days before to 180 after, by the first tag that has one: cik, end, shares.

    Every end is asked once for each tag; one sort by company, tag and day answers all, however many counts a company has.
    """
    rows = tagged(facts, {"shares": TAGS["shares"]}).select("cik", "prio", F.col("end").alias("at"), "filed", "row_pos", "val")
    asked = ends.select("cik", "end", F.explode(F.array(*[F.lit(k) for k in range(len(TAGS["shares"]))])).alias("prio"))
    near = nearest(asked, rows, ["cik", "prio"], iso_date(F.col("end")), iso_date(F.col("at")), 45, 180, [F.coalesce("filed", F.lit("")), F.col("row_pos")], ["val"])
    return near.where("delta IS NOT NULL").groupBy("cik", "end").agg(F.min(F.struct("prio", "val")).alias("b")).select("cik", "end", F.col("b.val").alias("shares"))


def share_series(facts: DataFrame) -> DataFrame:
    """Share counts by end for dilution: the first tag of three that has rows; the later filing, then the later place, wins."""
    rows = tagged(facts, {"shares": SHARE_SERIES}).where("end <> ''")
    first = F.min("prio").over(Window.partitionBy("cik"))
    best = F.max(F.struct(F.coalesce("filed", F.lit("")).alias("filed"), "row_pos", "val"))
    return rows.withColumn("first", first).where("prio = first").groupBy("cik", F.col("end").alias("period_end")).agg(best.alias("b")).select("cik", "period_end", F.col("b.val").alias("shares"))


def authorized_shares(facts: DataFrame) -> DataFrame:
    """Latest positive count of authorised shares; of one end the later place wins."""
    rows = facts.where("taxonomy = 'us-gaap' AND tag = 'CommonStockSharesAuthorized' AND unit = 'shares' AND val > 0 AND end <> ''")
    return rows.groupBy("cik").agg(F.max(F.struct("end", "row_pos", "val")).alias("b")).select("cik", F.col("b.val").alias("authorized"))
