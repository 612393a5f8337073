"""Dilution: share-count history, registrations, wording and their fusion into one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import NT_FORMS, SHELF_FORMS, TOXIC_PHRASES
from ..functions.expr import iso_date, listed, ratio, recent, severity
from .asof import nearest

SPLIT_LEAST, SPLIT_MOST = 1.8, 250.0
SPIRAL = 0.20


def form() -> Column:
    return F.upper(F.trim("form"))


def year_before(text: Column) -> Column:
    """The same day a year earlier; null for 29 February."""
    day = iso_date(text)
    return F.when(~((F.month(day) == 2) & (F.dayofmonth(day) == 29)), F.add_months(day, -12))


def year_ago(points: DataFrame) -> DataFrame:
    """The share count nearest to one year before each company's latest, within 45 days: cik, year_ago."""
    last = points.groupBy("cik").agg(F.max("period_end").alias("latest")).withColumn("target", year_before(F.col("latest")))
    near = nearest(last.drop("latest"), points, ["cik"], F.col("target"), iso_date(F.col("period_end")), 45, 45, [F.col("period_end"), F.col("shares")], ["shares"])
    return near.where("delta IS NOT NULL").select("cik", F.col("shares").alias("year_ago"))


def velocity(points: DataFrame) -> DataFrame:
    """Growth from point to point and over a year, its trend, and whether it spirals, at each company's latest point."""
    order = Window.partitionBy("cik").orderBy("period_end")
    moved = points.withColumn("p1", F.lag("shares").over(order)).withColumn("p2", F.lag("shares", 2).over(order)).withColumn("r", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("period_end")))).where("r = 1")
    step = lambda now, then: F.when(then > 0, (now - then) / then)
    out = moved.join(year_ago(points), "cik", "left")
    qoq, before = step(F.col("shares"), F.col("p1")), step(F.col("p1"), F.col("p2"))
    known = F.col("p1").isNotNull()
    return out.select(
        "cik", F.col("shares").alias("latest"), qoq.alias("qoq"), F.when(known, step(F.col("shares"), F.col("year_ago"))).alias("yoy"),
        F.when(qoq.isNotNull() & before.isNotNull(), F.when(qoq > before, "accelerating").otherwise("decelerating")).alias("trend"),
        F.coalesce(qoq >= SPIRAL, F.lit(False)).alias("death_spiral"), (~known).alias("low_confidence"),
    )


def reverse_splits(points: DataFrame) -> DataFrame:
    """Reverse splits read from falls of the share count: cik, n_splits, serial, since_year, last_split, cumulative."""
    order = Window.partitionBy("cik").orderBy("period_end")
    fell = points.withColumn("prev", F.lag("shares").over(order)).where("prev > 0 AND shares > 0").withColumn("ratio", F.col("prev") / F.col("shares")).where(F.col("ratio").between(SPLIT_LEAST, SPLIT_MOST))
    return fell.groupBy("cik").agg(F.count(F.lit(1)).alias("n_splits"), F.min(F.substring("period_end", 1, 4)).alias("since_year"), F.max("period_end").alias("last_split"), F.product("ratio").alias("cumulative")).withColumn("serial", F.col("n_splits") >= 2)


def registrations(filings: DataFrame, as_of: Column) -> DataFrame:
    """Shelves, prospectus supplements and late-filing notices of each company in one aggregation.

    ``filings`` may have ``offering_amount`` and ``text``; where it lacks them they count as missing.
    """
    for name, kind in (("offering_amount", "double"), ("text", "string")):
        if name not in filings.columns:
            filings = filings.withColumn(name, F.lit(None).cast(kind))
    shelf, nt = form().isin(SHELF_FORMS), form().isin(NT_FORMS) | form().contains("12B-25")
    grave = F.lower(F.coalesce("text", F.lit(""))).rlike("restatement|going concern|substantial doubt")
    return filings.groupBy("cik").agg(
        F.count_if(shelf).alias("n_shelves"), F.max(F.when(shelf, F.col("offering_amount"))).alias("max_amount"), F.coalesce(F.bool_or(form() == "S-3ASR"), F.lit(False)).alias("wksi"),
        F.count_if(form() == "424B3").alias("n_424b3"), F.count_if(form() == "424B5").alias("n_424b5"),
        (F.count_if((form() == "424B3") & recent(as_of, F.col("filing_date"), 60)) >= 2).alias("active_atm"),
        F.count_if(nt).alias("n_late"), F.coalesce(F.bool_or(nt & grave), F.lit(False)).alias("late_escalated"),
    )


def shelf_share(amount: Column, market_cap: Column) -> Column:
    """Largest shelf as per cent of the market value; a zero of either counts as missing."""
    return F.when((amount != 0) & (market_cap != 0), amount / market_cap * 100.0)


def utilization(shelf: Column, drawn: Column) -> dict[str, Column]:
    return {"drawn": F.when(shelf.isNotNull(), drawn), "remaining": shelf - drawn, "pct_drawn": ratio(drawn, shelf) * 100.0}


def toxic_terms(text: Column) -> Column:
    """The phrases of toxic financing that a text has, in the order of the list."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in TOXIC_PHRASES]))


def headroom(authorized: Column, outstanding: Column) -> dict[str, Column]:
    """How much of the authorised count is left; unknown where more is outstanding than authorised."""
    sound = (authorized > 0) & (outstanding <= authorized)
    return {"pct": F.when(sound, (authorized - outstanding) / authorized * 100.0), "near_ceiling": F.coalesce(sound & (outstanding / F.when(authorized > 0, authorized) >= 0.90), F.lit(False))}


def overhang(basic: Column, parts: list[Column], float_shares: Column) -> dict[str, Column]:
    """Shares that options, warrants and the like would add; partial if any part is unknown."""
    more, partial = F.lit(0.0), basic.isNull()
    for p in parts:
        more, partial = more + F.coalesce(p, F.lit(0.0)), partial | p.isNull()
    return {"fully_diluted": basic + more, "pct": F.when(basic.isNotNull(), ratio(more, F.coalesce(float_shares, basic)) * 100.0), "partial": partial}


def shell_signs(is_shell: Column, ever_506: Column, employees: Column, revenue: Column, shares: Column) -> Column:
    """How many of four signs of a shell company hold; two make a shell."""
    tests = [is_shell, ever_506 > 0, employees <= 5, (revenue < 100_000) & (shares > 50_000_000)]
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))


def fuse(c: dict[str, Column]) -> dict[str, Column]:
    """Score 0 to 100, severity and flags from the single findings.

    Findings: shelf_pct, wksi, active_atm, toxic, death_spiral, near_ceiling, overhang_pct, n_splits,
    late, late_escalated, shell, restatement, churn, insider_buying.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    serial, split = yes(c["n_splits"] >= 2), yes(c["n_splits"] >= 1)
    rules = [
        (yes((c["shelf_pct"] > 100) & ~c["wksi"]), 15, "DILUTION-SHELF-LARGE"), (yes(c["active_atm"]), 15, "ACTIVE-ATM"), (yes(c["toxic"]), 20, "TOXIC-FINANCING"),
        (yes(c["death_spiral"]), 20, "DILUTION-VELOCITY-HIGH"), (yes(c["near_ceiling"]), 10, "AUTHORIZED-HEADROOM-LOW"), (yes(c["overhang_pct"] > 100), 15, "OVERHANG-HIGH"),
        (serial, 20, "SERIAL-SPLITTER"), (split & ~serial, 8, "REVERSE-SPLIT"), (yes(c["late_escalated"]), 15, "NT-RESTATEMENT"), (yes(c["late"]) & ~yes(c["late_escalated"]), 5, "NT-LATE"),
        (yes(c["shell"]), 15, "SHELL-ARC"), (yes(c["restatement"]), 15, "RESTATEMENT"), (yes(c["churn"]), 10, "AUDITOR-CHURN"),
    ]
    points = sum((F.when(test, F.lit(p)).otherwise(F.lit(0)) for test, p, _ in rules), F.lit(0))
    eased = F.when(yes(c["insider_buying"]) & (points > 0), F.greatest(F.lit(0), points - 10)).otherwise(points)
    score = F.least(F.lit(100), eased)
    return {"score": score, "severity": severity(score), "flags": listed(*[(test, name) for test, _, name in rules])}
