"""Delisting tiers, trading suspensions, fails to deliver and susceptibility to manipulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LEGAL_SUFFIXES, TIERS
from ..functions.expr import listed, recent_between, severity

SUSPENSION_DAYS = 180


def normal_name(name: Column) -> Column:
    """A company name for comparison: upper case, no punctuation, no legal suffixes."""
    words = F.split(F.trim(F.upper(F.regexp_replace(name, r"[^A-Za-z0-9 ]", " "))), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(LEGAL_SUFFIXES)), " ")


def suspensions_of(companies: DataFrame, suspensions: DataFrame, as_of: Column, days: int = SUSPENSION_DAYS) -> DataFrame:
    """Suspensions of each company by normalised name: its columns plus n_listed, latest and suspended.

    ``companies`` has ``name``; ``suspensions`` has company and date. An empty name matches nothing. A name not
    listed has n_listed 0 and is not suspended; ``suspended`` means within the look-back, not at this moment.
    Where the list itself is empty nothing could be checked: n_listed and suspended are null and ``note`` says so.
    """
    rows = suspensions.withColumn("norm", normal_name(F.col("company"))).where("norm <> ''")
    held = rows.groupBy("norm").agg(F.count(F.lit(1)).alias("n_listed"), F.max("date").alias("latest"), F.bool_or(recent_between(as_of, F.col("date"), days)).alias("suspended"))
    out = companies.withColumn("norm", normal_name(F.col("name"))).join(held, "norm", "left").drop("norm")
    read = not suspensions.isEmpty()
    n, no = (F.lit(0).cast("long"), F.lit(False)) if read else (F.lit(None).cast("long"), F.lit(None).cast("boolean"))
    note = F.lit(None if read else "suspension list is empty; could not check").cast("string")
    return out.withColumn("n_listed", F.coalesce("n_listed", n)).withColumn("suspended", F.coalesce("suspended", no)).withColumn("note", note)


def delisting(notice: Column, price: Column, language: Column, going_concern: Column, split_within_year: Column, disclosed: Column) -> dict[str, Column]:
    """Tier of delisting risk, the highest that anything triggers, with flags and the hard gate."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    notice, tiny, low = yes(notice), yes(price <= 0.10), yes(price < 1.00)
    again = yes(split_within_year) & (notice | low)
    spoken = yes(language) & ~notice
    rules = [
        (tiny, 3, "PRICE-SUB-10C"), (low & ~tiny, 1, "PRICE-SUB-1"), (notice, 2, "DELISTING-DEFICIENCY"), (spoken, 1, "DELISTING-LANGUAGE"),
        (yes(going_concern), 1, "GOING-CONCERN"), (again, 4, "REVERSE-SPLIT-SECONDARY-DEFICIENCY"), (yes(disclosed), 4, "DELISTING-DETERMINATION"),
    ]
    rank = F.greatest(*[F.when(test, F.lit(r)).otherwise(F.lit(0)) for test, r, _ in rules])
    return {"tier": F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1), "hard_exclude": rank == 4, "extreme": tiny, "flags": listed(*[(test, name) for test, _, name in rules])}


def settlement_stress(fails: DataFrame) -> DataFrame:
    """Fails to deliver by symbol: dates with fails, total, latest quantity, whether persistent. Context, never scored.

    ``fails``: symbol, settlement_date, quantity, line_no; of one date the first line counts as the latest.
    """
    day = F.nullif(F.col("settlement_date"), F.lit(""))
    latest = F.max(F.struct(F.coalesce("settlement_date", F.lit("")).alias("d"), (-F.col("line_no")).alias("l"), F.col("quantity").alias("q")))
    out = fails.groupBy("symbol").agg(F.count_distinct(day).alias("n_dates"), F.sum("quantity").alias("total_fails"), latest.alias("m"))
    return out.select("symbol", "n_dates", "total_fails", F.col("m.q").alias("latest_fails"), (F.col("n_dates") >= 2).alias("persistent"))


def stress_note(n_dates: Column, total: Column) -> Column:
    return F.concat(F.lit("fails to deliver on "), n_dates.cast("string"), F.lit(" settlement dates, "), F.format_number(total, 0), F.lit(" shares in all; not scored"))


def float_tier(shares: Column) -> Column:
    return F.when(shares < 10_000_000, "material").when(shares < 20_000_000, "notorious").when(shares < 50_000_000, "caution")


def size_bucket(cap: Column) -> Column:
    return F.when(cap.isNull(), "unknown").when(cap < 50e6, "nano").when(cap < 300e6, "micro").when(cap < 2e9, "small").when(cap < 10e9, "mid").otherwise("large")


def susceptibility(float_shares: Column, promo_filings: Column, cadence: Column, toxic: Column, serial: Column, registrations: Column, revenue: Column, catalyst: Column) -> dict[str, Column]:
    """Preconditions of manipulation, not acts: score, severity, flags."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    tier = float_tier(float_shares)
    base = yes(registrations) & F.coalesce(revenue < 100_000, F.lit(True)) & ~yes(catalyst)
    rules = [(yes(promo_filings >= 3) | yes(cadence), 20, "PROMOTIONAL-FILING-PATTERN"), (yes(toxic), 20, "TOXIC-FINANCING"), (yes(serial), 15, "SERIAL-SPLITTER"), (base, 15, "NO-FUNDAMENTAL-BASIS")]
    score = F.when(tier == "material", 25).when(tier == "notorious", 18).when(tier == "caution", 10).otherwise(0)
    for test, points, _ in rules:
        score = score + F.when(test, F.lit(points)).otherwise(F.lit(0))
    score = F.least(F.lit(100), score)
    return {"score": score, "severity": severity(score), "tier": tier, "flags": listed((tier.isNotNull(), "LOW-FLOAT"), *[(test, name) for test, _, name in rules])}
