"""Material events from filing indexes.

``filings`` has cik, pos (0 is the newest), form, filing_date, accession and items, a comma-joined list of
8-K item codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ITEMS, UNCATEGORIZED
from ..functions.expr import age_days, iso_date, recent

WINDOW_DAYS = 180
PROMO_LEAST = 3


def codes(items: Column) -> Column:
    """Item codes of a list: the number in each entry, or the entry as it is; empty ones are dropped."""
    code = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"\d+\.\d+", 0), F.lit("")), F.trim(x))
    return F.filter(F.transform(F.split(F.coalesce(items, F.lit("")), ","), code), lambda c: c != "")


def _look_up(code: Column, part: int) -> Column:
    table = F.create_map(*[x for k, v in ITEMS.items() for x in (F.lit(k), F.lit(v[part]))])
    return F.coalesce(F.try_element_at(table, code), F.lit(UNCATEGORIZED) if part == 0 else F.lit(0.0))


def build(filings: DataFrame) -> DataFrame:
    """8-K filings with codes, categories, severity (the largest) and category (of the first code that has it)."""
    kept = filings.where(F.col("form").startswith("8-K")).withColumn("codes", codes(F.col("items")))
    kept = kept.withColumn("severities", F.transform("codes", lambda c: _look_up(c, 1))).withColumn("cats", F.transform("codes", lambda c: _look_up(c, 0)))
    worst = F.array_max("severities")
    first = F.get("cats", (F.array_position("severities", worst) - 1).cast("int"))
    return kept.select(
        "cik", "pos", "form", "filing_date", "accession", "codes",
        F.coalesce(first, F.lit(UNCATEGORIZED)).alias("category"),
        F.coalesce(worst, F.lit(0.0)).alias("severity"),
        F.upper(F.trim("form")).endswith("/A").alias("is_amendment"),
        F.array_sort(F.array_distinct("cats")).alias("categories"),
    )


def item_counts(events: DataFrame) -> DataFrame:
    """Filings by item code over all history: cik, code, n."""
    return events.select("cik", F.explode("codes").alias("code")).groupBy("cik", "code").agg(F.count(F.lit(1)).alias("n"))


def category_totals(events: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """By primary category: events and the severity weighted by recency; unreadable dates weigh 1, later dates more."""
    age = age_days(as_of, F.col("filing_date"))
    weight = F.when(age.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - age / F.lit(float(days))))
    return events.groupBy("cik", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("severity") * weight).alias("weighted"))


def signals(events: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Counts of the item codes that matter, in the window; one aggregation, without exploding codes."""
    inside = recent(as_of, F.col("filing_date"), days)
    count = lambda *names: F.sum(F.when(inside, F.size(F.filter("codes", lambda c: c.isin(*names)))).otherwise(0))
    ever = lambda name: F.sum(F.size(F.filter("codes", lambda c: c == name)))
    out = events.groupBy("cik").agg(
        count("3.02").alias("unregistered"), count("3.01").alias("delisting"), count("1.03").alias("bankruptcy"), count("4.01", "4.02").alias("auditor"),
        count("5.03", "5.06", "5.07").alias("charter"), count("5.02").alias("officer"), count("2.03", "2.04").alias("obligation"),
        count("7.01", "8.01").alias("promo"), count("2.02").alias("earnings"), count("1.01", "1.02").alias("agreement"),
        ever("4.01").alias("ever_401"), ever("4.02").alias("ever_402"), ever("5.03").alias("ever_503"), ever("5.06").alias("ever_506"),
    )
    return out.withColumn("has_delisting_notice", F.col("delisting") > 0).withColumn("promotional_cadence", (F.col("promo") >= PROMO_LEAST) & (F.col("earnings") == 0))


def comment_letters(filings: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Staff letters and replies of the last year: cik, letters, replies, latest; none without a letter."""
    day = iso_date(F.substring("filing_date", 1, 10))
    kept = filings.where(F.col("form").isin("UPLOAD", "CORRESP") & (day >= F.date_sub(as_of, days)))
    out = kept.groupBy("cik").agg(F.count_if(F.col("form") == "UPLOAD").alias("letters"), F.count_if(F.col("form") == "CORRESP").alias("replies"), F.max(F.when(F.col("form") == "UPLOAD", F.substring("filing_date", 1, 10))).alias("latest"))
    return out.where("letters > 0")


def letter_note(letters: Column, replies: Column, latest: Column, days: int = 365) -> Column:
    what = F.when(letters == 1, "letter").otherwise("letters")
    answer = F.when(replies == 0, "no separate response").otherwise(F.concat(replies.cast("string"), F.lit(" response(s)")))
    return F.concat(F.lit("staff letters: "), letters.cast("string"), F.lit(" "), what, F.lit(", "), answer, F.lit(f" in {days} days; latest "), latest)
