"""What a score rests on: candidate names, their company numbers, completeness notes and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CORE_INPUTS
from ..functions.expr import absent


def candidates(tickers: DataFrame) -> DataFrame:
    """Asked names ``(ticker, pos)`` in upper case without spaces around, each once with its first place; empty ones go."""
    return tickers.select(F.upper(F.trim("ticker")).alias("ticker"), "pos").where("ticker <> ''").groupBy("ticker").agg(F.min("pos").alias("pos"))


def resolve(asked: DataFrame, universe: DataFrame) -> DataFrame:
    """``asked`` with a company number: its own ``cik`` where it has one, else that of its ticker in ``universe``; null if neither knows it."""
    known = universe.select("ticker", F.col("cik").alias("listed"))
    return asked.join(known, "ticker", "left").withColumn("cik", F.coalesce(F.nullif(F.trim("cik"), F.lit("")), "listed")).drop("listed")


def missing_inputs(period: Column) -> Column:
    """Names of the core inputs that a period lacks, in their order."""
    return absent([(c, period[c]) for c in CORE_INPUTS])


def fundamentals_notes(n_ends: Column, end: Column, missing: Column) -> Column:
    """Notes on the fiscal years of a name: none, one only, and one line for all core inputs its newest year lacks."""
    lacking = F.concat(F.lit("core inputs unavailable for "), end, F.lit(": "), F.array_join(missing, ", "), F.lit(" (dependent metrics suppressed)"))
    n = F.coalesce(n_ends, F.lit(0))
    return F.array_compact(F.array(
        F.when(n == 0, F.lit("fundamentals suppressed (no annual 10-K period in companyfacts)")),
        F.when(n == 1, F.lit("fundamentals limited to one annual period (prior year unavailable)")),
        F.when((n > 0) & (F.size(missing) > 0), lacking),
    ))


def completeness(reason: Column, *notes: Column) -> Column:
    """All notes of a name one after the other; a name whose source is down, with a ``reason``, has that note alone."""
    none = F.array().cast("array<string>")
    return F.when(reason.isNotNull(), F.array(F.concat(F.lit("degraded: "), reason))).otherwise(F.concat(*[F.coalesce(n, none) for n in notes]))


def freshness(evidence: DataFrame, as_of: Column, cached: bool = False) -> DataFrame:
    """``(domain, line)``: how old each kind of evidence is.

    ``evidence``: pos, financials_period, financials_filed, institutional. Period and filing date are each the
    first that is not empty in the order of the names. Financials and holdings have no line if no name has any.
    """
    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("pos", c)))[c]
    held = evidence.agg(first("financials_period").alias("period"), F.coalesce(first("financials_filed"), F.lit("n/a")).alias("filed"), F.coalesce(F.bool_or("institutional"), F.lit(False)).alias("institutional"))
    mark = F.lit(" (cached)" if cached else "")
    line = lambda domain, at, label: F.struct(F.lit(domain).alias("domain"), F.concat(F.lit(f"{domain}: "), at, mark, F.lit(f" — {label}")).alias("line"))
    lines = F.array(
        line("filings/news", F.date_format(as_of, "yyyy-MM-dd HH:mm 'UTC'"), "EDGAR updates continuously"),
        F.when(F.col("period").isNotNull(), line("financials", F.concat(F.lit("latest filed "), "period", F.lit(" (filed "), "filed", F.lit(")")), "the newest 10-K/10-Q the company has reported")),
        F.when(F.col("institutional"), line("institutional (13F)", F.lit("latest filed"), "13F institutional holdings are quarterly and lagged (~45 days after quarter-end).")),
    )
    return held.select(F.explode(F.array_compact(lines)).alias("l")).select("l.*")
