"""The scan: all evidence of all companies to one ranked table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions.constants import PROBES
from ..functions.expr import recent
from ..operators import dilution, events, evidence, facts, insider, market, scoring
from ..operators.shared import scope, settled, share
from ..sources import readers
from . import derived

#: How far back texts are searched for trouble with a listing.
LANGUAGE_DAYS = 180


@dataclass(frozen=True)
class Request:
    """What a scan is asked for."""

    profile: str = "hold"
    preset: str = "penny"
    no_serial_splitter: bool = False
    need_insider_buying: bool = False
    exclude_flagged: bool = False
    sort: str = "score"
    top: int | None = None
    overrides: dict[str, float] = field(default_factory=dict)


def wording(filed: DataFrame, as_of: str) -> DataFrame:
    """How many texts of each company speak of toxic financing, and how many recent ones of trouble with a listing, in
    one pass over the texts: cik, n_toxic, n_language. ``filed``: cik, form, filing_date, text."""
    probe, low = PROBES["delisting"], F.lower("text")
    said = F.exists(F.array(*[F.lit(p.lower()) for p in probe["phrases"]]), lambda p: F.contains(low, p))
    day = F.lit(as_of).cast("date")
    late = F.col("form").isin(probe["forms"]) & F.col("filing_date").between(F.date_sub(day, LANGUAGE_DAYS).cast("string"), day.cast("string"))
    return filed.groupBy("cik").agg(F.count_if(F.size(dilution.toxic_terms(F.col("text"))) > 0).alias("n_toxic"), F.count_if(late & said).alias("n_language"))


def dilution_profile(points: DataFrame, filings: DataFrame, tape: DataFrame, words: DataFrame, as_of: str, splits: DataFrame | None = None, values: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """The dilution score of each company with any share count or filing; every side is one row a company.

    ``words`` is that of ``wording``. ``values`` (cik, market_cap) tells how large a shelf is, ``people`` (cik,
    insider_buying) eases the score; without them neither counts.
    """
    splits = dilution.reverse_splits(points) if splits is None else splits
    d = dilution.velocity(points).join(splits, "cik", "left").join(dilution.registrations(filings, F.lit(as_of).cast("date")), "cik", "full")
    d = d.join(tape.select("cik", "ever_401", "ever_402", "ever_506"), "cik", "left").join(words.select("cik", "n_toxic"), "cik", "left")
    for side, name, kind in ((values, "market_cap", "double"), (people, "insider_buying", "boolean")):
        d = d.withColumn(name, F.lit(None).cast(kind)) if side is None else d.join(side.select("cik", name), "cik", "left")
    none = F.lit(None).cast("double")
    fused = dilution.fuse({
        "shelf_pct": dilution.shelf_share(F.col("max_amount"), F.col("market_cap")), "wksi": F.col("wksi"), "active_atm": F.col("active_atm"), "toxic": F.col("n_toxic") > 0, "death_spiral": F.col("death_spiral"), "near_ceiling": F.lit(False), "overhang_pct": none,
        "n_splits": F.col("n_splits"), "late": F.col("n_late") > 0, "late_escalated": F.col("late_escalated"),
        "shell": dilution.shell_signs(F.lit(False), F.col("ever_506"), none, none, F.col("latest")) >= 2,
        "restatement": F.col("ever_402") > 0, "churn": F.col("ever_401") >= 2, "insider_buying": F.col("insider_buying"),
    })
    return d.select("cik", fused["score"].cast("long").alias("dilution_score"), fused["severity"].alias("dilution_severity"), fused["flags"].alias("dilution_flags"), F.coalesce(F.col("n_splits") >= 2, F.lit(False)).alias("serial_splitter"))


def fundamentals(periods: DataFrame, companies: DataFrame) -> DataFrame:
    """The models of each company's newest year. ``periods``: cik, end, rank and the line items, of all years."""
    order = Window.partitionBy("cik").orderBy("end")
    packed = periods.select("cik", "rank", "end", F.struct(*[c for c in periods.columns if c not in ("cik", "rank")]).alias("t"))
    p = packed.withColumn("t1", F.lag("t").over(order)).withColumn("n_ends", F.count(F.lit(1)).over(Window.partitionBy("cik"))).where("rank = 1").join(companies.select("cik", "sic"), "cik")
    t, t1 = F.col("t"), F.col("t1")
    value = models.ev_valuation(t, t["market_cap"], F.col("sic"))
    up = models.up_market(t)
    return p.select(
        "cik", F.when(value["computable"], value["value"]).alias("ev_sales"), models.growth(t, t1).alias("revenue_growth"), models.piotroski(t, t1)["value"].cast("double").alias("piotroski"),
        models.altman(t)["value"].alias("altman_z"), models.beneish(t, t1)["value"].alias("beneish_m"), models.is_financial(F.col("sic")).alias("out_of_model"), up["flags"].alias("up_flags"), up["sbc_revenue"].alias("sbc_revenue"), t["market_cap"].alias("market_cap"),
        evidence.fundamentals_notes(F.col("n_ends"), t["end"], evidence.missing_inputs(t)).alias("year_notes"),
    )


def periods_of(years: DataFrame) -> DataFrame:
    """The line items of the facts filed for ``years``, and beside them what no fact has: market value, leases, pensions.

    They are written to the shared folder, so that the models over them are planned apart from the facts. The years
    are partitioned by company before facts are made of them, which are many times more rows: those stay where they
    are made, and are not kept, as making share counts again costs less than keeping all facts.
    """
    filed = lambda values: derived.filed_facts(years, values, apart=True)
    items = settled(facts.periods(filed(derived.FACT_VALUES), shares=filed({"shares": derived.FACT_VALUES["shares"]}), by_company=True))
    return items.join(years.select("cik", "end", "market_cap", "operating_lease_expense", "pension_expense"), ["cik", "end"], "left")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """One row per company with the results of every module; null where a module had nothing to run on.

    What several modules read is made once and kept until the signals are written to the shared folder: each source
    is read once, and what is scored, ranked and exported later starts from a row for each company.
    """
    with scope():
        return settled(_signals(spark, sf))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    companies = share(derived.company(spark, sf))
    filed = share(derived.filings(spark, sf))
    tape = share(events.signals(events.build(filed), F.lit(derived.AS_OF_EVENTS).cast("date")))
    sums = share(derived.activity(spark, sf))
    notices = readers.form144(filed).groupBy("cik").agg(F.count(F.lit(1)).alias("n_144"))
    people = insider.profile(derived.summed_transactions(sums), notices, times="times").select("cik", F.col("net").alias("insider_net"), F.col("cluster").alias("insider_cluster"), F.col("confidence").alias("insider_confidence"), F.col("overhang").alias("insider_overhang"), F.col("cluster").alias("insider_buying"))
    people = share(people)
    halted = market.suspensions_of(companies.select("cik", "name"), derived.suspended(companies), F.lit(derived.AS_OF).cast("date")).select("cik", "suspended")
    points = share(derived.share_points(spark, sf))
    splits, words = share(dilution.reverse_splits(points)), share(wording(derived.filed_texts(spark, sf), derived.AS_OF_EVENTS))
    funds = share(fundamentals(periods_of(share(derived.fund(spark, sf, sums).repartition("cik"))), companies))
    buying = people.select("cik", (F.col("insider_cluster") & (F.col("insider_net") == "bullish")).alias("insider_buying"))
    d = dilution_profile(points, filed, tape, words, derived.AS_OF_EVENTS, splits, funds, buying)
    out = companies.join(funds.drop("market_cap"), "cik", "left")
    for part in (d, people, halted, tape.select("cik", "has_delisting_notice"), splits.select("cik", "last_split"), words.select("cik", "n_language")):
        out = out.join(part, "cik", "left")
    # The gate asks for a split within the year; a serial splitter of any time does not show one.
    split = F.col("last_split").isNotNull() & recent(F.lit(derived.AS_OF).cast("date"), F.col("last_split"), 365)
    no = F.lit(False)
    tier = market.delisting(F.col("has_delisting_notice"), F.col("price"), F.col("n_language") > 0, no, split, no)
    seen = F.col("has_delisting_notice").isNotNull() | F.col("price").isNotNull()
    none = F.lit(None)
    noted = evidence.fundamentals_notes(none.cast("long"), none.cast("string"), none.cast("array<string>"))
    out = out.withColumn("completeness", evidence.completeness(none.cast("string"), F.coalesce("year_notes", noted))).drop("year_notes")
    return out.withColumn("delisting_tier", F.when(seen, tier["tier"])).withColumn("delisting_flags", F.when(seen, tier["flags"])).drop("last_split", "n_language").withColumn("sentiment", F.lit(None).cast("double"))


def run(signals_: DataFrame, request: Request = Request()) -> tuple[DataFrame, DataFrame]:
    """Ranked names and excluded ones with the reason. Names without any measurement come first, then filters, then flags."""
    known = scoring.assessed(["altman_z", "revenue_growth", "dilution_severity", "delisting_tier", "suspended", "insider_net"])
    reason = F.when(~known, "not assessed").otherwise(scoring.filter_reason(request.no_serial_splitter, request.need_insider_buying))
    judged = signals_.withColumn("reason", reason)
    scored = scoring.compose(judged, request.profile, request.preset, request.overrides)
    if request.exclude_flagged:
        scored = scored.withColumn("reason", F.coalesce("reason", F.when(scoring.is_flagged(), "critical flag")))
    return scoring.rank(scored.where("reason IS NULL").drop("reason")), scored.where("reason IS NOT NULL").select("ticker", "reason")
