"""Queries by name: the operators over the derived relations. Outputs are flat: lists are joined, doubles rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import dilution, events, evidence, facts, insider, market, scoring, search, watch
from ..operators.shared import new_folder, scope, settled, share
from ..sources import archive, headed, readers, sinks, store
from ..streaming import tape
from . import derived, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: Column | str) -> Column:
    return F.array_join(c, ";")


def day(text: str = derived.AS_OF_EVENTS) -> Column:
    return F.lit(text).cast("date")




def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.paired(derived.fund(spark, sf))


def _model(name: str, build: Callable[[Column, Column, Column], list[Column]], sic: bool = False) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = _pairs(spark, sf)
        if sic:
            p = p.join(derived.company(spark, sf).select("cik", "sic", "price"), "cik")
        return p.select("cik", "fy", *build(F.col("t"), F.col("t1"), F.col("t2")))

    run.__name__ = name
    query(run)


def _named(parts: dict[str, Column], *numbers: str) -> list[Column]:
    return [r6(parts[n]).alias(n) for n in numbers]


_model("altman", lambda T, T1, T2: [*_named(models.altman(T), "value", "x1", "x2", "x3", "x4"), models.altman(T)["gated"].alias("gated"), joined(models.altman(T)["missing"]).alias("missing"), models.zone(models.altman(T)["value"]).alias("zone")])
_model("altman_bre", lambda T, T1, T2: [(b := models.rating(models.altman(T)["value"])) and r6(b["ems"]).alias("ems"), b["grade"].alias("grade"), b["risk"].alias("risk"), models.health(models.altman(T)["value"]).alias("health")])
_model("beneish", lambda T, T1, T2: [*_named(models.beneish(T, T1), "value", "dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi", "tata"), models.beneish(T, T1)["flagged"].alias("flagged"), joined(models.beneish(T, T1)["missing"]).alias("missing")])
_model("dechow", lambda T, T1, T2: [r6((d := models.dechow(T, T1, T2, F.col("cik") % 2 == 0))["value"]).alias("value"), r6(d["logit"]).alias("logit"), d["level"].alias("level")])
_model("montier", lambda T, T1, T2: [models.montier(T, T1).cast("double").alias("value")])
_model("piotroski", lambda T, T1, T2: [(d := models.piotroski(T, T1)) and d["value"].cast("double").alias("value"), joined(d["flags"]).alias("flags"), models.strength_score(d["value"].cast("double")).alias("sub_score")])
_model("accruals", lambda T, T1, T2: [*_named(models.accruals(T, T1), "value", "sloan_cash_flow", "sloan_balance"), models.accruals(T, T1)["high"].alias("high")])
_model("cash_runway", lambda T, T1, T2: [(d := models.runway(T, T1, F.col("cik") % 9 == 0)) and r6(F.when(d["value"] < 1e300, d["value"])).alias("value"), joined(d["flags"]).alias("flags")])
_model("ev_valuation", lambda T, T1, T2: [*_named(models.ev_valuation(T, T["market_cap"], F.col("sic")), "value", "ev", "ev_ebitda", "fcf_yield"), joined(models.ev_valuation(T, T["market_cap"], F.col("sic"))["flags"]).alias("flags"), models.value_score(models.ev_valuation(T, T["market_cap"], F.col("sic"))["value"]).alias("sub_score")], sic=True)
_model("up_market", lambda T, T1, T2: [*_named(models.up_market(T), "goodwill_share", "net_debt_ebitda", "adjusted_ebitda", "net_debt_adjusted", "coverage", "sbc_revenue"), joined(models.up_market(T)["flags"]).alias("flags")])
_model("fundamentals_record", lambda T, T1, T2: [*_named(models.record(T, T1, F.col("price"), T["market_cap"]), "growth", "monthly_burn", "runway_months", "market_cap", "price_sales", "ev", "ev_sales", "completeness"), joined(models.record(T, T1, F.col("price"), T["market_cap"])["flags"]).alias("flags"), models.growth_score(models.growth(T, T1)).alias("sub_score")], sic=True)
_model("model_ratios", lambda T, T1, T2: [r6(models.gross_margin(T)).alias("gross_margin"), r6(models.operating_assets(T)).alias("operating_assets"), r6(models.ebitda(T)).alias("ebitda"), r6(models.debt(T)).alias("debt"), market.size_bucket(T["market_cap"]).alias("size_bucket"), market.float_tier(T["shares_outstanding"] * 2000).alias("float_tier")])


# ---- facts ------------------------------------------------------------------


@query
def fy_ends(spark: SparkSession, sf: str) -> DataFrame:
    return facts.fiscal_year_ends(derived.facts(spark, sf)).select("cik", "end", F.col("rank").cast("long").alias("rank"))


CONCEPTS = {c: facts.TAGS[c] for c in derived.FACT_CONCEPTS}
#: The line items of a period: what is read, but for the legs of what is derived, and what is derived.
ITEM_NAMES = [c for c in facts.TAGS if c not in ("shares", "balance_sheet_total", "total_equity", "minority_interest", "temporary_equity", "combined_debt", "current_debt")] + ["total_debt", "shares_outstanding"]


@query
def tag_fallback(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.facts(spark, sf)
    return facts.at_ends(f, facts.fiscal_year_ends(f), CONCEPTS).select("cik", "end", "concept", r6("val").alias("val"), "filed")


@query
def period_pivot(spark: SparkSession, sf: str) -> DataFrame:
    with scope():
        filed = share(derived.filed_facts(derived.fund(spark, sf), derived.FACT_VALUES, apart=True))
        return settled(facts.periods(filed, newest=2).select("cik", "end", "rank", *[r6(c).alias(c) for c in ITEM_NAMES], "financials_filed"))


@query
def latest_fact(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.facts(spark, sf)
    parts = [facts.latest_fact(f, c, k) for c, k in (("net_income", "annual"), ("cash", "instant"), ("revenue", "quarterly"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("cik", "field", "tag", r6("val").alias("val"), "period_end", "form", "filed", "accession")


@query
def annual_series(spark: SparkSession, sf: str) -> DataFrame:
    return facts.annual_series(derived.facts(spark, sf)).select("cik", "tag", "end", r6("val").alias("val"))


@query
def share_asof(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.facts(spark, sf)
    return facts.shares_as_of(f, facts.fiscal_year_ends(f)).select("cik", "end", r6("shares").alias("shares"))


@query
def share_series(spark: SparkSession, sf: str) -> DataFrame:
    return facts.share_series(derived.facts(spark, sf)).select("cik", "period_end", r6("shares").alias("shares"))


@query
def derived_liabilities(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf).withColumn("balance_sheet_total", F.col("total_assets")).withColumn("total_equity", F.when(F.col("cik") % 3 != 0, F.col("book_equity"))).withColumn("minority_interest", F.when(F.col("cik") % 2 == 0, F.col("cash"))).withColumn("temporary_equity", F.when(F.col("cik") % 5 == 0, F.col("inventory")))
    return f.select("cik", "fy", r6(facts.derived_liabilities()).alias("total_liabilities"))


@query
def total_debt(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    long_leg, now = F.when(F.col("cik") % 5 != 0, F.col("long_term_debt")), F.when(F.col("cik") % 3 != 0, F.col("cash"))
    return f.select("cik", "fy", r6(F.coalesce("total_debt", facts.sum_present(long_leg, now))).alias("total_debt"))


# ---- dilution ---------------------------------------------------------------


@query
def dilution_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return dilution.velocity(derived.share_points(spark, sf)).select("cik", "latest", r6("qoq").alias("qoq"), r6("yoy").alias("yoy"), "trend", "death_spiral", "low_confidence")


@query
def year_ago_asof(spark: SparkSession, sf: str) -> DataFrame:
    return dilution.year_ago(derived.share_points(spark, sf))


@query
def reverse_splits(spark: SparkSession, sf: str) -> DataFrame:
    return dilution.reverse_splits(derived.share_points(spark, sf)).select("cik", "n_splits", "serial", "since_year", r6("cumulative").alias("cumulative"))


@query
def registrations(spark: SparkSession, sf: str) -> DataFrame:
    return dilution.registrations(derived.filings(spark, sf), day())


@query
def shelf_utilization(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    u = dilution.utilization(F.when(F.col("cik") % 4 != 0, F.col("revenue")), F.col("cash"))
    return f.select("cik", "fy", *[r6(v).alias(k) for k, v in u.items()], r6(dilution.shelf_share(F.col("revenue"), F.col("market_cap"))).alias("shelf_pct"))


@query
def toxic_text(spark: SparkSession, sf: str) -> DataFrame:
    return derived.documents(spark, sf).select("doc_id", dilution.toxic_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0).select("doc_id", joined("terms").alias("terms"))


@query
def headroom(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    h = dilution.headroom(F.when(F.col("cik") % 5 != 0, F.col("shares_outstanding") * (1 + (F.col("cik") % 7) / F.lit(40.0) - 0.01)), F.col("shares_outstanding"))
    return f.select("cik", "fy", r6(h["pct"]).alias("pct"), h["near_ceiling"].alias("near_ceiling"))


@query
def overhang(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    o = dilution.overhang(F.col("shares_outstanding"), [F.col("cash"), F.when(F.col("cik") % 2 == 0, F.col("inventory")), F.col("goodwill")], F.when(F.col("cik") % 3 == 0, F.col("revenue")))
    return f.select("cik", "fy", r6(o["fully_diluted"]).alias("fully_diluted"), r6(o["pct"]).alias("pct"), o["partial"].alias("partial"))


@query
def shell_composite(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    n = dilution.shell_signs(F.col("cik") % 4 == 0, F.col("cik") % 3, F.when(F.col("cik") % 5 != 0, F.col("cik") % 10), F.col("revenue"), F.col("shares_outstanding") * 10000)
    return f.select("cik", "fy", n.cast("long").alias("signs"), (n >= 2).alias("shell"))


def _tape(spark: SparkSession, sf: str) -> DataFrame:
    return events.signals(events.build(derived.filings(spark, sf)), day())


@query
def auditor_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _tape(spark, sf).select("cik", (F.col("ever_401") > 0).alias("changed"), (F.col("ever_402") > 0).alias("restated"), (F.col("ever_401") >= 2).alias("churn"))


@query
def dilution_score(spark: SparkSession, sf: str) -> DataFrame:
    d = scan.dilution_profile(derived.share_points(spark, sf), derived.filings(spark, sf), _tape(spark, sf), scan.wording(derived.filed_texts(spark, sf), derived.AS_OF_EVENTS), derived.AS_OF_EVENTS)
    return d.select("cik", "dilution_score", "dilution_severity", joined("dilution_flags").alias("dilution_flags"), "serial_splitter")


# ---- events -----------------------------------------------------------------


@query
def event_build(spark: SparkSession, sf: str) -> DataFrame:
    return events.build(derived.filings(spark, sf)).select("cik", "accession", joined("codes").alias("codes"), "category", "severity", joined("categories").alias("categories"), "is_amendment")


@query
def event_tape_counts(spark: SparkSession, sf: str) -> DataFrame:
    return events.item_counts(events.build(derived.filings(spark, sf)))


@query
def recency_severity(spark: SparkSession, sf: str) -> DataFrame:
    return events.category_totals(events.build(derived.filings(spark, sf)), day()).select("cik", "category", "n", r6("weighted").alias("weighted"))


@query
def event_signals(spark: SparkSession, sf: str) -> DataFrame:
    return events.signals(events.build(derived.filings(spark, sf)), day("2024-01-20"), 10)


@query
def comment_letters(spark: SparkSession, sf: str) -> DataFrame:
    c = events.comment_letters(derived.filings(spark, sf), day())
    return c.withColumn("note", events.letter_note(F.col("letters"), F.col("replies"), F.col("latest")))


# ---- insiders ---------------------------------------------------------------


@query
def insider_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = insider.profile(derived.transactions(spark, sf))
    return p.withColumn("sub_score", insider.sub_score(F.col("net"), F.col("cluster"), F.col("confidence"))).drop("n_free")


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    return readers.ownership_filings(derived.filings(spark, sf)).withColumn("filer", F.col("filer").cast("long") % 5).withColumn("pct", (F.col("pos") % 12).cast("double"))


@query
def ownership_conversions(spark: SparkSession, sf: str) -> DataFrame:
    return insider.ownership(_owners(spark, sf))


@query
def form4_topk(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.filings(spark, sf).withColumn("form", F.when(F.col("form") == "8-K", "4").otherwise(F.col("form")))
    return insider.recent_forms(f, day()).select("cik", "accession", F.col("nth").cast("long").alias("nth"), "cap_hit")


@query
def form144_notices(spark: SparkSession, sf: str) -> DataFrame:
    return readers.form144(derived.filings(spark, sf)).groupBy("cik").agg(F.count(F.lit(1)).alias("n_144"), F.max("date").alias("latest"))


@query
def accumulation(spark: SparkSession, sf: str) -> DataFrame:
    t = derived.transactions(spark, sf).withColumn("change_shares", F.when(F.col("code") == "S", -F.col("value")).when(F.col("code") == "P", F.col("value")))
    return insider.accumulation(t)


# ---- market -----------------------------------------------------------------


@query
def suspension_match(spark: SparkSession, sf: str) -> DataFrame:
    return market.suspensions_of(derived.company(spark, sf).select("cik", "name"), derived.suspension_rows(spark, sf), day(derived.AS_OF))


@query
def suspension_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("date")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.date_format(d, "MMMM d, yyyy")), cell(F.col("company")), cell(F.concat(F.lit("Release No. 34-"), F.date_format(d, "yyyyMMdd"))), F.lit("</tr>\n"))
    return readers.suspensions(derived.suspension_rows(spark, sf).select(row.alias("value")))


@query
def delisting_tier(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.company(spark, sf)
    m = F.col("cik")
    d = market.delisting(m % 4 == 0, F.when(m % 9 != 0, F.col("price")), m % 5 == 0, m % 6 == 0, m % 7 == 0, m % 31 == 0)
    return c.select("cik", d["tier"].alias("tier"), d["hard_exclude"].alias("hard_exclude"), d["extreme"].alias("extreme"), joined(d["flags"]).alias("flags"))


@query
def ftd_stress(spark: SparkSession, sf: str) -> DataFrame:
    return market.settlement_stress(derived.fails(spark, sf))


@query
def ftd_parse(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fails(spark, sf)
    body = f.select("symbol", F.col("line_no"), F.concat_ws("|", "settlement_date", F.lit("CUSIP"), F.lower("symbol"), F.format_number("quantity", 0), F.lit("A COMPANY"), F.concat(F.lit("$"), F.format_number("price", 2))).alias("value"))
    head = f.select("symbol").distinct().select("symbol", F.lit(0).cast("long").alias("line_no"), F.lit("SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE").alias("value"))
    return readers.fails(body.unionByName(head).withColumnRenamed("symbol", "file")).select("symbol", "line_no", "settlement_date", "quantity", "price")


@query
def manipulation_score(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    m = F.col("cik")
    s = market.susceptibility(F.when(m % 5 != 0, F.col("shares_outstanding") * 2000), m % 6, m % 7 == 0, m % 3 == 0, m % 4 == 0, m % 2 == 0, F.when(m % 8 != 0, F.col("revenue") / 100), m % 11 == 0)
    return f.select("cik", "fy", s["score"].cast("long").alias("score"), s["severity"].alias("severity"), s["tier"].alias("tier"), joined(s["flags"]).alias("flags"))


@query
def fts_probe(spark: SparkSession, sf: str) -> DataFrame:
    return readers.phrase_hits(derived.table(spark, sf, "documents"), ["license", "copyright"]).select("doc_id", joined("hits").alias("hits"))


# ---- scores -----------------------------------------------------------------


def _scored(spark: SparkSession, sf: str, profile: str = "hold", preset: str = "penny") -> DataFrame:
    return scoring.compose(scan.signals(spark, sf), profile, preset)


@query
def flagship_scan(spark: SparkSession, sf: str) -> DataFrame:
    ranked, _ = scan.run(scan.signals(spark, sf))
    return ranked.select("ticker", "sic_sector", "gated", "rank", F.col("sector_rank").cast("double").alias("sector_rank"), F.col("sector_size").cast("double").alias("sector_size"), r6("composite").alias("composite"), joined("penalty_flags").alias("penalty_flags"), joined("suppressed").alias("suppressed"))


@query
def subscores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("ticker", *[f"pos_{k}" for k in scoring.POSITIVES])


@query
def penalty_severities(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("ticker", *[r6(f"pen_{m}").alias(f"pen_{m}") for m in scoring.MODULES])


def _all_composites(spark: SparkSession, sf: str, pairs: list[tuple[str, str]]) -> DataFrame:
    s, out = scan.signals(spark, sf), None
    for profile, preset in pairs:
        part = scoring.compose(s, profile, preset).select("ticker", F.lit(profile).alias("profile"), F.lit(preset).alias("preset"), r6("composite").alias("composite"), joined("na_modules").alias("na_modules"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def composite_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _all_composites(spark, sf, [(p, "penny") for p in scoring.PROFILES])


@query
def composite_presets(spark: SparkSession, sf: str) -> DataFrame:
    return _all_composites(spark, sf, [("hold", p) for p in scoring.PRESETS])


@query
def gates(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("ticker", "gated", joined("gate_reasons").alias("gate_reasons"))


@query
def suppressed_modules(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("ticker", joined("suppressed").alias("suppressed"), F.size("suppressed").cast("long").alias("n"))


@query
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    s = scan.signals(spark, sf).withColumn("gone", F.col("cik") % 6 == 0)
    names = ["altman_z", "revenue_growth", "dilution_severity", "delisting_tier", "suspended", "insider_net"]
    s = s.withColumns({n: F.when(~F.col("gone"), F.col(n)) for n in names})
    return s.select("ticker", scoring.assessed(names).alias("assessed"))


@query
def scan_filters(spark: SparkSession, sf: str) -> DataFrame:
    _, excluded = scan.run(scan.signals(spark, sf), scan.Request(no_serial_splitter=True, need_insider_buying=True))
    return excluded


@query
def exclude_flagged(spark: SparkSession, sf: str) -> DataFrame:
    _, excluded = scan.run(scan.signals(spark, sf), scan.Request(exclude_flagged=True))
    return excluded


@query
def rank_global(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rank(_scored(spark, sf, "trader")).select("ticker", "gated", "rank")


@query
def rank_sector(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rank(_scored(spark, sf, "high-return")).select("ticker", "sic_sector", F.col("sector_rank").cast("double").alias("sector_rank"), F.col("sector_size").cast("double").alias("sector_size"))


def _top(name: str, by: str, n: int | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return scoring.top(_scored(spark, sf), n, by).select("ticker", r6(scoring.sort_key(by)).alias("key"))

    run.__name__ = name
    query(run)


for _name, _by in (("sort_growth", "growth"), ("sort_valuation", "valuation"), ("sort_sentiment", "sentiment"), ("sort_risk", "risk"), ("top_n", "score")):
    _top(_name, _by, 20 if _name == "top_n" else None)


@query
def full_union(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.where("NOT gated").select("ticker", F.lit("ranked").alias("section")).unionByName(s.where("gated").select("ticker", F.lit("high-risk").alias("section")))


@query
def sector_size_pct(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf).join(derived.company(spark, sf).select("cik", "sic_sector"), "cik").withColumn("bucket", market.size_bucket(F.col("market_cap")))
    ranked = scoring.percentile(f.withColumn("growth_class", F.floor(F.col("ebit") / 10000)), "growth_class", ["sic_sector", "bucket"])
    return ranked.select("cik", "fy", "bucket", r6("pct").alias("pct"), r6(models.clamp(F.col("pct"))).alias("sub_score"))


@query
def export_records(spark: SparkSession, sf: str) -> DataFrame:
    rec = sinks.records(scoring.rank(_scored(spark, sf, "hold", "broad")))
    total = lambda m: F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, b: a + b), 3)
    return rec.select("ticker", "composite", "gated", F.col("sector_rank").cast("double").alias("sector_rank"), joined("penalty_flags").alias("penalty_flags"), joined("na_modules").alias("na_modules"), F.col("suppressed_count").cast("long").alias("suppressed_count"), "evidence_complete", F.size("penalty_contributions").cast("long").alias("n_penalties"), total("positive_contributions").alias("positive"))


@query
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    """All snapshots through CSV files in the shared folder and back; scores keep their digits, flags are JSON."""
    rows, folder = derived.snapshots(spark, sf), new_folder(spark, "csv")
    sinks.write_csv(rows, folder)
    back = headed.read_headed(spark, folder, "ticker string, scanned_at string, score double, flags string")
    return back.select("ticker", "scanned_at", r6("score").alias("score"), joined(F.from_json("flags", "array<string>")).alias("flags"))


@query
def scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the scan tells of itself, counted while its names are written: a row for each count and kind."""
    folder = new_folder(spark, "scan")
    sinks.write_scan(*scan.run(scan.signals(spark, sf), scan.Request(no_serial_splitter=True)), folder)
    kinds = ("universe_counts", "excluded_by_reason", "suppressed_by_module")
    meta = spark.read.schema("value string").text(f"{folder}/meta").select(F.from_json("value", ", ".join(f"{k} map<string, bigint>" for k in kinds)).alias("m"))
    each = [meta.select(F.lit(k).alias("kind"), F.explode(f"m.{k}").alias("name", "n")) for k in kinds]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query
def flag_glyph(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("ticker", scoring.glyph().alias("glyph"))


# ---- watchlist --------------------------------------------------------------


@query
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return watch.diff(derived.snapshots(spark, sf)).select("ticker", "scanned_at", r6("score").alias("score"), r6("delta").alias("delta"), joined("new_flags").alias("new_flags"), joined("cleared_flags").alias("cleared_flags"))


@query
def watch_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return watch.diff(derived.snapshots(spark, sf)).where(F.size("alerts") > 0).select("ticker", "scanned_at", F.size(F.filter("alerts", lambda a: a.startswith("new flag"))).cast("long").alias("n_new"), F.exists("alerts", lambda a: a.startswith("score")).alias("fell"))


@query
def latest_two(spark: SparkSession, sf: str) -> DataFrame:
    return watch.latest(derived.snapshots(spark, sf)).select("ticker", "scanned_at", F.col("nth").cast("long").alias("nth"), joined("flags").alias("flags"))


@query
def snapshot_store(spark: SparkSession, sf: str) -> DataFrame:
    """The store after a first run with other scores for some names and a second run that was written twice."""
    path, new = new_folder(spark, "snapshots"), derived.snapshots(spark, sf)
    store.add_run(new.where("length(ticker) % 2 = 0").withColumn("score", F.col("score") + 1), path, "2024-01-01T00:00")
    for _ in range(2):
        store.add_run(new, path, "2024-01-02T00:00")
    return store.read_store(spark, path).select("ticker", "scanned_at", r6("score").alias("score"), joined("flags").alias("flags"))


@query
def snapshot_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The diffs of all snapshots through a stream with state, which meets them in no order."""
    return tape.replayed(derived.snapshots(spark, sf)).select("ticker", "scanned_at", r6("score").alias("score"), r6("delta").alias("delta"), joined("new_flags").alias("new_flags"), joined("cleared_flags").alias("cleared_flags"))


@query
def watch_semi(spark: SparkSession, sf: str) -> DataFrame:
    names = derived.company(spark, sf).where("cik % 3 = 0").select("ticker")
    return watch.watched(_scored(spark, sf), names).select("ticker", r6("composite").alias("composite"))


@query
def snapshot_flags(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    features = F.concat(F.coalesce("dilution_flags", F.array().cast("array<string>")), F.coalesce("delisting_flags", F.array().cast("array<string>")))
    return s.select("ticker", joined(watch.snapshot_flags(F.col("penalty_flags"), F.col("gate_reasons"), features)).alias("flags"))


# ---- payloads ---------------------------------------------------------------


@query
def universe_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.company(spark, sf)
    row = F.concat(F.lit("["), F.col("cik").cast("string"), F.lit(',"'), F.col("name"), F.lit('","'), F.lower("ticker"), F.lit('","OTC"]'))
    payload = c.select(F.concat(F.lit('{"fields":["cik","name","ticker","exchange"],"data":['), row, F.lit("]}")).alias("value"))
    return readers.universe(payload)


@query
def companyfacts_json(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf).groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("end", F.col("revenue").alias("val")))).alias("rows"))
    body = F.concat(F.lit('{"cik":"'), F.col("cik").cast("string"), F.lit('","entityName":"E","facts":{"us-gaap":{"Revenues":{"units":{"USD/shares":[],"USD":'), F.to_json("rows"), F.lit("}}}}}"))
    return readers.one_unit(readers.company_facts(f.select(body.alias("value")))).select("cik", "tag", "unit", "end", r6("val").alias("val"))


@query
def companyfacts_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Facts through bulk archives in the shared folder; every fourth member breaks off, which is reported and stops no other."""
    f = derived.fund(spark, sf).groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("end", F.col("revenue").alias("val")))).alias("rows"))
    number = F.lpad(F.col("cik").cast("string"), 10, "0")
    body = F.concat(F.lit('{"cik":"'), F.col("cik").cast("string"), F.lit('","facts":{"us-gaap":{"Revenues":{"units":{"USD":'), F.to_json("rows"), F.when(F.col("cik") % 4 == 0, F.lit("}")).otherwise(F.lit("}}}}}")))
    folder = new_folder(spark, "archives")
    archive.write_archives(f.select(F.concat(F.lit("CIK"), number, F.lit(".json")).alias("member"), body.alias("value")), folder)
    found, failed = archive.bulk_facts(archive.read_archives(spark, folder))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("tag", "string"), ("unit", "string"), ("end", "string"), ("val", "double"))]
    good = readers.one_unit(found).select("cik", "tag", "unit", "end", r6("val").alias("val"), F.lit(None).cast("string").alias("failure"))
    return good.unionByName(failed.select(F.substring("member", 4, 10).alias("cik"), *nothing, "failure"))


@query
def submissions_json(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.filings(spark, sf).groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("pos", "form", "filing_date", "accession", "items"))).alias("r"))
    arr = lambda n: F.to_json(F.transform("r", lambda x: x[n]))
    short = F.to_json(F.slice(F.transform("r", lambda x: x["items"]), F.lit(1), F.lit(3)))
    body = F.concat(F.lit('{"cik":"'), F.col("cik").cast("string"), F.lit('","sic":" 3674 ","sicDescription":"","filings":{"recent":{"form":'), arr("form"), F.lit(',"filingDate":'), arr("filing_date"), F.lit(',"accessionNumber":'), arr("accession"), F.lit(',"items":'), short, F.lit("}}}"))
    return readers.filings(f.select(body.alias("value"))).select("cik", F.col("pos").cast("long").alias("pos"), "form", "filing_date", "accession", "items", F.col("sic").cast("long").alias("sic"), "sic_sector")


@query
def form4_xml(spark: SparkSession, sf: str) -> DataFrame:
    t = derived.transactions(spark, sf)
    tag = lambda name, c: F.concat(F.lit(f"<{name}><value>"), c.cast("string"), F.lit(f"</value></{name}>"))
    row = F.concat(F.lit("<nonDerivativeTransaction>"), tag("transactionDate", F.lit("2001-01-01")), F.lit("<transactionCoding><transactionCode>"), F.col("code"), F.lit("</transactionCode></transactionCoding><transactionAmounts>"), tag("transactionShares", F.lit("10")), tag("transactionPricePerShare", F.col("value")), F.lit("</transactionAmounts></nonDerivativeTransaction>"))
    note = F.when(F.col("is_10b5_1"), '<footnotes><footnote id="F1">under a 10b5-1 plan</footnote></footnotes>').otherwise("")
    doc = F.concat(F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>P"), F.col("insider").cast("string"), F.lit("</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>"), row, row, F.lit("</nonDerivativeTable>"), note, F.lit("</ownershipDocument>"))
    parsed = readers.ownership_xml(t.select("cik", F.lit("a").alias("accession"), doc.alias("value")))
    return parsed.groupBy("cik", "insider", "code", "is_10b5_1").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


# ---- evidence ---------------------------------------------------------------

#: A phrase, any of several in forms and days, one in a company, one of words that occur without it, and one word alone.
SEARCHES = [
    search.Search("toxic", ("beneficial ownership limitation", "death spiral")),
    search.Search("listing", ("regain compliance", "minimum bid price", "listing-qualifications"), ("8-K", "S-1"), None, "2023-08-01", "2024-01-31"),
    search.Search("of-one", ("the", "warrant coverage"), (), 7),
    search.Search("never", ("bid minimum", "spiral death", "")),
    search.Search("word", ("license",), ("10-K",)),
]


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Names as typed: twice, with spaces and in lower case, and empty ones."""
    typed = F.explode(F.array(F.struct(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), (3 * F.col("cik") + 2).alias("pos")), F.struct(F.col("ticker"), (5 * F.col("cik")).alias("pos")), F.struct(F.lit("  ").alias("ticker"), F.col("cik").alias("pos"))))
    return derived.company(spark, sf).select(typed.alias("t")).select("t.*")


@query
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.candidates(_asked(spark, sf))


@query
def ticker_cik(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.company(spark, sf)
    asked = c.select("ticker", F.when(F.col("cik") % 5 == 0, F.concat(F.lit("9"), F.col("cik").cast("string"))).when(F.col("cik") % 5 == 1, F.lit(" ")).alias("cik"))
    return evidence.resolve(asked, c.where("cik % 7 <> 0").select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))).select("ticker", "cik")


@query
def core_inputs_note(spark: SparkSession, sf: str) -> DataFrame:
    p = derived.paired(derived.fund(spark, sf))
    return p.select("cik", "fy", joined(evidence.missing_inputs(F.col("t"))).alias("missing"))


@query
def completeness_notes(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf)
    newest = f.groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*f.columns[2:]), "fy").alias("t"))
    c = derived.company(spark, sf).join(newest, "cik", "left")
    m = F.col("cik")
    n = F.when(m % 9 == 0, 0).when(m % 9 == 1, 1).otherwise(F.col("n"))
    price = F.when(F.col("price") == 0, F.array(F.lit("price unavailable")))
    notes = evidence.completeness(F.when(m % 7 == 0, F.lit("no CIK")), evidence.fundamentals_notes(n, F.col("t.end"), evidence.missing_inputs(F.col("t"))), price)
    return c.select("ticker", joined(notes).alias("notes"))


@query
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    f = derived.fund(spark, sf).groupBy("cik").agg(F.max("end").alias("end"))
    m = F.col("cik")
    seen = f.select((-m).alias("pos"), F.when(m % 3 != 0, F.col("end")).otherwise("").alias("financials_period"), F.when(m % 4 != 0, F.concat(F.col("end"), F.lit("+60"))).alias("financials_filed"), (m % 8 == 0).alias("institutional"))
    return evidence.freshness(seen, F.lit(derived.AS_OF_EVENTS).cast("timestamp"))


@query
def stock_probes(spark: SparkSession, sf: str) -> DataFrame:
    return readers.stock_probes(derived.filed_texts(spark, sf), F.lit("2023-08-01"), F.lit(derived.AS_OF_EVENTS))


@query
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    """Filings that answer searches, by an index of positions that is written once."""
    filed = derived.filed_texts(spark, sf)
    path = new_folder(spark, "index")
    search.write_index(filed.select("doc_id", "text"), path)
    return search.search(search.open_index(spark, path), filed.select("doc_id", "cik", "form", "filing_date"), SEARCHES)


@query
def provider_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.company(spark, sf)
    first = c.where("cik % 2 = 0").select("ticker", "price")
    second = c.where("cik % 3 <> 0").select("ticker", (F.col("price") + 1).alias("price"))
    return readers.cascade(c.select("ticker"), "ticker", {"first": first, "second": second})


@query
def failure_isolation(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.company(spark, sf)
    body = F.concat(F.lit('{"cik":'), F.col("cik").cast("string"), F.when(F.col("cik") % 4 == 0, F.lit(',"na')).otherwise(F.lit("}")))
    return readers.isolated(c.select("ticker", body.alias("value")), "cik long").select("ticker", "parsed.cik", "failure")


@query
def watch_order(spark: SparkSession, sf: str) -> DataFrame:
    added = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("cik") % 30).cast("int")), "yyyy-MM-dd")
    return watch.listing(derived.company(spark, sf).select("ticker", added.alias("added_at")))


@query
def export_full(spark: SparkSession, sf: str) -> DataFrame:
    rec = sinks.records(scoring.rank(_scored(spark, sf)))
    return rec.select("ticker", "composite", "sic_sector", F.col("sector_size").cast("double").alias("sector_size"), "gated", joined("gate_reasons").alias("gate_reasons"), joined("suppressed").alias("suppressed"), joined("completeness").alias("completeness"), F.size("notes").cast("long").alias("n_notes"), F.round(F.coalesce(F.try_element_at("penalty_contributions", F.lit("dilution")), F.lit(0.0)), 4).alias("dilution_penalty"))
