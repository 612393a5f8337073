"""Filing-shaped relations derived from the star-schema tables.

Money is summed in whole cents, which does not depend on order, and divided once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import DURATIONS, ITEMS, PROBES, TAGS, TOXIC_PHRASES

AS_OF_EVENTS = "2024-01-31"
AS_OF = "2001-12-31"
#: Values of the line items as facts, in SQL over the columns of ``fund``.
FACT_VALUES = {c: {"shares": "shares_outstanding", "combined_debt": "total_debt", "current_debt": "CASE WHEN cik % 3 <> 0 THEN cash END", "balance_sheet_total": "total_assets", "total_equity": "CASE WHEN cik % 3 <> 0 THEN book_equity END", "minority_interest": "CASE WHEN cik % 2 = 0 THEN cash END", "temporary_equity": "CASE WHEN cik % 5 = 0 THEN inventory END"}.get(c, c) for c in TAGS}
#: Concepts of the smaller table of facts and the column that each takes its value from.
FACT_CONCEPTS = {"revenue": "revenue", "net_income": "net_income", "total_assets": "total_assets", "cash": "cash", "long_term_debt": "long_term_debt", "shares": "shares_outstanding"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def company(spark: SparkSession, sf: str) -> DataFrame:
    """cik, ticker, name, sic, sector, price; regions and nations have a fixed size and are broadcast."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    places = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))
    out = s.join(places, s.s_nationkey == places.n_nationkey)
    return out.select(F.col("s_suppkey").alias("cik"), F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("ticker"), F.col("s_name").alias("name"), (1000 + 250 * F.col("s_nationkey")).cast("int").alias("sic"), F.col("r_name").alias("sic_sector"), ((F.col("s_suppkey") % 40) / F.lit(20.0)).alias("price"))


#: Kinds of transactions that a supplier's lines stand for: code, insider, under a plan, after an exercise.
KINDS = [("P", k, None, None) for k in range(7)] + [("S", None, plan, linked) for plan in (True, False) for linked in (True, False)] + [(c, None, None, None) for c in "AMFGX"]


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """What fiscal years and insider transactions are made from, in one reading of ``lineitem`` and one aggregation:
    sums by supplier and year, and the value and number of each kind of transaction."""
    code = F.element_at(F.array(*[F.lit(c) for c in "PSAMFGX"]), F.col("l_linenumber"))
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cik"), F.year("l_shipdate").alias("fy"), (F.col("l_partkey") % 7).alias("insider"), code.alias("code"), "l_returnflag", "l_linestatus", cents("l_extendedprice").alias("p"), cents("l_discount").alias("d"))
    kinds = []
    for n, (letter, insider, plan, linked) in enumerate(KINDS):
        test = F.col("code") == letter
        if insider is not None:
            test = test & (F.col("insider") == insider)
        if plan is not None:
            test = test & ((F.col("l_returnflag") == "R") == plan) & ((F.col("l_linestatus") == "O") == linked)
        kinds += [F.sum(F.when(test, F.col("p"))).alias(f"v{n}"), F.count_if(test).alias(f"n{n}")]
    return li.groupBy("cik", "fy").agg(*_year_sums(F.col("p") * F.col("d"), F.lit(1)), *kinds)


def _year_sums(pd: Column, times: Column) -> list[Column]:
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("p"))), F.lit(0))
    return [F.sum("p").alias("g"), F.sum(pd).alias("dd"), part(F.col("l_returnflag") == "A").alias("ga"), part(F.col("l_returnflag") == "N").alias("gn"), part(F.col("l_returnflag") == "R").alias("gr"), part(F.col("l_linestatus") == "O").alias("go"), F.sum(times).alias("n")]


def fund(spark: SparkSession, sf: str, sums: DataFrame | None = None) -> DataFrame:
    """A fiscal year per supplier and ship year: cik, fy, end and the line items of the models; from ``lineitem``, or
    from its ``activity`` where that is at hand."""
    if sums is None:
        li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cik"), F.year("l_shipdate").alias("fy"), cents("l_extendedprice").alias("p"), cents("l_discount").alias("d"), "l_returnflag", "l_linestatus")
        sums = li.groupBy("cik", "fy").agg(*_year_sums(F.col("p") * F.col("d"), F.lit(1)))
    a = sums
    g, ga, gn, gr, go, s = (F.col(c) for c in ("g", "ga", "gn", "gr", "go", "cik"))
    a = a.withColumns({"rev": 100 * g - F.col("dd"), "cg": 55 * g + 20 * ga, "sg": 12 * g + 5 * gr, "dp": 6 * gn})
    a = a.withColumn("eb", F.col("rev") - F.col("cg") - F.col("sg") - F.col("dp") - 5 * g * (s % 10)).withColumn("ta", 100 * g * (1 + s % 3)).withColumn("tl", g * (1 + s % 3) * F.when(s % 29 == 0, 2).otherwise(10 + 13 * s % 85))
    unless = lambda test, x: F.when(~test, x)
    item = {
        "revenue": F.col("rev"), "cogs": unless((s + F.col("fy")) % 17 == 0, F.col("cg")), "sga": F.col("sg"), "depreciation": F.col("dp"), "ebit": unless(s % 11 == 0, F.col("eb")),
        "operating_cash_flow": F.col("eb") + 2 * F.col("dp") - 8 * gn, "total_assets": F.col("ta"), "current_assets": g * (30 + s % 40), "current_liabilities": go * (20 + 7 * s % 60),
        "retained_earnings": 10 * g * (40 - 25 * (s % 7)), "total_liabilities": unless(s % 13 == 0, F.col("tl")), "book_equity": F.col("ta") - F.col("tl"), "receivables": 8 * gn, "inventory": 6 * ga,
        "net_ppe": 30 * g * (1 + s % 3), "long_term_debt": 4 * g * (s % 9), "cash": 5 * g + go, "capex": 3 * gn, "interest_expense": g * (s % 6), "goodwill": unless(s % 4 == 1, 9 * g), "intangibles": unless(s % 8 == 1, 4 * g),
        "goodwill_impairment": F.when(s % 8 == 0, g), "sbc": gr * (s % 5), "gross_ppe": 36 * g * (1 + s % 3), "total_debt": unless(s % 7 == 0, 4 * g * (s % 9) + 2 * g),
        "operating_lease_expense": unless(s % 6 == 1, gr * (s % 4)), "pension_expense": unless(s % 5 == 2, ga), "market_cap": unless(s % 10 == 0, 40 * g * (1 + s % 12)),
    }
    return a.select("cik", "fy", F.concat(F.col("fy").cast("string"), F.lit("-12-31")).alias("end"), (7 * F.col("eb") / F.lit(100000.0)).alias("net_income"), (1000.0 * F.col("n")).alias("shares_outstanding"), *[(v / F.lit(10000.0)).alias(k) for k, v in item.items()])


def paired(periods: DataFrame) -> DataFrame:
    """Each fiscal year as ``t`` with the two before it of the same company as ``t1`` and ``t2``."""
    order = Window.partitionBy("cik").orderBy("fy")
    packed = periods.select("cik", "fy", F.struct(*[c for c in periods.columns if c not in ("cik", "fy")]).alias("t"))
    return packed.withColumn("t1", F.lag("t", 1).over(order)).withColumn("t2", F.lag("t", 2).over(order))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged facts of six concepts with alternates, amendments, ties, forecasts and quarters."""
    return filed_facts(fund(spark, sf), FACT_CONCEPTS)


def filed_facts(years: DataFrame, values: dict[str, str], apart: bool = False) -> DataFrame:
    """Tagged facts of the concepts of ``values``, whose values are in SQL over ``years``; ``apart`` gives each concept
    places of its own, which concepts that share a tag need."""
    about = [(c, k, TAGS[c], c in DURATIONS, "shares" if c == "shares" else "USD") for k, c in enumerate(values)]
    known = years.sparkSession.createDataFrame(about, "concept string, k int, tags array<string>, lasting boolean, unit string")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.expr(v).alias("v")) for c, v in values.items()]))
    base = years.select("cik", "fy", each.alias("x")).select("cik", "fy", "x.*").join(F.broadcast(known), "concept")
    s, fy, v, lasting = F.col("cik"), F.col("fy"), F.col("v"), F.col("lasting")
    text = lambda year, rest: F.concat(year.cast("string"), F.lit(rest))
    end, filed = text(fy, "-12-31"), text(fy + 1, "-03-01")
    nth = lambda k: F.element_at("tags", ((s + k) % F.size("tags") + 1).cast("int"))
    place = lambda kind: (fy * 10 + kind) * 100 + F.col("k") if apart else fy * 10 + kind
    row = lambda kind, tag, start, end, val, fp, form, filed: F.struct(tag.alias("tag"), start.alias("start"), end.alias("end"), val.alias("val"), F.lit(fp).alias("fp"), F.lit(form).alias("form"), filed.alias("filed"), place(kind).alias("row_pos"))
    year_start, quarter_start = F.when(lasting, text(fy, "-01-01")), F.when(lasting, text(fy, "-10-01"))
    every = [
        row(0, nth(0), year_start, end, v, "FY", "10-K", filed),
        F.when(s % 4 == 1, row(1, nth(0), year_start, end, v + 1, "FY", "10-K/A", text(fy + 1, "-06-01"))),
        F.when(s % 4 == 2, row(2, nth(0), year_start, end, v + 2, "FY", "10-K", filed)),
        F.when(s % 3 == 0, row(3, nth(1), year_start, end, v * 2, "FY", "10-K", filed)),
        F.when(s % 5 == 0, row(4, nth(0), year_start, text(fy + 2, "-12-31"), F.lit(1.0), "FY", "10-K", filed)),
        F.when(s % 6 == 0, row(5, nth(0), quarter_start, end, v / 4, "Q4", "10-Q", filed)),
    ]
    dei = F.col("tag").startswith("dei:")
    out = base.select("cik", "unit", F.explode(F.array_compact(F.array(*every))).alias("r")).select("cik", "unit", "r.*")
    out = out.select("cik", F.when(dei, "dei").otherwise("us-gaap").alias("taxonomy"), F.when(dei, F.substring("tag", 5, 1000)).otherwise(F.col("tag")).alias("tag"), "unit", "row_pos", "start", "end", "val", "fp", "form", "filed", F.concat_ws("-", "cik", "row_pos").alias("accn"))
    return out.where("val IS NOT NULL")


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """A filing per event: cik, pos, form, filing_date, accession, items."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = sorted(ITEMS)
    first = F.element_at(F.array(*[F.lit(c) for c in names]), (k % len(names) + 1).cast("int"))
    second = F.create_map(*[F.lit(x) for kv in {"click": "7.01", "view": "8.01", "purchase": "2.02", "signup": "5.02", "error": "4.02"}.items() for x in kv])
    forms = F.create_map(*[F.lit(x) for kv in enumerate(["424B3", "424B5", "S-3", "S-1", "NT 10-K", "144", "SC 13G", "SC 13D", "UPLOAD", "CORRESP"]) for x in kv])
    return e.select(
        F.col("user_id").alias("cik"), (F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1).alias("pos"),
        F.coalesce(F.try_element_at(forms, k % 23), F.lit("8-K")).alias("form"), F.date_format("ts", "yyyy-MM-dd").alias("filing_date"), F.col("event_id").cast("string").alias("accession"),
        F.concat(first, F.lit(","), F.try_element_at(second, F.col("event_type"))).alias("items"), F.when(k % 3 == 0, F.lit("restatement of results")).otherwise("routine").alias("text"), (k * 1000.0).alias("offering_amount"),
    )


def share_points(spark: SparkSession, sf: str) -> DataFrame:
    """Share counts by quarter: cik, period_end, shares."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("e"), cents("o_totalprice").alias("p"))
    a = o.groupBy("cik", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("v"))
    shares = F.when(F.col("v") % 7 == 0, 1_000_000 + F.col("v") % 1000).otherwise(10_000_000 + 1_500_000 * F.col("n") + F.col("v") % 1_000_000)
    return a.select("cik", F.date_format("e", "yyyy-MM-dd").alias("period_end"), shares.cast("double").alias("shares"))


def summed_transactions(sums: DataFrame) -> DataFrame:
    """The transactions of ``activity``: a row for those alike of a year, with how many they are in ``times``."""
    rows = [F.when(F.col(f"n{n}") > 0, F.struct(F.lit(insider).cast("long").alias("insider"), F.lit(code).alias("code"), F.col(f"v{n}").cast("double").alias("value"), F.lit(plan).cast("boolean").alias("is_10b5_1"), F.lit(linked).cast("boolean").alias("preceded_by_exercise"), F.col(f"n{n}").alias("times"))) for n, (code, insider, plan, linked) in enumerate(KINDS)]
    return sums.select("cik", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("cik", "r.*")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    code = F.element_at(F.array(*[F.lit(c) for c in "PSAMFGX"]), F.col("l_linenumber"))
    return li.select(F.col("l_suppkey").alias("cik"), (F.col("l_partkey") % 7).alias("insider"), code.alias("code"), cents("l_extendedprice").cast("double").alias("value"), (F.col("l_returnflag") == "R").alias("is_10b5_1"), (F.col("l_linestatus") == "O").alias("preceded_by_exercise"))


def fails(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", cents("l_extendedprice"), "l_quantity", "l_orderkey", "l_linenumber")
    return li.select(F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("symbol"), F.date_format("l_shipdate", "yyyyMMdd").alias("settlement_date"), F.round("l_quantity").cast("double").alias("quantity"), F.row_number().over(order).cast("long").alias("line_no"), F.round(F.col("l_extendedprice"), 2).alias("price"))


def suspension_rows(spark: SparkSession, sf: str) -> DataFrame:
    return suspended(company(spark, sf))


def suspended(companies: DataFrame) -> DataFrame:
    """Suspensions of every twelfth company: company, date."""
    s = companies.where("cik % 12 = 0")
    return s.select(F.concat("name", F.lit(", Inc.")).alias("company"), F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), (F.col("cik") % 400).cast("int")), "yyyy-MM-dd").alias("date"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Filed texts with phrases of toxic financing put into some: cik, doc_id, text."""
    d = table(spark, sf, "documents")
    phrase = F.element_at(F.array(*[F.lit(p) for p in TOXIC_PHRASES]), (F.col("doc_id") % 10 + 1).cast("int"))
    return d.select((F.col("doc_id") % 100).alias("cik"), "doc_id", F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit(" "), F.upper(phrase))).otherwise(F.col("text")).alias("text"))


def filed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Filed texts with a form and a day, and phrases of listing trouble put into some: cik, doc_id, form, filing_date, text."""
    d = documents(spark, sf)
    nth = lambda texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("doc_id") % len(texts) + 1).cast("int"))
    trouble = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" "), F.upper(nth(PROBES["delisting"]["phrases"])))).otherwise(F.col("text"))
    day = F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")
    return d.select("cik", "doc_id", nth(["424B5", "8-K", "S-1", "10-K"]).alias("form"), day.alias("filing_date"), trouble.alias("text"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, scanned_at, score, flags from events by user and day."""
    flag = F.create_map(*[F.lit(x) for kv in {"click": "ACTIVE-ATM", "view": "OVERHANG-HIGH", "purchase": "RESTATEMENT", "signup": "SHELL-ARC", "error": "SERIAL-SPLITTER"}.items() for x in kv])
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("ticker"), F.date_format("ts", "yyyy-MM-dd").alias("scanned_at"), cents("value").alias("c"), F.try_element_at(flag, F.col("event_type")).alias("flag"))
    return e.groupBy("ticker", "scanned_at").agg((F.pmod(F.sum("c"), F.lit(600)) / F.lit(100.0) - 3.8).alias("score"), F.sort_array(F.collect_set("flag")).alias("flags"))
