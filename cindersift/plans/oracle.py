"""The queries in DuckDB's SQL over the same tables, written apart from the operators to check them."""

from __future__ import annotations

from ..functions.constants import CORE_INPUTS, CRITICAL, DURATIONS, GATE_REASONS, ITEMS, LEGAL_SUFFIXES, MATERIAL_FLAGS, MODULES, NT_FORMS, POSITIVES, PRESETS, PROBES, PROFILES, SHARE_SERIES, SHELF_FORMS, TAGS, TIERS, TOXIC_PHRASES
from ..functions.models import RATINGS

EV_DAY, DAY = "DATE '2024-01-31'", "DATE '2001-12-31'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qs(texts: list[str]) -> str:
    return "(" + ", ".join(map(q, texts)) + ")"


def lst(texts: list[str]) -> str:
    return "[" + ", ".join(map(q, texts)) + "]"


def d(a: str, b: str) -> str:
    return f"(({a}) / nullif(CAST(({b}) AS DOUBLE), 0))"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def flags(*pairs: tuple[str, str]) -> str:
    """Names whose condition holds, joined."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, n in pairs) + "], lambda x: x IS NOT NULL), ';')"


def clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(1.0, greatest(0.0, {x})) END"


COMPANY = """company AS (
  SELECT s_suppkey AS cik, 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker, s_name AS name, (1000 + 250 * s_nationkey)::INT AS sic, r_name AS sic_sector, (s_suppkey % 40) / 20.0::DOUBLE AS price
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FUND = """li AS (SELECT l_suppkey AS s, year(l_shipdate)::INT AS fy, round(l_extendedprice * 100)::BIGINT AS p, round(l_discount * 100)::BIGINT AS dc, l_returnflag AS rf, l_linestatus AS ls FROM lineitem),
a0 AS (SELECT s, fy, sum(p)::BIGINT AS g, sum(p * dc)::BIGINT AS dd, coalesce(sum(p) FILTER (rf = 'A'), 0)::BIGINT AS ga, coalesce(sum(p) FILTER (rf = 'N'), 0)::BIGINT AS gn,
  coalesce(sum(p) FILTER (rf = 'R'), 0)::BIGINT AS gr, coalesce(sum(p) FILTER (ls = 'O'), 0)::BIGINT AS go, count(*) AS n FROM li GROUP BY 1, 2),
a1 AS (SELECT *, 100 * g - dd AS rev, 55 * g + 20 * ga AS cg, 12 * g + 5 * gr AS sg, 6 * gn AS dp, 100 * g * (1 + s % 3) AS ta, g * (1 + s % 3) * CASE WHEN s % 29 = 0 THEN 2 ELSE 10 + 13 * s % 85 END AS tl FROM a0),
a2 AS (SELECT *, rev - cg - sg - dp - 5 * g * (s % 10) AS eb FROM a1),
f AS (SELECT s AS cik, fy, fy || '-12-31' AS "end", 7 * eb / 100000.0::DOUBLE AS net_income, n * 1000.0::DOUBLE AS shares_outstanding, rev / 10000.0::DOUBLE AS revenue,
  CASE WHEN (s + fy) % 17 <> 0 THEN cg / 10000.0::DOUBLE END AS cogs, sg / 10000.0::DOUBLE AS sga, dp / 10000.0::DOUBLE AS depreciation, CASE WHEN s % 11 <> 0 THEN eb / 10000.0::DOUBLE END AS ebit,
  (eb + 2 * dp - 8 * gn) / 10000.0::DOUBLE AS operating_cash_flow, ta / 10000.0::DOUBLE AS total_assets, g * (30 + s % 40) / 10000.0::DOUBLE AS current_assets, go * (20 + 7 * s % 60) / 10000.0::DOUBLE AS current_liabilities,
  10 * g * (40 - 25 * (s % 7)) / 10000.0::DOUBLE AS retained_earnings, CASE WHEN s % 13 <> 0 THEN tl / 10000.0::DOUBLE END AS total_liabilities, (ta - tl) / 10000.0::DOUBLE AS book_equity,
  8 * gn / 10000.0::DOUBLE AS receivables, 6 * ga / 10000.0::DOUBLE AS inventory, 30 * g * (1 + s % 3) / 10000.0::DOUBLE AS net_ppe, 4 * g * (s % 9) / 10000.0::DOUBLE AS long_term_debt, (5 * g + go) / 10000.0::DOUBLE AS cash,
  3 * gn / 10000.0::DOUBLE AS capex, g * (s % 6) / 10000.0::DOUBLE AS interest_expense, CASE WHEN s % 4 <> 1 THEN 9 * g / 10000.0::DOUBLE END AS goodwill, CASE WHEN s % 8 <> 1 THEN 4 * g / 10000.0::DOUBLE END AS intangibles,
  CASE WHEN s % 8 = 0 THEN g / 10000.0::DOUBLE END AS goodwill_impairment, gr * (s % 5) / 10000.0::DOUBLE AS sbc, 36 * g * (1 + s % 3) / 10000.0::DOUBLE AS gross_ppe,
  CASE WHEN s % 7 <> 0 THEN (4 * g * (s % 9) + 2 * g) / 10000.0::DOUBLE END AS total_debt, CASE WHEN s % 6 <> 1 THEN gr * (s % 4) / 10000.0::DOUBLE END AS operating_lease_expense,
  CASE WHEN s % 5 <> 2 THEN ga / 10000.0::DOUBLE END AS pension_expense, CASE WHEN s % 10 <> 0 THEN 40 * g * (1 + s % 12) / 10000.0::DOUBLE END AS market_cap FROM a2)"""
PAIR = FUND + ",\np AS (SELECT cik, fy, f AS t, lag(f, 1) OVER w AS t1, lag(f, 2) OVER w AS t2 FROM f WINDOW w AS (PARTITION BY cik ORDER BY fy))"

X1, X2, X3, X4 = d("t.current_assets - t.current_liabilities", "t.total_assets"), d("t.retained_earnings", "t.total_assets"), d("t.ebit", "t.total_assets"), d("t.book_equity", "t.total_liabilities")
Z_ALL = f"(6.56 * {X1} + 3.26 * {X2} + 6.72 * {X3} + 1.05 * {X4})"
Z_GATED = f"coalesce({X4} > 4.0 AND {X2} < 0 AND {X3} <= 0 AND {Z_ALL} - 1.05 * {X4} >= -3.0, false)"
Z = f"CASE WHEN NOT {Z_GATED} THEN {Z_ALL} END"


def zone(z: str) -> str:
    return f"CASE WHEN ({z}) < -3.0 THEN 'distress' WHEN ({z}) > 1.0 THEN 'safe' WHEN ({z}) IS NOT NULL THEN 'grey' END"


def health(z: str) -> str:
    return f"round(1 / (1 + exp(-(2 * ln(3.0) / (asinh(1.0) - asinh(-3.0))) * (asinh({z}) - (asinh(-3.0) + asinh(1.0)) / 2))), 6)"


def gaps(*pairs: tuple[str, str]) -> str:
    return flags(*[(f"({x}) IS NULL", n) for n, x in pairs])


def count_true(*tests: str) -> str:
    return " + ".join(f"CAST(({t}) AS INT)" for t in tests)


def gm(p: str) -> str:
    return d(f"{p}.revenue - {p}.cogs", f"{p}.revenue")


def part(p: str, a: str, b: str) -> str:
    return d(f"{p}.{a}", f"{p}.{b}")


def soft(p: str) -> str:
    return f"(1 - {d(f'{p}.current_assets + {p}.net_ppe', f'{p}.total_assets')})"


def worn(p: str) -> str:
    return d(f"{p}.depreciation", f"{p}.depreciation + {p}.net_ppe")


def owed(p: str) -> str:
    return d(f"{p}.current_liabilities + {p}.long_term_debt", f"{p}.total_assets")


BENEISH = {
    "dsri": d(part("t", "receivables", "revenue"), part("t1", "receivables", "revenue")), "gmi": d(gm("t1"), gm("t")), "aqi": d(soft("t"), soft("t1")), "sgi": d("t.revenue", "t1.revenue"),
    "depi": d(worn("t1"), worn("t")), "sgai": d(part("t", "sga", "revenue"), part("t1", "sga", "revenue")), "lvgi": d(owed("t"), owed("t1")), "tata": d("t.net_income - t.operating_cash_flow", "t.total_assets"),
}
M = "(-4.84 + " + " + ".join(f"{w} * {BENEISH[k]}" for k, w in (("dsri", 0.920), ("gmi", 0.528), ("aqi", 0.404), ("sgi", 0.892), ("depi", 0.115), ("sgai", -0.172), ("tata", 4.679), ("lvgi", -0.327))) + ")"
PIOTROSKI = count_true(
    "t.net_income > 0", "t.operating_cash_flow > 0", f"{part('t', 'net_income', 'total_assets')} > {part('t1', 'net_income', 'total_assets')}", "t.operating_cash_flow > t.net_income",
    f"{part('t', 'long_term_debt', 'total_assets')} < {part('t1', 'long_term_debt', 'total_assets')}", f"{part('t', 'current_assets', 'current_liabilities')} > {part('t1', 'current_assets', 'current_liabilities')}",
    "t.shares_outstanding <= t1.shares_outstanding", f"{gm('t')} > {gm('t1')}", f"{part('t', 'revenue', 'total_assets')} > {part('t1', 'revenue', 'total_assets')}",
)


def debt(p: str) -> str:
    return f"coalesce({p}.total_debt, {p}.long_term_debt)"


def noa(p: str) -> str:
    return f"(({p}.total_assets - {p}.cash) - ({p}.total_liabilities - {debt(p)}))"


AVG, AVG1 = "((t.total_assets + t1.total_assets) / 2)", "((t1.total_assets + t2.total_assets) / 2)"
SALES, SALES1 = "(t.revenue - (t.receivables - t1.receivables))", "(t1.revenue - (t1.receivables - t2.receivables))"
LOGIT = (
    f"(-7.893 + 0.790 * {d(f'{noa("t")} - {noa("t1")}', AVG)} + 2.518 * {d('t.receivables - t1.receivables', AVG)} + 1.191 * {d('t.inventory - t1.inventory', AVG)} + 1.979 * {d('t.total_assets - t.net_ppe - t.cash', 't.total_assets')}"
    f" + 0.171 * {d(f'{SALES} - {SALES1}', SALES1)} - 0.932 * ({d('t.net_income', AVG)} - {d('t1.net_income', AVG1)}) + 1.029 * CAST(cik % 2 = 0 AS INT))"
)
DECHOW = f"(exp({LOGIT}) / (1 + exp({LOGIT})) / 0.0037)"
MONTIER = count_true(
    "(t.net_income - t.operating_cash_flow) > (t1.net_income - t1.operating_cash_flow)", f"{part('t', 'receivables', 'revenue')} > {part('t1', 'receivables', 'revenue')}", f"{part('t', 'inventory', 'cogs')} > {part('t1', 'inventory', 'cogs')}",
    f"{part('t', 'current_assets', 'revenue')} > {part('t1', 'current_assets', 'revenue')}", f"{part('t', 'depreciation', 'gross_ppe')} < {part('t1', 'depreciation', 'gross_ppe')}", f"{d('t.total_assets - t1.total_assets', 't1.total_assets')} > 0.10",
)
GROWTH = d("t.revenue - t1.revenue", "abs(t1.revenue)")
EV = f"(t.market_cap + {debt('t')} - t.cash)"
EVS = f"CASE WHEN {EV} IS NOT NULL THEN {d(EV, 't.revenue')} END"
FIN = "coalesce(sic BETWEEN 6000 AND 6999, false)"
EBITDA = "(t.ebit + t.depreciation)"
NET_DEBT = f"({debt('t')} - t.cash)"
ADJ = f"CASE WHEN t.operating_lease_expense IS NOT NULL OR t.pension_expense IS NOT NULL THEN {EBITDA} + coalesce(t.operating_lease_expense, 0) + coalesce(t.pension_expense, 0) END"
UP = [("t.goodwill_impairment > 0", "goodwill-impairment"), (f"{d(NET_DEBT, EBITDA)} > 4.0", "high-leverage"), (f"{d('t.ebit', 't.interest_expense')} < 1.5", "weak-interest-coverage"), (f"{d('t.sbc', 't.revenue')} > 0.10", "high-sbc-dilution")]
BURN = "CASE WHEN t.operating_cash_flow < 0 THEN -t.operating_cash_flow / 12 END"
CAP = "coalesce(t.market_cap, price * nullif(t.shares_outstanding, 0))"
REV_EV = f"({CAP} + t.total_debt - t.cash)"


def pair(columns: str, joined: bool = False, base: str = PAIR) -> str:
    return f"WITH {base}" + (f",\n{COMPANY}\nSELECT cik, fy, {columns} FROM p JOIN company USING (cik)" if joined else f"\nSELECT cik, fy, {columns} FROM p")


def bucket(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} < 50e6 THEN 'nano' WHEN {c} < 300e6 THEN 'micro' WHEN {c} < 2e9 THEN 'small' WHEN {c} < 10e9 THEN 'mid' ELSE 'large' END"


def tier_of_float(c: str) -> str:
    return f"CASE WHEN {c} < 10000000 THEN 'material' WHEN {c} < 20000000 THEN 'notorious' WHEN {c} < 50000000 THEN 'caution' END"


ORACLE: dict[str, str] = {}
ORACLE["altman"] = pair(f"{r6(Z)} AS value, {r6(X1)} AS x1, {r6(X2)} AS x2, {r6(X3)} AS x3, {r6(X4)} AS x4, {Z_GATED} AS gated, CASE WHEN {Z_GATED} THEN 'applicability:X4_BE_TL' ELSE " + gaps(*[(n, f"t.{n}") for n in ("current_assets", "current_liabilities", "retained_earnings", "ebit", "book_equity", "total_assets", "total_liabilities")]) + f" END AS missing, {zone(Z)} AS zone")
_ems = f"(({Z}) + 3.25)"
ORACLE["altman_bre"] = pair(f"{r6(_ems)} AS ems, CASE WHEN {_ems} IS NULL THEN NULL " + " ".join(f"WHEN {_ems} >= {x} THEN {q(g)}" for x, g, _ in RATINGS) + f" ELSE 'D' END AS grade, CASE WHEN {_ems} IS NULL THEN NULL " + " ".join(f"WHEN {_ems} >= {x} THEN {q(w)}" for x, _, w in RATINGS) + f" ELSE 'default' END AS risk, {health(f'({Z})')} AS health")
ORACLE["beneish"] = pair(f"{r6(M)} AS value, " + ", ".join(f"{r6(v)} AS {k}" for k, v in BENEISH.items()) + f", {M} > -1.78 AS flagged, {gaps(*BENEISH.items())} AS missing")
ORACLE["dechow"] = pair(f"{r6(DECHOW)} AS value, {r6(LOGIT)} AS logit, CASE WHEN {DECHOW} > 2.45 THEN 'misstatement-risk-high' WHEN {DECHOW} > 1.85 THEN 'misstatement-risk-substantial' WHEN {DECHOW} > 1.0 THEN 'misstatement-risk-above-normal' END AS level")
ORACLE["montier"] = pair(f"CAST({MONTIER} AS DOUBLE) AS value")
ORACLE["piotroski"] = pair(f"CAST({PIOTROSKI} AS DOUBLE) AS value, CASE WHEN ({PIOTROSKI}) >= 7 THEN 'value-universe-signal;strong' WHEN ({PIOTROSKI}) <= 2 THEN 'value-universe-signal;weak' WHEN ({PIOTROSKI}) IS NOT NULL THEN 'value-universe-signal' END AS flags, round(({PIOTROSKI}) / 9.0::DOUBLE, 4) AS sub_score")
_gap, _wc = "t.net_income - t.operating_cash_flow", lambda p: f"(({p}.current_assets - {p}.cash) - {p}.current_liabilities)"
ORACLE["accruals"] = pair(f"{r6(d(_gap, 't.total_assets'))} AS value, {r6(d(_gap, AVG))} AS sloan_cash_flow, {r6(d(f'{_wc("t")} - {_wc("t1")} - t.depreciation', AVG))} AS sloan_balance, {d(_gap, 't.total_assets')} > 0.10 AS high")
_run = "t.cash / -t.operating_cash_flow"
ORACLE["cash_runway"] = pair(f"CASE WHEN t.operating_cash_flow < 0 THEN {r6(_run)} END AS value, " + flags(("t.operating_cash_flow >= 0", "cash-generating"), ("t.operating_cash_flow < 0 AND t1.operating_cash_flow < 0 AND t.operating_cash_flow < t1.operating_cash_flow", "burn-accelerating"), (f"t.operating_cash_flow < 0 AND (cik % 9 = 0 OR {_run} < 4)", "financing-cliff")) + " AS flags")
_bad = f"NOT {FIN} AND coalesce({EBITDA} <= 0, true)"
ORACLE["ev_valuation"] = pair(f"{r6(d(EV, 't.revenue'))} AS value, {r6(EV)} AS ev, CASE WHEN NOT {FIN} AND {EBITDA} > 0 THEN {r6(d(EV, EBITDA))} END AS ev_ebitda, {r6(d('t.operating_cash_flow - t.capex', EV))} AS fcf_yield, CASE WHEN {EV} IS NOT NULL THEN " + flags((FIN, "ev-ebitda-suppressed-financials"), (FIN, "out-of-model-financials"), (_bad, "ev-ebitda-not-meaningful"), (f"{_bad} AND {d(EV, 't.revenue')} IS NOT NULL", "ev-sales-fallback")) + f" END AS flags, round({clamp(f'(10.0 - {d(EV, "t.revenue")}) / 9.0')}, 4) AS sub_score", True)
_good = d("coalesce(t.goodwill, 0) + coalesce(t.intangibles, 0)", "t.total_assets")
ORACLE["up_market"] = pair(f"CASE WHEN t.goodwill IS NOT NULL OR t.intangibles IS NOT NULL THEN {r6(_good)} END AS goodwill_share, {r6(d(NET_DEBT, EBITDA))} AS net_debt_ebitda, {r6(ADJ)} AS adjusted_ebitda, {r6(d(NET_DEBT, ADJ))} AS net_debt_adjusted, {r6(d('t.ebit', 't.interest_expense'))} AS coverage, {r6(d('t.sbc', 't.revenue'))} AS sbc_revenue, {flags(*UP)} AS flags")
_sales = "CASE WHEN t.revenue > 0 THEN t.revenue END"
_have = "(" + " + ".join(f"CAST(t.{c} IS NOT NULL AS INT)" for c in ("revenue", "cash", "shares_outstanding", "operating_cash_flow")) + ")"
ORACLE["fundamentals_record"] = pair(f"{r6(GROWTH)} AS growth, {r6(BURN)} AS monthly_burn, {r6(d('t.cash', BURN))} AS runway_months, {r6(CAP)} AS market_cap, {r6(d(CAP, _sales))} AS price_sales, {r6(REV_EV)} AS ev, {r6(d(REV_EV, _sales))} AS ev_sales, {r6(f'{_have} / 4.0')}::DOUBLE AS completeness, " + flags((f"{_have} < 4", "fundamentals-incomplete"), ("t.revenue IS NULL OR t.cash IS NULL", "low-confidence"), ("t1.revenue IS NULL", "limited-history")) + f" AS flags, round({clamp(f'({GROWTH} + 0.20) / 0.60')}, 4) AS sub_score", True)
ORACLE["model_ratios"] = pair(f"{r6(gm('t'))} AS gross_margin, {r6(noa('t'))} AS operating_assets, {r6(EBITDA)} AS ebitda, {r6(debt('t'))} AS debt, {bucket('t.market_cap')} AS size_bucket, {tier_of_float('t.shares_outstanding * 2000')} AS float_tier")

# ---- facts ------------------------------------------------------------------


def _facts(values: dict[str, str], apart: bool = False) -> str:
    parts = []
    for k, (concept, column) in enumerate(values.items()):
        place = f"* 100 + {k}" if apart else ""
        tags, n = lst(TAGS[concept]), len(TAGS[concept])
        start = "fy || '-01-01'" if concept in DURATIONS else "NULL::VARCHAR"
        late = "fy || '-10-01'" if concept in DURATIONS else "NULL::VARCHAR"
        row = lambda kind, k, start, end, val, fp, form, filed, test: f"SELECT {q(concept)} AS concept, cik, {tags}[(cik + {k}) % {n} + 1] AS tag0, {start} AS start, {end} AS \"end\", {val} AS val, {q(fp)} AS fp, {q(form)} AS form, {filed} AS filed, (fy * 10 + {kind}) {place} AS row_pos FROM f WHERE {test}"  # noqa: E731, B023
        fy_end, filed = "fy || '-12-31'", "(fy + 1) || '-03-01'"
        parts += [
            row(0, 0, start, fy_end, column, "FY", "10-K", filed, "true"), row(1, 0, start, fy_end, f"({column}) + 1", "FY", "10-K/A", "(fy + 1) || '-06-01'", "cik % 4 = 1"),
            row(2, 0, start, fy_end, f"({column}) + 2", "FY", "10-K", filed, "cik % 4 = 2"), row(3, 1, start, fy_end, f"({column}) * 2", "FY", "10-K", filed, "cik % 3 = 0"),
            row(4, 0, start, "(fy + 2) || '-12-31'", "1.0", "FY", "10-K", filed, "cik % 5 = 0"), row(5, 0, late, fy_end, f"({column}) / 4", "Q4", "10-Q", filed, "cik % 6 = 0"),
        ]
    tags = ", ".join(f"({q(c)}, {q(t)}, {i})" for c, ts in TAGS.items() for i, t in enumerate(ts))
    return (
        FUND + ",\nraw AS (" + "\nUNION ALL ".join(parts) + "),\nfacts AS (SELECT *, replace(tag0, 'dei:', '') AS tag, starts_with(tag0, 'dei:') AS dei, cik || '-' || row_pos AS accn FROM raw WHERE val IS NOT NULL),"
        f"\ndict AS (SELECT * FROM (VALUES {tags}) AS v(field, tag0, prio)),"
        "\ntagged AS (SELECT facts.*, field, prio FROM facts JOIN dict USING (tag0) WHERE (field = 'shares') = (facts.concept = 'shares')),"
        "\nends AS (SELECT cik, \"end\", row_number() OVER (PARTITION BY cik ORDER BY \"end\" DESC) AS rank FROM (SELECT DISTINCT cik, \"end\" FROM facts WHERE NOT dei AND fp = 'FY' AND starts_with(form, '10-K') AND NOT \"end\"::DATE > filed::DATE))"
    )


FACTS = _facts({"revenue": "revenue", "net_income": "net_income", "total_assets": "total_assets", "cash": "cash", "long_term_debt": "long_term_debt", "shares": "shares_outstanding"})
FACT_VALUES = {
    **{c: c for c in TAGS}, "shares": "shares_outstanding", "combined_debt": "total_debt", "current_debt": "CASE WHEN cik % 3 <> 0 THEN cash END", "balance_sheet_total": "total_assets",
    "total_equity": "CASE WHEN cik % 3 <> 0 THEN book_equity END", "minority_interest": "CASE WHEN cik % 2 = 0 THEN cash END", "temporary_equity": "CASE WHEN cik % 5 = 0 THEN inventory END",
}
SPAN = "date_diff('day', start::DATE, \"end\"::DATE)"
ANNUAL = f"CASE WHEN start IS NOT NULL THEN {SPAN} BETWEEN 350 AND 380 ELSE fp = 'FY' OR form = '10-K' END"
_concepts = ["revenue", "net_income", "total_assets", "cash", "long_term_debt", "shares"]


def at_ends(concepts: list[str]) -> str:
    return f"""at_ends AS (SELECT cik, "end", field AS concept, val, filed FROM tagged JOIN ends USING (cik, "end") WHERE field IN {qs(concepts)} AND
  CASE WHEN field IN {qs(DURATIONS)} THEN start IS NOT NULL AND ({SPAN} BETWEEN 350 AND 380 OR (fp = 'FY' AND starts_with(form, '10-K'))) ELSE start IS NULL END
  QUALIFY row_number() OVER (PARTITION BY cik, "end", field ORDER BY prio, filed DESC, row_pos) = 1)"""


AT_ENDS = at_ends(_concepts)
_items = [c for c in TAGS if c != "shares"]
_direct = [c for c in _items if c not in ("balance_sheet_total", "total_equity", "minority_interest", "temporary_equity", "current_debt")]
SHARES = f"SELECT e.cik, e.\"end\", val AS shares FROM ends e JOIN tagged t ON t.cik = e.cik AND t.field = 'shares' AND date_diff('day', e.\"end\"::DATE, t.\"end\"::DATE) BETWEEN -45 AND 180 QUALIFY row_number() OVER (PARTITION BY e.cik, e.\"end\" ORDER BY prio, abs(date_diff('day', e.\"end\"::DATE, t.\"end\"::DATE)), filed, row_pos) = 1"
PERIODS = f"""{_facts(FACT_VALUES, True)},
{at_ends(_items)},
sh AS ({SHARES}),
pv AS (SELECT cik, "end", rank, {', '.join(f"max(val) FILTER (concept = {q(c)}) AS {c}" for c in _items)}, max(filed) FILTER (concept IN {qs(_direct)}) AS filed_direct, max(filed) FILTER (concept = 'current_debt') AS filed_leg
  FROM ends LEFT JOIN at_ends USING (cik, "end") GROUP BY ALL),
pf AS (SELECT pv.cik, pv."end", pv.rank, {', '.join(c for c in _items if c != 'total_liabilities')}, CASE WHEN combined_debt IS NULL THEN greatest(filed_direct, filed_leg) ELSE filed_direct END AS financials_filed,
  coalesce(total_liabilities, balance_sheet_total - coalesce(total_equity, book_equity + coalesce(minority_interest, 0)) - coalesce(temporary_equity, 0)) AS total_liabilities,
  coalesce(combined_debt, CASE WHEN long_term_debt IS NOT NULL OR current_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(current_debt, 0) END) AS total_debt, sh.shares AS shares_outstanding
  FROM pv LEFT JOIN sh USING (cik, "end"))"""
ORACLE["fy_ends"] = f"WITH {FACTS}\nSELECT * FROM ends"
ORACLE["tag_fallback"] = f"WITH {FACTS},\n{AT_ENDS}\nSELECT cik, \"end\", concept, {r6('val')} AS val, filed FROM at_ends"
_named = [c for c in _items if c not in ("balance_sheet_total", "total_equity", "minority_interest", "temporary_equity", "combined_debt", "current_debt")] + ["total_debt", "shares_outstanding"]
ORACLE["period_pivot"] = f"WITH {PERIODS}\nSELECT cik, \"end\", rank, {', '.join(f'{r6(c)} AS {c}' for c in _named)}, financials_filed FROM pf WHERE rank <= 2"
_quarter = f"CASE WHEN start IS NOT NULL THEN {SPAN} BETWEEN 80 AND 100 ELSE fp IN ('Q1', 'Q2', 'Q3', 'Q4') END"
ORACLE["latest_fact"] = f"WITH {FACTS}\n" + " UNION ALL ".join(
    f"(SELECT cik, field, tag, {r6('val')} AS val, \"end\" AS period_end, form, filed, accn AS accession FROM tagged WHERE field = {q(c)} QUALIFY row_number() OVER (PARTITION BY cik ORDER BY prio, CAST({test} AS INT) DESC, \"end\" DESC, filed DESC, row_pos) = 1)"
    for c, test in (("net_income", ANNUAL), ("cash", "start IS NULL"), ("revenue", _quarter))
)
ORACLE["annual_series"] = f"WITH {FACTS},\nk AS (SELECT *, min(prio) OVER (PARTITION BY cik) AS first FROM tagged WHERE field = 'revenue' AND {ANNUAL})\nSELECT cik, tag, \"end\", {r6('val')} AS val FROM k WHERE prio = first QUALIFY row_number() OVER (PARTITION BY cik, tag, \"end\" ORDER BY filed DESC, row_pos) = 1"
ORACLE["share_asof"] = f"WITH {FACTS}\nSELECT e.cik, e.\"end\", {r6('val')} AS shares FROM ends e JOIN tagged t ON t.cik = e.cik AND t.field = 'shares' AND date_diff('day', e.\"end\"::DATE, t.\"end\"::DATE) BETWEEN -45 AND 180 QUALIFY row_number() OVER (PARTITION BY e.cik, e.\"end\" ORDER BY prio, abs(date_diff('day', e.\"end\"::DATE, t.\"end\"::DATE)), filed, row_pos) = 1"
ORACLE["share_series"] = f"WITH {FACTS},\nk AS (SELECT *, min(prio) OVER (PARTITION BY cik) AS first FROM tagged WHERE field = 'shares' AND tag0 IN {qs(SHARE_SERIES)})\nSELECT cik, \"end\" AS period_end, {r6('val')} AS shares FROM k WHERE prio = first QUALIFY row_number() OVER (PARTITION BY cik, \"end\" ORDER BY filed DESC, row_pos DESC) = 1"
ORACLE["derived_liabilities"] = f"WITH {FUND}\nSELECT cik, fy, {r6('''CASE WHEN total_liabilities IS NOT NULL THEN total_liabilities ELSE total_assets - CASE WHEN cik % 3 <> 0 THEN book_equity ELSE book_equity + CASE WHEN cik % 2 = 0 THEN cash ELSE 0 END END - CASE WHEN cik % 5 = 0 THEN inventory ELSE 0 END END''')} AS total_liabilities FROM f"
ORACLE["total_debt"] = f"WITH {FUND}\nSELECT cik, fy, {r6('''CASE WHEN total_debt IS NOT NULL THEN total_debt WHEN cik % 5 <> 0 AND cik % 3 <> 0 THEN long_term_debt + cash WHEN cik % 5 <> 0 THEN long_term_debt WHEN cik % 3 <> 0 THEN cash END''')} AS total_debt FROM f"

# ---- dilution ---------------------------------------------------------------

POINTS = """pt0 AS (SELECT o_custkey AS cik, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS e, round(o_totalprice * 100)::BIGINT AS p FROM orders),
pt1 AS (SELECT cik, e, count(*) AS n, sum(p)::BIGINT AS v FROM pt0 GROUP BY 1, 2),
points AS (SELECT cik, strftime(e, '%Y-%m-%d') AS period_end, e, CASE WHEN v % 7 = 0 THEN 1000000 + v % 1000 ELSE 10000000 + 1500000 * n + v % 1000000 END::DOUBLE AS shares FROM pt1)"""
YEAR_AGO = """last AS (SELECT cik, max(e) AS e1 FROM points GROUP BY 1),
ago AS (SELECT p.cik, p.shares AS year_ago, abs(date_diff('day', (e1 - INTERVAL 1 YEAR)::DATE, p.e)) AS diff FROM points p JOIN last USING (cik) WHERE NOT (month(e1) = 2 AND day(e1) = 29) QUALIFY row_number() OVER (PARTITION BY p.cik ORDER BY diff, period_end) = 1),
year_ago AS (SELECT cik, year_ago FROM ago WHERE diff <= 45)"""
VELOCITY = f"""{POINTS}, {YEAR_AGO},
mv AS (SELECT cik, shares, lag(shares) OVER w AS p1, lag(shares, 2) OVER w AS p2, row_number() OVER (PARTITION BY cik ORDER BY e DESC) AS r FROM points WINDOW w AS (PARTITION BY cik ORDER BY e)),
velocity AS (SELECT cik, shares AS latest, (shares - p1) / p1 AS qoq, CASE WHEN p1 IS NOT NULL THEN (shares - year_ago) / year_ago END AS yoy,
  CASE WHEN p2 IS NOT NULL THEN CASE WHEN (shares - p1) / p1 > (p1 - p2) / p2 THEN 'accelerating' ELSE 'decelerating' END END AS trend, coalesce((shares - p1) / p1 >= 0.20, false) AS death_spiral, p1 IS NULL AS low_confidence FROM mv LEFT JOIN year_ago USING (cik) WHERE r = 1)"""
SPLITS = """sp AS (SELECT cik, period_end, lag(shares) OVER (PARTITION BY cik ORDER BY period_end) / shares AS ratio FROM points),
splits AS (SELECT cik, count(*) AS n_splits, count(*) >= 2 AS serial, min(substr(period_end, 1, 4)) AS since_year, max(period_end) AS last_split, product(ratio) AS cumulative FROM sp WHERE ratio BETWEEN 1.8 AND 250 GROUP BY 1)"""
_items = lst(sorted(ITEMS))
_forms = ["424B3", "424B5", "S-3", "S-1", "NT 10-K", "144", "SC 13G", "SC 13D", "UPLOAD", "CORRESP"]
FILINGS = f"""ev AS (SELECT *, (props::JSON->>'k')::INT AS k FROM events),
filings AS (SELECT user_id AS cik, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS pos, coalesce({lst(_forms)}[k % 23 + 1], '8-K') AS form, strftime(ts, '%Y-%m-%d') AS filing_date, ts::DATE AS fd, event_id::VARCHAR AS accession,
  [{_items}[k % {len(ITEMS)} + 1], CASE event_type WHEN 'click' THEN '7.01' WHEN 'view' THEN '8.01' WHEN 'purchase' THEN '2.02' WHEN 'signup' THEN '5.02' WHEN 'error' THEN '4.02' END] AS codes, CASE WHEN k % 3 = 0 THEN 'restatement of results' ELSE 'routine' END AS text, k * 1000.0::DOUBLE AS amount FROM ev)"""
_age = f"date_diff('day', fd, {EV_DAY})"
REG = f"""reg AS (SELECT cik, count(*) FILTER (form IN {qs(SHELF_FORMS)}) AS n_shelves, max(amount) FILTER (form IN {qs(SHELF_FORMS)}) AS max_amount, coalesce(bool_or(form = 'S-3ASR'), false) AS wksi, count(*) FILTER (form = '424B3') AS n_424b3,
  count(*) FILTER (form = '424B5') AS n_424b5, count(*) FILTER (form = '424B3' AND {_age} <= 60) >= 2 AS active_atm, count(*) FILTER (form IN {qs(NT_FORMS)}) AS n_late, coalesce(bool_or(form IN {qs(NT_FORMS)} AND text LIKE '%restatement%'), false) AS late_escalated FROM filings GROUP BY 1)"""
DOCS = f"docs AS (SELECT doc_id % 100 AS cik, doc_id, CASE WHEN doc_id % 37 = 0 THEN text || ' ' || upper({lst(TOXIC_PHRASES)}[doc_id % 10 + 1]) ELSE text END AS text FROM documents)"
TERMS = f"list_filter({lst(TOXIC_PHRASES)}, lambda x: contains(lower(text), x))"
_cat = "CASE c " + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in ITEMS.items()) + " ELSE 'uncategorized' END"
_sev = "CASE c " + " ".join(f"WHEN {q(k)} THEN {v[1]}" for k, v in ITEMS.items()) + " ELSE 0 END"
BUILT = f"built AS (SELECT *, list_transform(codes, lambda c: {_cat}) AS cats, list_transform(codes, lambda c: ({_sev})::DOUBLE) AS sevs FROM filings WHERE form LIKE '8-K%')"


def tape(as_of: str = EV_DAY, days: int = 180) -> str:
    groups = {"unregistered": ["3.02"], "delisting": ["3.01"], "bankruptcy": ["1.03"], "auditor": ["4.01", "4.02"], "charter": ["5.03", "5.06", "5.07"], "officer": ["5.02"], "obligation": ["2.03", "2.04"], "promo": ["7.01", "8.01"], "earnings": ["2.02"], "agreement": ["1.01", "1.02"]}
    counts = [f"count(*) FILTER (c IN {qs(v)} AND date_diff('day', fd, {as_of}) <= {days}) AS {k}" for k, v in groups.items()] + [f"count(*) FILTER (c = '{k}') AS ever_{k.replace('.', '')}" for k in ("4.01", "4.02", "5.03", "5.06")]
    return f"tape0 AS (SELECT cik, {', '.join(counts)} FROM (SELECT cik, fd, unnest(codes) AS c FROM built) GROUP BY 1), tape AS (SELECT *, delisting > 0 AS has_delisting_notice, promo >= 3 AND earnings = 0 AS promotional_cadence FROM tape0)"


ORACLE["dilution_velocity"] = f"WITH {VELOCITY}\nSELECT cik, latest, {r6('qoq')} AS qoq, {r6('yoy')} AS yoy, trend, death_spiral, low_confidence FROM velocity"
ORACLE["year_ago_asof"] = f"WITH {POINTS}, {YEAR_AGO}\nSELECT * FROM year_ago"
ORACLE["reverse_splits"] = f"WITH {POINTS}, {SPLITS}\nSELECT cik, n_splits, serial, since_year, {r6('cumulative')} AS cumulative FROM splits"
ORACLE["registrations"] = f"WITH {FILINGS}, {REG}\nSELECT * FROM reg"
ORACLE["shelf_utilization"] = f"WITH {FUND}\nSELECT cik, fy, CASE WHEN cik % 4 <> 0 THEN {r6('cash')} END AS drawn, CASE WHEN cik % 4 <> 0 THEN {r6('revenue - cash')} END AS remaining, CASE WHEN cik % 4 <> 0 THEN {r6(d('cash', 'revenue') + ' * 100.0')} END AS pct_drawn, CASE WHEN revenue <> 0 THEN {r6(d('revenue', 'market_cap') + ' * 100.0')} END AS shelf_pct FROM f"
ORACLE["toxic_text"] = f"WITH {DOCS}\nSELECT doc_id, array_to_string({TERMS}, ';') AS terms FROM docs WHERE len({TERMS}) > 0"
_auth = "CASE WHEN cik % 5 <> 0 THEN shares_outstanding * (1 + (cik % 7) / 40.0::DOUBLE - 0.01::DOUBLE) END"
ORACLE["headroom"] = f"WITH {FUND}, h AS (SELECT cik, fy, shares_outstanding AS o, {_auth} AS a FROM f)\nSELECT cik, fy, CASE WHEN a > 0 AND o <= a THEN {r6('(a - o) / a * 100.0')} END AS pct, coalesce(a > 0 AND o <= a AND o / a >= 0.90, false) AS near_ceiling FROM h"
_more = "(cash + CASE WHEN cik % 2 = 0 THEN inventory ELSE 0 END + coalesce(goodwill, 0))"
ORACLE["overhang"] = f"WITH {FUND}\nSELECT cik, fy, {r6(f'shares_outstanding + {_more}')} AS fully_diluted, {r6(d(_more, 'CASE WHEN cik % 3 = 0 THEN revenue ELSE shares_outstanding END') + ' * 100.0')} AS pct, (cik % 2 <> 0 OR goodwill IS NULL) AS partial FROM f"
_signs = "(CAST(cik % 4 = 0 AS INT) + CAST(cik % 3 > 0 AS INT) + CAST(cik % 5 <> 0 AND cik % 10 <= 5 AS INT) + CAST(revenue < 100000 AND shares_outstanding * 10000 > 50000000 AS INT))"
ORACLE["shell_composite"] = f"WITH {FUND}\nSELECT cik, fy, {_signs}::BIGINT AS signs, {_signs} >= 2 AS shell FROM f"
ORACLE["auditor_flags"] = f"WITH {FILINGS}, {BUILT}, {tape()}\nSELECT cik, ever_401 > 0 AS changed, ever_402 > 0 AS restated, ever_401 >= 2 AS churn FROM tape"
_rules = [("coalesce(max_amount <> 0 AND market_cap <> 0 AND max_amount / market_cap * 100.0::DOUBLE > 100 AND NOT wksi, false)", 15, "DILUTION-SHELF-LARGE"), ("active_atm", 15, "ACTIVE-ATM"), ("n_toxic > 0", 20, "TOXIC-FINANCING"), ("death_spiral", 20, "DILUTION-VELOCITY-HIGH"), ("n_splits >= 2", 20, "SERIAL-SPLITTER"), ("n_splits = 1", 8, "REVERSE-SPLIT"), ("late_escalated", 15, "NT-RESTATEMENT"), ("n_late > 0 AND NOT late_escalated", 5, "NT-LATE"), ("false", 15, "SHELL-ARC"), ("ever_402 > 0", 15, "RESTATEMENT"), ("ever_401 >= 2", 10, "AUDITOR-CHURN")]
_sum = " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for t, p, _ in _rules)
_points = f"least(100, greatest(0, ({_sum}) - CASE WHEN coalesce(buying, false) THEN 10 ELSE 0 END))"
FILED = f"""filed AS (SELECT cik, doc_id, ['424B5', '8-K', 'S-1', '10-K'][doc_id % 4 + 1] AS form, DATE '2023-06-01' + (doc_id % 400)::INT AS day, CASE WHEN doc_id % 11 = 0 THEN text || ' ' || upper({lst(PROBES['delisting']['phrases'])}[doc_id % 3 + 1]) ELSE text END AS text FROM docs)"""
FOUND = f"""{VELOCITY}, {SPLITS}, {FILINGS}, {REG}, {BUILT}, {tape()}, {DOCS}, {FILED},
words AS (SELECT cik, count(*) FILTER (len({TERMS}) > 0) AS n_toxic, count(*) FILTER (form IN {qs(PROBES['delisting']['forms'])} AND day BETWEEN {EV_DAY} - 180 AND {EV_DAY} AND ({' OR '.join(f'contains(lower(text), {q(x.lower())})' for x in PROBES['delisting']['phrases'])})) AS n_language FROM filed GROUP BY 1),
dil0 AS (SELECT coalesce(velocity.cik, reg.cik) AS cik, * EXCLUDE (cik) FROM velocity FULL JOIN reg ON velocity.cik = reg.cik),
dil1 AS (SELECT * FROM dil0 LEFT JOIN splits USING (cik) LEFT JOIN tape USING (cik) LEFT JOIN words USING (cik))"""


def diluted(more: str) -> str:
    """The dilution score from ``dil1`` and what else is known of a company."""
    return f"""dil2 AS (SELECT * FROM dil1 {more}), dil AS (SELECT cik, {_points}::BIGINT AS dilution_score, CASE WHEN {_points} >= 40 THEN 'high' WHEN {_points} >= 15 THEN 'medium' WHEN {_points} > 0 THEN 'low' ELSE 'none' END AS dilution_severity, {flags(*[(t, n) for t, _, n in _rules])} AS dilution_flags, coalesce(n_splits >= 2, false) AS serial_splitter FROM dil2)"""


DILUTION = f"{FOUND}, {diluted('CROSS JOIN (SELECT NULL::DOUBLE AS market_cap, NULL::BOOLEAN AS buying)')}"
ORACLE["dilution_score"] = f"WITH {DILUTION}\nSELECT * FROM dil"
ORACLE["event_build"] = f"WITH {FILINGS}, {BUILT}\nSELECT cik, accession, array_to_string(codes, ';') AS codes, cats[list_position(sevs, list_max(sevs))] AS category, list_max(sevs) AS severity, array_to_string(list_sort(list_distinct(cats)), ';') AS categories, form LIKE '%/A' AS is_amendment FROM built"
ORACLE["event_tape_counts"] = f"WITH {FILINGS}, {BUILT}\nSELECT cik, code, count(*) AS n FROM (SELECT cik, unnest(codes) AS code FROM built) GROUP BY 1, 2"
ORACLE["recency_severity"] = f"WITH {FILINGS}, {BUILT}, x AS (SELECT *, cats[list_position(sevs, list_max(sevs))] AS category, list_max(sevs) AS severity FROM built)\nSELECT cik, category, count(*) AS n, {r6(f'sum(severity * greatest(0.0, 1 - {_age} / 180.0::DOUBLE))')} AS weighted FROM x GROUP BY 1, 2"
ORACLE["event_signals"] = f"WITH {FILINGS}, {BUILT}, {tape("DATE '2024-01-20'", 10)}\nSELECT * FROM tape"
_n = "count(*) FILTER (form = 'UPLOAD')"
_rep = "count(*) FILTER (form = 'CORRESP')"
ORACLE["comment_letters"] = f"WITH {FILINGS}, l AS (SELECT cik, {_n} AS letters, {_rep} AS replies, max(filing_date) FILTER (form = 'UPLOAD') AS latest FROM filings WHERE {_age} <= 365 GROUP BY 1)\nSELECT *, 'staff letters: ' || letters || CASE WHEN letters = 1 THEN ' letter, ' ELSE ' letters, ' END || CASE WHEN replies = 0 THEN 'no separate response' ELSE replies || ' response(s)' END || ' in 365 days; latest ' || latest AS note FROM l WHERE letters > 0"

# ---- insiders and market ----------------------------------------------------

TXN = """txn AS (SELECT l_suppkey AS cik, l_partkey % 7 AS insider, substr('PSAMFGX', l_linenumber, 1) AS code, round(l_extendedprice * 100)::BIGINT::DOUBLE AS value, l_returnflag = 'R' AS plan, l_linestatus = 'O' AS linked FROM lineitem)"""


def people(notices: str) -> str:
    """The profile of insiders with the notices of ``notices``, which gives cik and n_144."""
    return f"""{TXN}, n144 AS ({notices}), ins00 AS (SELECT cik, count(DISTINCT insider) FILTER (code = 'P') AS buyers, count(*) FILTER (code = 'P') AS n_buys, coalesce(sum(value) FILTER (code = 'P'), 0) AS bought, coalesce(sum(value) FILTER (code = 'S' AND NOT plan AND NOT linked), 0) AS sold_freely,
  coalesce(sum(value) FILTER (code = 'S' AND plan), 0) AS sold_by_plan, coalesce(sum(value) FILTER (code = 'S' AND linked AND NOT plan), 0) AS sold_after_exercise, count(*) FILTER (code IN ('A', 'M', 'F', 'G', 'C', 'J', 'D')) AS n_excluded FROM txn GROUP BY 1),
ins0 AS (SELECT coalesce(ins00.cik, n144.cik) AS cik, coalesce(COLUMNS(ins00.* EXCLUDE (cik)), 0), coalesce(n_144, 0) AS n_144 FROM ins00 FULL JOIN n144 ON ins00.cik = n144.cik),
ins1 AS (SELECT *, buyers >= 2 AS "cluster", n_144 >= 2 AS overhang, CASE WHEN buyers >= 2 AND bought > sold_freely THEN 'bullish' WHEN sold_freely > 0 OR n_144 >= 2 THEN 'bearish' ELSE 'neutral' END AS net, CASE WHEN buyers >= 3 OR bought >= 500000 THEN 'high' WHEN buyers >= 2 OR sold_freely > 0 OR n_144 >= 2 THEN 'medium' ELSE 'low' END AS confidence,
  least(100, buyers * 20 + CASE WHEN bought >= 500000 THEN 20 ELSE 0 END)::BIGINT AS conviction FROM ins0),
ins AS (SELECT *, round(CASE WHEN "cluster" THEN greatest(0.8, b) ELSE b END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END, 4)::DOUBLE AS sub_score FROM (SELECT *, CASE net WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN 0.0 ELSE 0.3 END AS b FROM ins1))"""


PEOPLE = people("SELECT NULL::BIGINT AS cik, 0::BIGINT AS n_144 WHERE false")
ORACLE["insider_profile"] = f"WITH {PEOPLE}\nSELECT * EXCLUDE (b) FROM ins"
ORACLE["ownership_conversions"] = f"""WITH {FILINGS}, o AS (SELECT cik, accession::BIGINT % 5 AS filer, form, filing_date, pos, contains(form, '13G') AS g, contains(form, '13D') AS dd, (pos % 12)::DOUBLE AS pct FROM filings WHERE contains(form, '13G') OR contains(form, '13D')),
t AS (SELECT *, dd AND NOT g AND coalesce(max(g::INT) OVER (PARTITION BY cik, filer ORDER BY filing_date, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS turned FROM o)
SELECT cik, count(*) FILTER (dd) AS n_13d, count(*) FILTER (g) AS n_13g, count(*) FILTER (pct > 5) AS n_over_5, count(DISTINCT filer) FILTER (turned) AS n_converted FROM t GROUP BY 1"""
ORACLE["form4_topk"] = f"WITH {FILINGS}, k AS (SELECT cik, accession, row_number() OVER (PARTITION BY cik ORDER BY pos) AS nth FROM filings WHERE form = '8-K' AND {_age} <= 365), c AS (SELECT * FROM k WHERE nth <= 12)\nSELECT cik, accession, nth, max(nth) OVER (PARTITION BY cik) = 12 AS cap_hit FROM c"
ORACLE["form144_notices"] = f"WITH {FILINGS}\nSELECT cik, count(*) AS n_144, max(filing_date) AS latest FROM filings WHERE form IN ('144', '144/A') GROUP BY 1"
ORACLE["accumulation"] = f"WITH {TXN}\nSELECT cik, count(*) FILTER (code = 'P' AND value > 0) AS accumulating FROM txn GROUP BY 1"


def norm(c: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(trim(upper(regexp_replace({c}, '[^A-Za-z0-9 ]', ' ', 'g'))), '\\s+'), lambda x: x <> '' AND x NOT IN {qs(LEGAL_SUFFIXES)}), ' ')"


SUSP = f"""{COMPANY}, susp AS (SELECT name || ', Inc.' AS company, strftime({DAY} - (cik % 400)::INT, '%Y-%m-%d') AS date, cik % 400 AS age FROM company WHERE cik % 12 = 0),
held AS (SELECT {norm('company')} AS norm, count(*) AS n_listed, max(date) AS latest, bool_or(age BETWEEN 0 AND 180) AS suspended FROM susp GROUP BY 1),
halted AS (SELECT cik, name, coalesce(n_listed, 0) AS n_listed, latest, coalesce(suspended, false) AS suspended FROM company LEFT JOIN held ON {norm('name')} = norm)"""
ORACLE["suspension_match"] = f"WITH {SUSP}\nSELECT *, NULL::VARCHAR AS note FROM halted"
ORACLE["suspension_parse"] = f"WITH {SUSP}\nSELECT company, date, '34-' || replace(date, '-', '') AS release FROM susp"


def delist(notice: str, price: str, language: str, concern: str, split: str, disclosed: str) -> tuple[str, str, str]:
    n, low, tiny = f"coalesce({notice}, false)", f"coalesce({price} < 1.0, false)", f"coalesce({price} <= 0.10, false)"
    rules = [(tiny, 3, "PRICE-SUB-10C"), (f"{low} AND NOT {tiny}", 1, "PRICE-SUB-1"), (n, 2, "DELISTING-DEFICIENCY"), (f"{language} AND NOT {n}", 1, "DELISTING-LANGUAGE"), (concern, 1, "GOING-CONCERN"), (f"coalesce({split}, false) AND ({n} OR {low})", 4, "REVERSE-SPLIT-SECONDARY-DEFICIENCY"), (disclosed, 4, "DELISTING-DETERMINATION")]
    rank = "greatest(" + ", ".join(f"CASE WHEN {t} THEN {r} ELSE 0 END" for t, r, _ in rules) + ")"
    return f"{lst(TIERS)}[{rank} + 1]", tiny, flags(*[(t, f) for t, _, f in rules])


_tier, _tiny, _dflags = delist("cik % 4 = 0", "CASE WHEN cik % 9 <> 0 THEN price END", "cik % 5 = 0", "cik % 6 = 0", "cik % 7 = 0", "cik % 31 = 0")
ORACLE["delisting_tier"] = f"WITH {COMPANY}\nSELECT cik, {_tier} AS tier, {_tier} = 'determination' AS hard_exclude, {_tiny} AS extreme, {_dflags} AS flags FROM company"
FAILS = "fails AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 5, '0') AS symbol, strftime(l_shipdate, '%Y%m%d') AS settlement_date, round(l_quantity)::DOUBLE AS quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, round(l_extendedprice * 100)::BIGINT, l_quantity, l_orderkey, l_linenumber) AS line_no, round(l_extendedprice, 2) AS price FROM lineitem)"
ORACLE["ftd_stress"] = f"WITH {FAILS}\nSELECT symbol, count(DISTINCT settlement_date) AS n_dates, sum(quantity) AS total_fails, first(quantity ORDER BY settlement_date DESC, line_no) AS latest_fails, count(DISTINCT settlement_date) >= 2 AS persistent FROM fails GROUP BY 1"
ORACLE["ftd_parse"] = f"WITH {FAILS}\nSELECT * FROM fails"
_ms = "(CASE " + tier_of_float("fs")[5:-4] + " END)"
_mrules = [("cik % 6 >= 3 OR cik % 7 = 0", 20, "PROMOTIONAL-FILING-PATTERN"), ("cik % 3 = 0", 20, "TOXIC-FINANCING"), ("cik % 4 = 0", 15, "SERIAL-SPLITTER"), ("cik % 2 = 0 AND coalesce(rv < 100000, true) AND cik % 11 <> 0", 15, "NO-FUNDAMENTAL-BASIS")]
_mscore = f"least(100, CASE {_ms} WHEN 'material' THEN 25 WHEN 'notorious' THEN 18 WHEN 'caution' THEN 10 ELSE 0 END + " + " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for t, p, _ in _mrules) + ")"
ORACLE["manipulation_score"] = f"WITH {FUND}, m AS (SELECT cik, fy, CASE WHEN cik % 5 <> 0 THEN shares_outstanding * 2000 END AS fs, CASE WHEN cik % 8 <> 0 THEN revenue / 100 END AS rv FROM f)\nSELECT cik, fy, {_mscore}::BIGINT AS score, CASE WHEN {_mscore} >= 40 THEN 'high' WHEN {_mscore} >= 15 THEN 'medium' WHEN {_mscore} > 0 THEN 'low' ELSE 'none' END AS severity, {_ms} AS tier, {flags((f'{_ms} IS NOT NULL', 'LOW-FLOAT'), *[(t, n) for t, _, n in _mrules])} AS flags FROM m"
ORACLE["fts_probe"] = "SELECT doc_id, array_to_string(list_filter(['license', 'copyright'], lambda x: contains(lower(text), x)), ';') AS hits FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')"

# ---- scores -----------------------------------------------------------------

_within = f"coalesce({DAY} - CAST(last_split AS DATE) <= 365, false)"
_t2, _, _df2 = delist("has_delisting_notice", "price", "coalesce(n_language > 0, false)", "false", _within, "false")
_has = lambda name: f"coalesce(list_contains(string_split(up_flags, ';'), {q(name)}), false)"
YEARS = f"""{PERIODS},
pt AS (SELECT pf.*, f.market_cap, f.operating_lease_expense, f.pension_expense FROM pf LEFT JOIN f USING (cik, "end")),
pp AS (SELECT cik, rank, pt AS t, lag(pt) OVER (PARTITION BY cik ORDER BY "end") AS t1, count(*) OVER (PARTITION BY cik) AS n FROM pt)"""
SIGNALS = f"""{YEARS}, {FOUND}, {people("SELECT cik, count(*) AS n_144 FROM filings WHERE form IN ('144', '144/A') GROUP BY 1")}, {SUSP},
fun AS (SELECT cik, {EVS} AS ev_sales, {GROWTH} AS revenue_growth, ({PIOTROSKI})::DOUBLE AS piotroski, {Z} AS altman_z, {M} AS beneish_m, {FIN} AS out_of_model, {flags(*UP)} AS up_flags, {d('t.sbc', 't.revenue')} AS sbc_revenue, t.market_cap AS market_cap FROM pp JOIN company USING (cik) WHERE rank = 1),
{diluted("""LEFT JOIN (SELECT cik, market_cap FROM fun) USING (cik) LEFT JOIN (SELECT cik, "cluster" AND net = 'bullish' AS buying FROM ins) USING (cik)""")},
sig0 AS (SELECT company.*, fun.* EXCLUDE (cik), dil.* EXCLUDE (cik), halted.suspended, ins.net AS insider_net, ins."cluster" AS insider_cluster, ins.confidence AS insider_confidence, ins.overhang AS insider_overhang, ins.sub_score AS pos_insider, tape.has_delisting_notice, splits.last_split, words.n_language
  FROM company LEFT JOIN fun USING (cik) LEFT JOIN dil USING (cik) LEFT JOIN halted USING (cik) LEFT JOIN ins USING (cik) LEFT JOIN tape USING (cik) LEFT JOIN splits USING (cik) LEFT JOIN words USING (cik)),
sig AS (SELECT *, {_t2} AS delisting_tier, {_df2} AS delisting_flags FROM sig0),
pos AS (SELECT *, round({clamp('(10.0 - ev_sales) / 9.0')}, 4) AS pos_valuation, round({clamp('(revenue_growth + 0.20) / 0.60')}, 4) AS pos_growth, round({clamp('piotroski / 9.0')}, 4) AS pos_fundamental_momentum, NULL::DOUBLE AS pos_sentiment, {health('altman_z')} AS pos_fin_health,
  CASE dilution_severity WHEN 'low' THEN 0.34 WHEN 'medium' THEN 0.67 WHEN 'high' THEN 1.0 END::DOUBLE AS pen_dilution, NULL::DOUBLE AS pen_manipulation, CASE delisting_tier WHEN 'watch' THEN 0.25 WHEN 'deficiency' THEN 0.5 WHEN 'imminent' THEN 0.75 WHEN 'determination' THEN 1.0 END::DOUBLE AS pen_delisting,
  CASE WHEN suspended THEN 1.0 END::DOUBLE AS pen_halt_suspension, CASE WHEN insider_net = 'bearish' OR insider_overhang THEN least(1.0::DOUBLE, CASE WHEN insider_net = 'bearish' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN insider_overhang THEN 0.2::DOUBLE ELSE 0 END) * CASE insider_confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END END::DOUBLE AS pen_insider_selling,
  CASE WHEN altman_z < -3 THEN CASE WHEN out_of_model THEN 0.5 ELSE 1.0 END END::DOUBLE AS pen_distress, CASE WHEN altman_z BETWEEN -3 AND 1 THEN CASE WHEN out_of_model THEN 0.25 ELSE 0.5 END END::DOUBLE AS pen_solvency_watch,
  CASE WHEN beneish_m > -1.78 THEN least(1.0, 0.5 + 0.3 * (beneish_m + 1.78)) * CASE WHEN out_of_model THEN 0.5 ELSE 1.0 END END AS pen_beneish, CASE WHEN {_has('goodwill-impairment')} THEN 0.7 END::DOUBLE AS pen_goodwill_impairment, NULL::DOUBLE AS pen_multiple_compression,
  nullif(0.4 * ({_has('high-leverage')}::INT + {_has('weak-interest-coverage')}::INT), 0)::DOUBLE AS pen_leverage_coverage, CASE WHEN {_has('high-sbc-dilution')} THEN least(1.0, sbc_revenue / 0.20) END AS pen_sbc_dilution FROM sig)"""


def composed(profile: str = "hold", preset: str = "penny", name: str = "sc") -> str:
    """Contributions of one profile and preset as a table after ``pos``."""
    own, mags, weights = PRESETS[preset], PROFILES[profile]["penalties"], PROFILES[profile]["weights"]
    subs, off = {}, []
    for m, (mk, pk) in MODULES.items():
        w = own.get(pk, 1.0) if pk else 1.0
        if pk and w == 0:
            off.append(m)
            subs[m] = "NULL::DOUBLE"
        else:
            subs[m] = f"{(mags.get(mk, 1.0) if mk else 1.0) * w}::DOUBLE * pen_{m}"
    adds = {k: f"{weights[k]}::DOUBLE * coalesce(pos_{k}, 0)" for k in POSITIVES}
    less = " + ".join(f"coalesce({x}, 0)" for x in subs.values())
    plus = " + ".join(adds.values())
    names = "list_sort(list_filter([" + ", ".join(f"CASE WHEN ({x}) IS NOT NULL THEN {q(m)} END" for m, x in subs.items()) + "], lambda x: x IS NOT NULL))"
    na = flags(*[(f"pen_{m} IS NOT NULL", m) for m in off]) if off else "''"
    gone = flags(("revenue_growth IS NULL", "growth"), ("piotroski IS NULL", "fundamental_momentum"), ("altman_z IS NULL", "fin_health"), ("altman_z IS NULL", "distress"), ("beneish_m IS NULL", "beneish"), ("dilution_severity IS NULL", "dilution"), ("delisting_tier IS NULL", "delisting"), ("suspended IS NULL", "halt_suspension"))
    gate = flags(("suspended", GATE_REASONS[0]), ("delisting_tier = 'determination'", GATE_REASONS[1]))
    return f"{name} AS (SELECT *, " + ", ".join(f"{x} AS add_{k}" for k, x in adds.items()) + ", " + ", ".join(f"{x} AS sub_{m}" for m, x in subs.items()) + f", {less} AS penalty_total, ({plus}) - ({less}) AS composite, {names} AS flag_list, {na} AS na_modules, {gone} AS suppressed, {gate} AS gate_reasons, ({gate}) <> '' AS gated FROM pos)"


def score(columns: str, profile: str = "hold", preset: str = "penny", more: str = "") -> str:
    return f"WITH {SIGNALS}, {composed(profile, preset)}\nSELECT {columns} FROM sc {more}"


_rank = "row_number() OVER (PARTITION BY gated ORDER BY composite DESC, ticker)"
_srank = "CASE WHEN NOT gated THEN row_number() OVER (PARTITION BY gated, sic_sector ORDER BY composite DESC, ticker)::DOUBLE END AS sector_rank"
_ssize = "CASE WHEN NOT gated THEN count(*) OVER (PARTITION BY gated, sic_sector)::DOUBLE END AS sector_size"
_flags = "array_to_string(flag_list, ';') AS penalty_flags"
_nsup = "CASE WHEN suppressed = '' THEN 0 ELSE len(string_split(suppressed, ';')) END"
_crit = f"list_has_any(flag_list, {lst(CRITICAL)})"
ORACLE["flagship_scan"] = score(f"ticker, sic_sector, gated, {_rank} AS rank, {_srank}, {_ssize}, {r6('composite')} AS composite, {_flags}, suppressed")
ORACLE["subscores"] = score("ticker, " + ", ".join(f"pos_{k}" for k in POSITIVES))
ORACLE["penalty_severities"] = score("ticker, " + ", ".join(f"{r6(f'pen_{m}')} AS pen_{m}" for m in MODULES))


def _many(pairs: list[tuple[str, str]]) -> str:
    names = [f"sc{i}" for i in range(len(pairs))]
    return f"WITH {SIGNALS}, " + ", ".join(composed(p, s, n) for (p, s), n in zip(pairs, names, strict=True)) + "\n" + " UNION ALL ".join(f"SELECT ticker, {q(p)} AS profile, {q(s)} AS preset, {r6('composite')} AS composite, na_modules FROM {n}" for (p, s), n in zip(pairs, names, strict=True))


ORACLE["composite_profiles"] = _many([(p, "penny") for p in PROFILES])
ORACLE["composite_presets"] = _many([("hold", p) for p in PRESETS])
ORACLE["gates"] = score("ticker, gated, gate_reasons")
ORACLE["suppressed_modules"] = score(f"ticker, suppressed, {_nsup}::BIGINT AS n")
ORACLE["evidence_gate"] = f"WITH {SIGNALS}\nSELECT ticker, cik % 6 <> 0 AND (altman_z IS NOT NULL OR revenue_growth IS NOT NULL OR dilution_severity IS NOT NULL OR delisting_tier IS NOT NULL OR suspended IS NOT NULL OR insider_net IS NOT NULL) AS assessed FROM sig"
ORACLE["scan_filters"] = f"WITH {SIGNALS}\nSELECT ticker, CASE WHEN coalesce(serial_splitter, false) THEN 'serial reverse splitter' ELSE 'no recent insider buying' END AS reason FROM sig WHERE coalesce(serial_splitter, false) OR NOT coalesce(insider_cluster, false)"
ORACLE["exclude_flagged"] = score("ticker, 'critical flag' AS reason", more=f"WHERE gated OR {_crit}")
ORACLE["rank_global"] = score(f"ticker, gated, {_rank} AS rank", "trader")
ORACLE["rank_sector"] = score(f"ticker, sic_sector, {_srank}, {_ssize}", "high-return")
for _name, _key in (("sort_growth", "add_growth"), ("sort_valuation", "add_valuation"), ("sort_sentiment", "add_sentiment"), ("sort_risk", "-penalty_total"), ("top_n", "composite")):
    ORACLE[_name] = score(f"ticker, {r6(_key)} AS key", more=f"WHERE NOT gated ORDER BY {_key} DESC, ticker" + (" LIMIT 20" if _name == "top_n" else ""))
ORACLE["full_union"] = score("ticker, CASE WHEN gated THEN 'high-risk' ELSE 'ranked' END AS section")
ORACLE["sector_size_pct"] = f"""WITH {FUND}, {COMPANY}, g AS (SELECT cik, fy, sic_sector, {bucket('market_cap')} AS bucket, floor(ebit / 10000)::BIGINT AS v FROM f JOIN company USING (cik)),
k AS (SELECT *, (rank() OVER (PARTITION BY sic_sector, bucket ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY sic_sector, bucket, v) - 1) / 2.0::DOUBLE) / count(v) OVER (PARTITION BY sic_sector, bucket) AS x FROM g)
SELECT cik, fy, bucket, CASE WHEN v IS NOT NULL THEN {r6('x')} END AS pct, CASE WHEN v IS NOT NULL THEN {r6('least(1, greatest(0, x))')} END AS sub_score FROM k"""
ORACLE["export_records"] = score(f"ticker, round(composite, 4) AS composite, gated, {_srank}, {_flags}, na_modules, {_nsup}::BIGINT AS suppressed_count, suppressed = '' AS evidence_complete, len(flag_list)::BIGINT AS n_penalties, round({' + '.join(f'round(add_{k}, 4)' for k in POSITIVES)}, 3) AS positive", "hold", "broad")
_known = "(altman_z IS NOT NULL OR revenue_growth IS NOT NULL OR dilution_severity IS NOT NULL OR delisting_tier IS NOT NULL OR suspended IS NOT NULL OR insider_net IS NOT NULL)"
ORACLE["scan_counts"] = f"""WITH {SIGNALS}, {composed("hold", "penny")},
told AS (SELECT *, CASE WHEN NOT {_known} THEN 'not assessed' WHEN coalesce(serial_splitter, false) THEN 'serial reverse splitter' END AS reason FROM sc),
kept AS (SELECT * FROM told WHERE reason IS NULL)
SELECT 'universe_counts' AS kind, unnest(['scanned', 'ranked', 'gated', 'evidence_complete', 'excluded', 'failed']) AS name,
  unnest([count(*), count(*) FILTER (reason IS NULL), count(*) FILTER (reason IS NULL AND gated), count(*) FILTER (reason IS NULL AND suppressed = ''), count(reason), 0]) AS n FROM told
UNION ALL SELECT 'excluded_by_reason', reason, count(*) FROM told WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'suppressed_by_module', m, count(*) FROM (SELECT unnest(string_split(suppressed, ';')) AS m FROM kept WHERE suppressed <> '') GROUP BY 2"""
_un = f"CASE WHEN {_nsup} > 0 THEN ' ~' || {_nsup} || ' unchecked' ELSE '' END"
ORACLE["flag_glyph"] = score(f"ticker, CASE WHEN gated THEN '[X] excluded: ' || replace(gate_reasons, ';', '; ') WHEN {_crit} THEN '[X] ' || array_to_string(flag_list, ', ') || {_un} WHEN len(flag_list) > 0 THEN '[!] ' || array_to_string(flag_list, ', ') || {_un} ELSE '-' || {_un} END AS glyph")
ORACLE["watch_semi"] = score(f"ticker, {r6('composite')} AS composite", more="WHERE cik % 3 = 0")
_split = lambda c: f"(CASE WHEN coalesce({c}, '') = '' THEN [] ELSE string_split({c}, ';') END)"
ORACLE["snapshot_flags"] = score(f"ticker, array_to_string(list_filter(flag_list || {_split('gate_reasons')} || list_sort(list_distinct({_split('dilution_flags')} || {_split('delisting_flags')})), lambda x: x IS NOT NULL), ';') AS flags")

# ---- watchlist and payloads -------------------------------------------------

SNAPS = """snaps AS (SELECT user_id::VARCHAR AS ticker, strftime(ts, '%Y-%m-%d') AS scanned_at, ((sum(round(value * 100)::BIGINT) % 600 + 600) % 600) / 100.0::DOUBLE - 3.8::DOUBLE AS score,
  list_sort(list(DISTINCT CASE event_type WHEN 'click' THEN 'ACTIVE-ATM' WHEN 'view' THEN 'OVERHANG-HIGH' WHEN 'purchase' THEN 'RESTATEMENT' WHEN 'signup' THEN 'SHELL-ARC' WHEN 'error' THEN 'SERIAL-SPLITTER' END)) AS flags FROM events GROUP BY 1, 2),
prior AS (SELECT *, lag(score) OVER w AS s0, lag(flags) OVER w AS f0 FROM snaps WINDOW w AS (PARTITION BY ticker ORDER BY scanned_at)),
diffs AS (SELECT *, score - s0 AS delta, CASE WHEN f0 IS NULL THEN [] ELSE list_filter(flags, lambda x: NOT list_contains(f0, x)) END AS new_flags, CASE WHEN f0 IS NULL THEN [] ELSE list_filter(f0, lambda x: NOT list_contains(flags, x)) END AS cleared FROM prior)"""
_mat = f"list_filter(new_flags, lambda x: x IN {qs(MATERIAL_FLAGS + GATE_REASONS)})"
ORACLE["snapshot_diff"] = f"WITH {SNAPS}\nSELECT ticker, scanned_at, {r6('score')} AS score, {r6('delta')} AS delta, array_to_string(new_flags, ';') AS new_flags, array_to_string(cleared, ';') AS cleared_flags FROM diffs"
ORACLE["export_csv"] = f"WITH {SNAPS}\nSELECT ticker, scanned_at, {r6('score')} AS score, array_to_string(flags, ';') AS flags FROM snaps"
ORACLE["snapshot_stream"] = ORACLE["snapshot_diff"]
ORACLE["snapshot_store"] = f"WITH {SNAPS}\nSELECT ticker, scanned_at, {r6('score')} AS score, array_to_string(flags, ';') AS flags FROM snaps"
ORACLE["watch_alerts"] = f"WITH {SNAPS}\nSELECT ticker, scanned_at, len({_mat})::BIGINT AS n_new, coalesce(delta <= -2.0, false) AS fell FROM diffs WHERE len({_mat}) > 0 OR delta <= -2.0"
ORACLE["latest_two"] = f"WITH {SNAPS}, k AS (SELECT ticker, scanned_at, row_number() OVER (PARTITION BY ticker ORDER BY scanned_at DESC) AS nth, array_to_string(flags, ';') AS flags FROM snaps)\nSELECT * FROM k WHERE nth <= 2"
ORACLE["universe_lookup"] = f"WITH {COMPANY}\nSELECT ticker, lpad(cik::VARCHAR, 10, '0') AS cik, 'OTC' AS exchange, name FROM company"
ORACLE["companyfacts_json"] = f"WITH {FUND}\nSELECT lpad(cik::VARCHAR, 10, '0') AS cik, 'Revenues' AS tag, 'USD' AS unit, \"end\", {r6('revenue')} AS val FROM f"
ORACLE["companyfacts_archive"] = f"WITH {FUND}\nSELECT lpad(cik::VARCHAR, 10, '0') AS cik, 'Revenues' AS tag, 'USD' AS unit, \"end\", {r6('revenue')} AS val, NULL AS failure FROM f WHERE cik % 4 <> 0 UNION ALL SELECT DISTINCT lpad(cik::VARCHAR, 10, '0'), NULL, NULL, NULL, NULL::DOUBLE, 'unreadable payload' FROM f WHERE cik % 4 = 0"
ORACLE["submissions_json"] = f"WITH {FILINGS}\nSELECT lpad(cik::VARCHAR, 10, '0') AS cik, pos, form, filing_date, accession, CASE WHEN pos < 3 THEN array_to_string(codes, ',') ELSE '' END AS items, 3674::BIGINT AS sic, '3674' AS sic_sector FROM filings"
ORACLE["form4_xml"] = f"WITH {TXN}\nSELECT cik, 'P' || insider AS insider, code, plan AS is_10b5_1, 2 * count(*) AS n, sum(value) * 20 AS value FROM txn GROUP BY 1, 2, 3, 4"

# ---- evidence ---------------------------------------------------------------

ORACLE["candidates"] = f"WITH {COMPANY}\nSELECT ticker, least(3 * cik + 2, 5 * cik) AS pos FROM company"
ORACLE["ticker_cik"] = f"WITH {COMPANY}\nSELECT ticker, CASE WHEN cik % 5 = 0 THEN '9' || cik WHEN cik % 7 <> 0 THEN lpad(cik::VARCHAR, 10, '0') END AS cik FROM company"


def lacking(p: str) -> str:
    return flags(*[(f"{p}.{c} IS NULL", c) for c in CORE_INPUTS])


def year_notes(n: str, p: str) -> str:
    line = f"CASE WHEN {n} > 0 AND {lacking(p)} <> '' THEN 'core inputs unavailable for ' || {p}.\"end\" || ': ' || replace({lacking(p)}, ';', ', ') || ' (dependent metrics suppressed)' END"
    return f"[CASE {n} WHEN 0 THEN 'fundamentals suppressed (no annual 10-K period in companyfacts)' WHEN 1 THEN 'fundamentals limited to one annual period (prior year unavailable)' END, {line}]"


ORACLE["core_inputs_note"] = f"WITH {FUND}\nSELECT cik, fy, {lacking('f')} AS missing FROM f"
NEWEST = "newest AS (SELECT cik, count(*) AS n, max_by(f, fy) AS t FROM f GROUP BY 1)"
ORACLE["completeness_notes"] = f"""WITH {FUND}, {COMPANY}, {NEWEST}, k AS (SELECT ticker, cik, price, t, CASE cik % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE coalesce(n, 0) END AS n FROM company LEFT JOIN newest USING (cik))
SELECT ticker, CASE WHEN cik % 7 = 0 THEN 'degraded: no CIK' ELSE array_to_string(list_filter({year_notes('n', 't')} || [CASE WHEN price = 0 THEN 'price unavailable' END], lambda x: x IS NOT NULL), ';') END AS notes FROM k"""
ORACLE["freshness"] = f"""WITH {FUND}, e AS (SELECT cik, max("end") AS e FROM f GROUP BY 1),
s AS (SELECT max_by(e, cik) FILTER (cik % 3 <> 0) AS period, coalesce(max_by(e || '+60', cik) FILTER (cik % 4 <> 0), 'n/a') AS filed, bool_or(cik % 8 = 0) AS held FROM e)
SELECT 'filings/news' AS domain, 'filings/news: 2024-01-31 00:00 UTC — EDGAR updates continuously' AS line
UNION ALL SELECT 'financials', 'financials: latest filed ' || period || ' (filed ' || filed || ') — the newest 10-K/10-Q the company has reported' FROM s WHERE period IS NOT NULL
UNION ALL SELECT 'institutional (13F)', 'institutional (13F): latest filed — 13F institutional holdings are quarterly and lagged (~45 days after quarter-end).' FROM s WHERE held"""
_flat = lambda x: f"' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_says = lambda *ps: "(" + " OR ".join(f"contains(low, ' {p} ')" for p in ps) + ")"
ORACLE["phrase_search"] = f"""WITH {DOCS}, filed AS (SELECT cik, doc_id, ['424B5', '8-K', 'S-1', '10-K'][doc_id % 4 + 1] AS form, strftime(DATE '2023-06-01' + (doc_id % 400)::INT, '%Y-%m-%d') AS filing_date,
  {_flat("CASE WHEN doc_id % 11 = 0 THEN text || ' ' || " + lst(PROBES['delisting']['phrases']) + "[doc_id % 3 + 1] ELSE text END")} AS low FROM docs)
SELECT search, doc_id, cik, form, filing_date FROM filed, (VALUES ('toxic'), ('listing'), ('of-one'), ('word')) AS v(search)
WHERE CASE search WHEN 'toxic' THEN {_says('beneficial ownership limitation', 'death spiral')} WHEN 'listing' THEN {_says('regain compliance', 'minimum bid price', 'listing qualifications')} AND form IN ('8-K', 'S-1') AND filing_date BETWEEN '2023-08-01' AND '2024-01-31'
  WHEN 'of-one' THEN {_says('the', 'warrant coverage')} AND cik = 7 ELSE {_says('license')} AND form = '10-K' END"""
_probed = " UNION ALL ".join(f"SELECT cik, {q(name)} AS probe, count(*) AS n_hits FROM filed WHERE form IN {qs(p['forms'])} AND ({' OR '.join(f'contains(low, {q(x.lower())})' for x in p['phrases'])}) GROUP BY 1" for name, p in PROBES.items())
ORACLE["stock_probes"] = f"""WITH {DOCS}, filed AS (SELECT cik, ['424B5', '8-K', 'S-1', '10-K'][doc_id % 4 + 1] AS form, lower(CASE WHEN doc_id % 11 = 0 THEN text || ' ' || {lst(PROBES['delisting']['phrases'])}[doc_id % 3 + 1] ELSE text END) AS low FROM docs WHERE DATE '2023-06-01' + (doc_id % 400)::INT BETWEEN DATE '2023-08-01' AND {EV_DAY})
{_probed}"""
ORACLE["provider_cascade"] = f"WITH {COMPANY}\nSELECT ticker, CASE WHEN cik % 2 = 0 THEN 'first' WHEN cik % 3 <> 0 THEN 'second' END AS provider, CASE WHEN cik % 2 <> 0 AND cik % 3 = 0 THEN 'no answer from first, second' END AS failure, CASE WHEN cik % 2 = 0 THEN price WHEN cik % 3 <> 0 THEN price + 1 END AS price FROM company"
ORACLE["failure_isolation"] = f"WITH {COMPANY}\nSELECT ticker, CASE WHEN cik % 4 <> 0 THEN cik END AS cik, CASE WHEN cik % 4 = 0 THEN 'unreadable payload' END AS failure FROM company"
ORACLE["watch_order"] = f"WITH {COMPANY}\nSELECT ticker, strftime(DATE '2024-01-01' + (cik % 30)::INT, '%Y-%m-%d') AS added_at FROM company ORDER BY added_at, ticker"
ORACLE["export_full"] = f"WITH {SIGNALS}, {composed()}, newest AS (SELECT cik, n, t FROM pp WHERE rank = 1)\nSELECT ticker, round(composite, 4) AS composite, sic_sector, {_ssize}, gated, gate_reasons, suppressed, array_to_string(list_filter({year_notes('coalesce(newest.n, 0)', 'newest.t')}, lambda x: x IS NOT NULL), ';') AS completeness, 1::BIGINT AS n_notes, round(coalesce(sub_dilution, 0), 4) AS dilution_penalty FROM sc LEFT JOIN newest USING (cik)"
