"""Forensic models as column builders over periods.

``t``, ``t1`` and ``t2`` are structs of line items of a fiscal year and the two before it. Each builder
returns named columns; a model whose inputs are incomplete has a null value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import absent, clamp, count_true, listed, mean2, nonzero, ratio

Columns = dict[str, Column]

#: Least EM score (Z'' + 3.25) of each rating, with the risk that it stands for.
RATINGS = [
    (8.15, "AAA", "minimal"), (7.60, "AA", "minimal"), (7.00, "AA-", "low"), (6.40, "A", "low"), (5.85, "BBB", "moderate"),
    (5.65, "BBB-", "moderate"), (5.25, "BB+", "speculative"), (4.95, "BB", "speculative"), (4.50, "B+", "high"), (4.15, "B", "high"),
    (3.75, "B-", "high"), (3.20, "CCC+", "distressed"), (2.50, "CCC", "distressed"), (1.75, "CCC-", "distressed"),
]
#: Zone cut-offs of Z''.
DISTRESS_BELOW, SAFE_ABOVE = -3.0, 1.0


def altman(t: Column) -> Columns:
    """Z'' of non-manufacturers, with its applicability gate: a firm with much equity but losses on every
    other term is not one that the model can rate."""
    ta, tl = nonzero(t["total_assets"]), nonzero(t["total_liabilities"])
    x1, x2 = ratio(t["current_assets"] - t["current_liabilities"], ta), ratio(t["retained_earnings"], ta)
    x3, x4 = ratio(t["ebit"], ta), ratio(t["book_equity"], tl)
    z = 6.56 * x1 + 3.26 * x2 + 6.72 * x3 + 1.05 * x4
    gated = F.coalesce((x4 > 4.0) & (x2 < 0) & (x3 <= 0) & (z - 1.05 * x4 >= -3.0), F.lit(False))
    value = F.when(~gated, z)
    need = ["current_assets", "current_liabilities", "retained_earnings", "ebit", "book_equity", "total_assets", "total_liabilities"]
    gaps = absent([(n, t[n]) for n in need])
    return {"value": value, "x1": x1, "x2": x2, "x3": x3, "x4": x4, "gated": gated, "missing": F.when(gated, F.array(F.lit("applicability:X4_BE_TL"))).otherwise(gaps)}


def zone(z: Column) -> Column:
    return F.when(z < DISTRESS_BELOW, "distress").when(z > SAFE_ABOVE, "safe").when(z.isNotNull(), "grey")


def rating(z: Column) -> Columns:
    """Bond rating equivalent and risk word."""
    ems = z + 3.25
    name, risk = F.when(ems.isNull(), None), F.when(ems.isNull(), None)
    for least, grade, word in RATINGS:
        name, risk = name.when(ems >= least, grade), risk.when(ems >= least, word)
    return {"ems": ems, "grade": name.otherwise("D"), "risk": risk.otherwise("default")}


def gross_margin(t: Column) -> Column:
    return ratio(t["revenue"] - t["cogs"], t["revenue"])


def beneish(t: Column, t1: Column) -> Columns:
    """M-score of eight indices; flagged above -1.78."""
    soft = lambda p: 1 - ratio(p["current_assets"] + p["net_ppe"], p["total_assets"])
    worn = lambda p: ratio(p["depreciation"], p["depreciation"] + p["net_ppe"])
    owed = lambda p: ratio(p["current_liabilities"] + p["long_term_debt"], p["total_assets"])
    part = lambda p, n: ratio(p[n], p["revenue"])
    index = {
        "dsri": ratio(part(t, "receivables"), part(t1, "receivables")),
        "gmi": ratio(gross_margin(t1), gross_margin(t)),
        "aqi": ratio(soft(t), soft(t1)),
        "sgi": ratio(t["revenue"], t1["revenue"]),
        "depi": ratio(worn(t1), worn(t)),
        "sgai": ratio(part(t, "sga"), part(t1, "sga")),
        "lvgi": ratio(owed(t), owed(t1)),
        "tata": ratio(t["net_income"] - t["operating_cash_flow"], t["total_assets"]),
    }
    m = -4.84 + 0.920 * index["dsri"] + 0.528 * index["gmi"] + 0.404 * index["aqi"] + 0.892 * index["sgi"] + 0.115 * index["depi"] - 0.172 * index["sgai"] + 4.679 * index["tata"] - 0.327 * index["lvgi"]
    return {"value": m, **index, "flagged": m > -1.78, "missing": absent(index.items())}


def debt(t: Column) -> Column:
    return F.coalesce(t["total_debt"], t["long_term_debt"])


def operating_assets(t: Column) -> Column:
    """Net operating assets: assets without cash, less liabilities without debt."""
    return (t["total_assets"] - t["cash"]) - (t["total_liabilities"] - debt(t))


def dechow(t: Column, t1: Column, t2: Column, issuance: Column) -> Columns:
    """F-score: probability of a misstatement over its unconditional rate."""
    avg, avg1 = mean2(t["total_assets"], t1["total_assets"]), mean2(t1["total_assets"], t2["total_assets"])
    rsst = ratio(operating_assets(t) - operating_assets(t1), avg)
    d_rec, d_inv = ratio(t["receivables"] - t1["receivables"], avg), ratio(t["inventory"] - t1["inventory"], avg)
    soft = ratio(t["total_assets"] - t["net_ppe"] - t["cash"], t["total_assets"])
    sales, sales1 = t["revenue"] - (t["receivables"] - t1["receivables"]), t1["revenue"] - (t1["receivables"] - t2["receivables"])
    d_cash = ratio(sales - sales1, sales1)
    d_roa = ratio(t["net_income"], avg) - ratio(t1["net_income"], avg1)
    logit = -7.893 + 0.790 * rsst + 2.518 * d_rec + 1.191 * d_inv + 1.979 * soft + 0.171 * d_cash - 0.932 * d_roa + 1.029 * issuance.cast("int")
    f = F.exp(logit) / (1 + F.exp(logit)) / 0.0037
    level = F.when(f > 2.45, "misstatement-risk-high").when(f > 1.85, "misstatement-risk-substantial").when(f > 1.0, "misstatement-risk-above-normal")
    return {"value": f, "logit": logit, "level": level}


def montier(t: Column, t1: Column) -> Column:
    """C-score: six signs of embellishment, 0 to 6."""
    part = lambda p, a, b: ratio(p[a], p[b])
    return count_true(
        (t["net_income"] - t["operating_cash_flow"]) > (t1["net_income"] - t1["operating_cash_flow"]),
        part(t, "receivables", "revenue") > part(t1, "receivables", "revenue"),
        part(t, "inventory", "cogs") > part(t1, "inventory", "cogs"),
        part(t, "current_assets", "revenue") > part(t1, "current_assets", "revenue"),
        part(t, "depreciation", "gross_ppe") < part(t1, "depreciation", "gross_ppe"),
        ratio(t["total_assets"] - t1["total_assets"], t1["total_assets"]) > 0.10,
    )


def piotroski(t: Column, t1: Column) -> Columns:
    """F-score of strength, 0 to 9."""
    part = lambda p, a, b: ratio(p[a], p[b])
    score = count_true(
        t["net_income"] > 0,
        t["operating_cash_flow"] > 0,
        part(t, "net_income", "total_assets") > part(t1, "net_income", "total_assets"),
        t["operating_cash_flow"] > t["net_income"],
        part(t, "long_term_debt", "total_assets") < part(t1, "long_term_debt", "total_assets"),
        part(t, "current_assets", "current_liabilities") > part(t1, "current_assets", "current_liabilities"),
        t["shares_outstanding"] <= t1["shares_outstanding"],
        gross_margin(t) > gross_margin(t1),
        part(t, "revenue", "total_assets") > part(t1, "revenue", "total_assets"),
    )
    return {"value": score, "flags": F.when(score.isNotNull(), F.concat(F.array(F.lit("value-universe-signal")), listed((score >= 7, "strong"), (score <= 2, "weak"))))}


def accruals(t: Column, t1: Column) -> Columns:
    gap = t["net_income"] - t["operating_cash_flow"]
    avg = mean2(t["total_assets"], t1["total_assets"])
    working = lambda p: (p["current_assets"] - p["cash"]) - p["current_liabilities"]
    value = ratio(gap, t["total_assets"])
    return {"value": value, "sloan_cash_flow": ratio(gap, avg), "sloan_balance": ratio(working(t) - working(t1) - t["depreciation"], avg), "high": value > 0.10}


def runway(t: Column, t1: Column, going_concern: Column) -> Columns:
    """Quarters or years, as the flows are, that cash lasts; infinite if operations bring cash in."""
    flow = t["operating_cash_flow"]
    value = F.when(flow >= 0, F.lit(float("inf"))).otherwise(ratio(t["cash"], -flow))
    return {
        "value": value,
        "flags": F.when(
            value.isNotNull(),
            listed((flow >= 0, "cash-generating"), ((flow < 0) & (t1["operating_cash_flow"] < 0) & (flow < t1["operating_cash_flow"]), "burn-accelerating"), ((flow < 0) & (going_concern | (value < 4)), "financing-cliff")),
        ),
    }


def is_financial(sic: Column) -> Column:
    return F.coalesce(sic.between(6000, 6999), F.lit(False))


def ebitda(t: Column) -> Column:
    return t["ebit"] + t["depreciation"]


def ev_valuation(t: Column, market_cap: Column, sic: Column) -> Columns:
    """EV/Sales with EV, EV/EBITDA and the yield of free cash flow; financial firms have no EBITDA multiple."""
    ev = market_cap + debt(t) - t["cash"]
    fin, earned = is_financial(sic), ebitda(t)
    bad = ~fin & F.coalesce(earned <= 0, F.lit(True))
    sales = ratio(ev, t["revenue"])
    names = listed((fin, "ev-ebitda-suppressed-financials"), (fin, "out-of-model-financials"), (bad, "ev-ebitda-not-meaningful"), (bad & sales.isNotNull(), "ev-sales-fallback"))
    return {
        "value": sales,
        "ev": ev,
        "computable": ev.isNotNull(),
        "ev_ebitda": F.when(~fin & (earned > 0), ratio(ev, earned)),
        "fcf_yield": ratio(t["operating_cash_flow"] - t["capex"], ev),
        "flags": F.when(ev.isNotNull(), names),
    }


def up_market(t: Column, sector_percentile: Column | None = None) -> Columns:
    """Measures that matter for larger firms."""
    earned, owed = ebitda(t), debt(t) - t["cash"]
    lease, pension = t["operating_lease_expense"], t["pension_expense"]
    adjusted = F.when(lease.isNotNull() | pension.isNotNull(), earned + F.coalesce(lease, F.lit(0.0)) + F.coalesce(pension, F.lit(0.0)))
    good = ratio(F.coalesce(t["goodwill"], F.lit(0.0)) + F.coalesce(t["intangibles"], F.lit(0.0)), t["total_assets"])
    lever, cover, sbc = ratio(owed, earned), ratio(t["ebit"], t["interest_expense"]), ratio(t["sbc"], t["revenue"])
    squeezed = (sector_percentile >= 0.80) if sector_percentile is not None else F.lit(False)
    return {
        "goodwill_share": F.when(t["goodwill"].isNotNull() | t["intangibles"].isNotNull(), good),
        "net_debt_ebitda": lever,
        "adjusted_ebitda": adjusted,
        "net_debt_adjusted": ratio(owed, adjusted),
        "coverage": cover,
        "sbc_revenue": sbc,
        "flags": listed((t["goodwill_impairment"] > 0, "goodwill-impairment"), (lever > 4.0, "high-leverage"), (cover < 1.5, "weak-interest-coverage"), (sbc > 0.10, "high-sbc-dilution"), (squeezed, "multiple-compression-risk")),
    }


def record(t: Column, t1: Column, price: Column, market_cap: Column) -> Columns:
    """The fundamentals record of a filer, with how complete its four core fields are."""
    cap = F.coalesce(market_cap, price * nonzero(t["shares_outstanding"]))
    burn = F.when(t["operating_cash_flow"] < 0, -t["operating_cash_flow"] / 12)
    ev = cap + t["total_debt"] - t["cash"]
    sales = F.when(t["revenue"] > 0, t["revenue"])
    core = [t["revenue"], t["cash"], t["shares_outstanding"], t["operating_cash_flow"]]
    have = sum((c.isNotNull().cast("int") for c in core), F.lit(0))
    flags = listed((have < 4, "fundamentals-incomplete"), (core[0].isNull() | core[1].isNull(), "low-confidence"), (t1["revenue"].isNull(), "limited-history"))
    return {"growth": growth(t, t1), "monthly_burn": burn, "runway_months": ratio(t["cash"], burn), "market_cap": cap, "price_sales": ratio(cap, sales), "ev": ev, "ev_sales": ratio(ev, sales), "completeness": have / F.lit(4.0), "flags": flags}


def growth(t: Column, t1: Column) -> Column:
    """Revenue growth over the absolute prior revenue."""
    return ratio(t["revenue"] - t1["revenue"], F.abs(t1["revenue"]))


def health(z: Column) -> Column:
    """Z'' as a sub-score: logistic in asinh(z), anchored at -3 -> 0.25 and 1 -> 0.75."""
    lo, hi = F.asinh(F.lit(DISTRESS_BELOW)), F.asinh(F.lit(SAFE_ABOVE))
    k = 2 * F.log(F.lit(3.0)) / (hi - lo)
    return F.round(1 / (1 + F.exp(-k * (F.asinh(z) - (lo + hi) / 2))), 6)


def growth_score(growth: Column) -> Column:
    return F.round(clamp((growth + 0.20) / 0.60), 4)


def strength_score(f_score: Column) -> Column:
    return F.round(clamp(f_score / 9.0), 4)


def value_score(ev_sales: Column) -> Column:
    return F.round(clamp((10.0 - ev_sales) / 9.0), 4)
