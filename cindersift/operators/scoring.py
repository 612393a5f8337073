"""Scores, gates and ranks.

A row of signals becomes a composite that can be taken apart again: weighted positive sub-scores less
weighted penalties. A sub-score that could not be computed adds nothing and is listed as suppressed; a
penalty that ran and found nothing is 0, one that never ran is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.constants import CONFIDENCE, CRITICAL, GATE_REASONS, LADDER_SEVERITY, MODULES, POSITIVES, PRESETS, PROFILES, TIER_SEVERITY
from ..functions.expr import absent, listed
from .insider import sub_score
from .ordering import global_rank, group_sizes, percentile  # noqa: F401


def _scale(table: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def positives(s: DataFrame) -> DataFrame:
    """Sub-scores ``pos_*`` from ev_sales, revenue_growth, piotroski, altman_z, sentiment and insider columns; null if suppressed."""
    return s.withColumns({
        "pos_valuation": models.value_score(F.col("ev_sales")),
        "pos_growth": models.growth_score(F.col("revenue_growth")),
        "pos_fundamental_momentum": models.strength_score(F.col("piotroski")),
        "pos_sentiment": F.round((F.col("sentiment") + 1.0) / 2.0, 4),
        "pos_insider": sub_score(F.col("insider_net"), F.col("insider_cluster"), F.col("insider_confidence")),
        "pos_fin_health": models.health(F.col("altman_z")),
    })


def penalties(s: DataFrame) -> DataFrame:
    """Severity times confidence of each module, ``pen_*``; null where it has no finding."""
    held = F.when(F.col("out_of_model"), F.lit(0.5)).otherwise(F.lit(1.0))
    zone = models.zone(F.col("altman_z"))
    bearish, over = F.col("insider_net") == "bearish", F.col("insider_overhang")
    selling = F.when(bearish | over, F.least(F.lit(1.0), F.when(bearish, 0.6).otherwise(0.3) + F.when(over, 0.2).otherwise(0.0)) * F.coalesce(_scale(CONFIDENCE, F.col("insider_confidence")), F.lit(0.5)))
    has = lambda name: F.coalesce(F.array_contains("up_flags", name), F.lit(False)).cast("int")
    lever = (has("high-leverage") + has("weak-interest-coverage")) * 0.4
    return s.withColumns({
        "pen_dilution": _scale(LADDER_SEVERITY, F.col("dilution_severity")),
        "pen_manipulation": F.lit(None).cast("double"),
        "pen_delisting": _scale(TIER_SEVERITY, F.col("delisting_tier")),
        "pen_halt_suspension": F.when(F.col("suspended"), F.lit(1.0)),
        "pen_insider_selling": selling,
        "pen_distress": F.when(zone == "distress", held),
        "pen_solvency_watch": F.when(zone == "grey", 0.5 * held),
        "pen_beneish": F.when(F.col("beneish_m") > -1.78, F.least(F.lit(1.0), 0.5 + F.greatest(F.lit(0.0), F.col("beneish_m") + 1.78) * 0.3) * held),
        "pen_goodwill_impairment": F.when(has("goodwill-impairment") == 1, F.lit(0.7)),
        "pen_multiple_compression": F.when(has("multiple-compression-risk") == 1, F.lit(0.6)),
        "pen_leverage_coverage": F.when(lever > 0, F.least(F.lit(1.0), lever)),
        "pen_sbc_dilution": F.when(has("high-sbc-dilution") == 1, F.least(F.lit(1.0), F.coalesce(F.col("sbc_revenue"), F.lit(0.10)) / 0.20)),
    })


def weights(profile: str = "hold", preset: str = "penny", overrides: dict[str, float] | None = None) -> tuple[dict[str, float], dict[str, float | None]]:
    """Weight of each positive and of each penalty module; None for a module that the preset switches off."""
    pos, mag, own = PROFILES[profile]["weights"] | (overrides or {}), PROFILES[profile]["penalties"], PRESETS[preset]
    factor = {}
    for module, (m, p) in MODULES.items():
        w = own.get(p, 1.0) if p else 1.0
        factor[module] = None if p and w == 0.0 else (mag.get(m, 1.0) if m else 1.0) * w
    return {k: pos.get(k, 1.0) for k in POSITIVES}, factor


def compose(s: DataFrame, profile: str = "hold", preset: str = "penny", overrides: dict[str, float] | None = None) -> DataFrame:
    """Contributions ``add_*`` and ``sub_*``, the composite, na_modules, suppressed modules and gates."""
    pos, factor = weights(profile, preset, overrides)
    s = penalties(positives(s))
    s = s.withColumns({f"add_{k}": F.lit(w) * F.coalesce(F.col(f"pos_{k}"), F.lit(0.0)) for k, w in pos.items()} | {f"sub_{m}": F.lit(None).cast("double") if w is None else F.lit(w) * F.col(f"pen_{m}") for m, w in factor.items()})
    plus = sum((F.col(f"add_{k}") for k in pos), F.lit(0.0))
    less = sum((F.coalesce(F.col(f"sub_{m}"), F.lit(0.0)) for m in factor), F.lit(0.0))
    gone = [("growth", "revenue_growth"), ("fundamental_momentum", "piotroski"), ("fin_health", "altman_z"), ("distress", "altman_z"), ("beneish", "beneish_m"), ("dilution", "dilution_severity"), ("delisting", "delisting_tier"), ("halt_suspension", "suspended")]
    return s.withColumns({
        "penalty_total": less,
        "composite": plus - less,
        "penalty_flags": F.array_sort(listed(*[(F.col(f"sub_{m}").isNotNull(), m) for m in factor])),
        "na_modules": listed(*[(F.col(f"pen_{m}").isNotNull(), m) for m, w in factor.items() if w is None]),
        "suppressed": absent([(n, F.col(c)) for n, c in gone]),
        "gate_reasons": gates(),
        "gated": F.size(gates()) > 0,
    })


def gates() -> Column:
    return listed((F.col("suspended"), GATE_REASONS[0]), (F.col("delisting_tier") == "determination", GATE_REASONS[1]))


def assessed(columns: list[str]) -> Column:
    """Whether any of these measurements is there; a name without one is reported, not scored."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def filter_reason(no_serial_splitter: bool, need_insider_buying: bool) -> Column:
    """Why the scan's filters leave a name out; null if they keep it."""
    out = F.lit(None).cast("string")
    if need_insider_buying:
        out = F.when(F.coalesce(F.col("insider_buying"), F.lit(False)), out).otherwise(F.lit("no recent insider buying"))
    if no_serial_splitter:
        out = F.when(F.coalesce(F.col("serial_splitter"), F.lit(False)), F.lit("serial reverse splitter")).otherwise(out)
    return out


def is_flagged() -> Column:
    return F.col("gated") | F.arrays_overlap("penalty_flags", F.array(*[F.lit(c) for c in CRITICAL]))


def rank(scored: DataFrame) -> DataFrame:
    """Global rank within ranked and gated names, and the rank and size within sectors of ranked ones.

    Ranking all names needs one order of all of them: a range-partitioned sort gives each partition's rows
    in order, and the ranks of the partitions before are added, so no task holds them all, nor all of a sector.
    """
    order, sector = [F.desc("composite"), F.asc("ticker")], ["gated", "sic_sector"]
    placed = group_sizes(global_rank(global_rank(scored, "gated", order), sector, order, "sector_rank"), sector, "sector_size")
    ranked = ~F.col("gated")
    return placed.withColumns({c: F.when(ranked, F.col(c)) for c in ("sector_rank", "sector_size")})


def sort_key(by: str) -> Column:
    """What an alternative order sorts by, largest first; ties go by ticker."""
    return {"growth": F.col("add_growth"), "valuation": F.col("add_valuation"), "sentiment": F.col("add_sentiment"), "risk": -F.col("penalty_total"), "score": F.col("composite")}[by]


def top(scored: DataFrame, n: int | None, by: str = "score") -> DataFrame:
    out = scored.where("NOT gated").orderBy(sort_key(by).desc(), "ticker")
    return out if n is None else out.limit(n)


def glyph() -> Column:
    """Marker of a name in a listing: excluded, critical, cautious or clean, and how much was not checked."""
    unchecked = F.when(F.size("suppressed") > 0, F.concat(F.lit(" ~"), F.size("suppressed").cast("string"), F.lit(" unchecked"))).otherwise("")
    names = F.array_join("penalty_flags", ", ")
    critical = F.arrays_overlap("penalty_flags", F.array(*[F.lit(c) for c in CRITICAL]))
    return F.when(F.col("gated"), F.concat(F.lit("[X] excluded: "), F.array_join("gate_reasons", "; "))).when(critical, F.concat(F.lit("[X] "), names, unchecked)).when(F.size("penalty_flags") > 0, F.concat(F.lit("[!] "), names, unchecked)).otherwise(F.concat(F.lit("-"), unchecked))
