"""Results to files. Writers keep one file per partition; only small reports pass the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.constants import EXCLUSIONS, MODULES, POSITIVES
from .headed import write_headed

DISCLAIMER = "Research output, not investment advice."
NOTE = "Scores rest on filings alone; whether a name can be traded is not assessed."


def records(ranked: DataFrame) -> DataFrame:
    """The flat export record of each name, ranked ones and gated ones; ``completeness`` is empty where no notes were taken."""
    told = F.col("completeness") if "completeness" in ranked.columns else F.array().cast("array<string>")
    contributions = lambda names, prefix: F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.round(F.col(f"{prefix}_{n}"), 4) for n in names])), lambda k, v: v.isNotNull())
    return ranked.select(
        "ticker", F.round("composite", 4).alias("composite"), "sic_sector", "sector_rank", "sector_size", "gated", "gate_reasons", "penalty_flags", "na_modules", "suppressed",
        F.size("suppressed").alias("suppressed_count"), (F.size("suppressed") == 0).alias("evidence_complete"), told.alias("completeness"),
        contributions(POSITIVES, "add").alias("positive_contributions"), contributions(MODULES, "sub").alias("penalty_contributions"),
        F.array(F.lit(NOTE)).alias("notes"),
    )


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for tabular formats."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet with the disclaimer in each column's metadata, which readers give back."""
    df.select(*[F.col(c).alias(c, metadata={"disclaimer": DISCLAIMER}) for c in df.columns]).write.mode("overwrite").parquet(path)


def read_disclaimer(df: DataFrame) -> str | None:
    return next((f.metadata["disclaimer"] for f in df.schema.fields if "disclaimer" in f.metadata), None)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files of which each has the disclaimer as a comment, one header and its rows."""
    write_headed(flat(df), path, DISCLAIMER)


def write_json(df: DataFrame, path: str) -> None:
    df.withColumn("_disclaimer", F.lit(DISCLAIMER)).write.mode("overwrite").json(path)


def write_scan(ranked: DataFrame, excluded: DataFrame, path: str, failures: DataFrame | None = None, **meta) -> bool:
    """The whole scan, however many names a report shows: ``results``, ``excluded`` and ``failures`` as JSON lines, and
    ``meta`` as one line with what ``counts`` tells.

    Names are counted while they are written, by metrics of the jobs that write. ``failures`` holds ticker and reason.
    Nothing is written, and the answer is false, when no name was scored.
    """
    if ranked.isEmpty():
        return False
    seen, out, lost = Observation("results"), Observation("excluded"), Observation("failures")
    parts = [F.count_if(F.array_contains("suppressed", m)).alias(m) for m in POSITIVES + [m for m in MODULES if m not in POSITIVES]]
    write_json(records(ranked).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("gated").alias("gated"), F.count_if("evidence_complete").alias("complete"), *parts), f"{path}/results")
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in EXCLUSIONS]
    write_json(excluded.observe(out, F.count(F.lit(1)).alias("n"), *reasons), f"{path}/excluded")
    if failures is not None:
        write_json(failures.observe(lost, F.count(F.lit(1)).alias("n")), f"{path}/failures")
    told = {"_disclaimer": DISCLAIMER, **counts(seen.get, out.get, lost.get["n"] if failures is not None else 0), **meta}
    ranked.sparkSession.range(1).select(F.lit(json.dumps(told, default=str)).alias("value")).write.mode("overwrite").text(f"{path}/meta")
    return True


def counts(seen: dict[str, int], out: dict[str, int], failed: int) -> dict:
    """What a scan met: names scanned, ranked, gated, with all evidence, excluded by reason, failed, suppressed by module,
    and whether so many failed that the result is partial."""
    seen, out = dict(seen), dict(out)
    ranked, gated, complete, excluded = seen.pop("n"), seen.pop("gated"), seen.pop("complete"), out.pop("n")
    return {
        "universe_counts": {"scanned": ranked + excluded + failed, "ranked": ranked, "gated": gated, "evidence_complete": complete, "excluded": excluded, "failed": failed},
        "excluded_by_reason": {r: n for r, n in out.items() if n}, "suppressed_by_module": {m: n for m, n in seen.items() if n}, "partial_failure": failure_share(ranked + excluded, failed),
    }


def payload(df: DataFrame, most: int = 100, **meta) -> str:
    """A report as one JSON text for at most ``most`` names, the limit of a report; ``truncated`` tells whether there are
    more. ``write_scan`` writes them all."""
    rows = [json.loads(r) for r in df.limit(most + 1).toJSON().toLocalIterator()]
    return json.dumps({"_disclaimer": DISCLAIMER, **meta, "truncated": len(rows) > most, "results": rows[:most]}, indent=2)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A report as a table for at most ``most`` names."""
    rows = flat(df)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows.limit(most).toLocalIterator()])


def failure_share(scanned: int, failed: int) -> bool:
    """Whether more than a quarter of the names failed."""
    return scanned + failed > 0 and failed / (scanned + failed) > 0.25


def text_of(items: Column) -> Column:
    return F.array_join(items, ";")
