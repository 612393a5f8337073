"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) form a contingency table. Raking scales its cells until the
marginals of all three dimensions agree with their targets, keeping the odds ratios of the corpus. A
document of a cell is then sampled with the rate that brings the cell to its fitted share of the token
budget; the draw is a hash of the document's id, so it is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settle

DIMENSIONS = ("source", "lang", "topic")
#: Targets by default: each marginal's own shares to this power, which lifts rare categories; 1 keeps a marginal, 0 makes it even.
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS = 12
#: Part of the corpus' tokens that the sample should have.
BUDGET = 0.5
#: Up to so many cells are raked in one task and joined by broadcast; beyond, both are distributed.
SMALL = 50_000
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, legal notices, markup-laden text or prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("License") | text.contains("Licensed") | text.contains("Copyright"), "legal")
        .when(text.contains("%%%") | text.contains("###") | text.contains("***"), "markup")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE))).otherwise(F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone; 0.5 for a null id."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32), F.lit(0.5))


def described(docs: DataFrame, id_col: str, text: str, source: str, lang: str, topic: Column | None) -> DataFrame:
    """``docs`` packed in ``doc`` with id, cell and token count; null categories are a category of their own."""
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    label = lambda c: F.coalesce(F.col("doc")[c].cast("string"), F.lit(NONE))
    packed = docs.select(F.struct("*").alias("doc"))
    return packed.select("doc", F.col("doc")[id_col].alias("doc_id"), label(source).alias("source"), label(lang).alias("lang"), (topic_of(body) if topic is None else topic).alias("topic"), token_count(body).alias("n_tokens"))


def targets(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """Tempered target shares of one dimension: its shares to the power ``alpha``, scaled to sum 1."""
    share = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    powered = share.withColumn("p", F.pow("t", F.lit(alpha)))
    total = powered.agg(F.sum("p")).first()[0]
    return powered.select(dim, (F.col("p") / F.lit(total)).alias(f"target_{dim}"))


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scale ``weight`` of ``cells`` to each dimension's ``target_*`` in turn, ``rounds`` times."""
    for _ in range(rounds):
        for dim in DIMENSIONS:
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"target_{dim}") / F.sum("weight").over(Window.partitionBy(dim)))
    return cells


def rates(cells: DataFrame, alphas: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, small: int = SMALL) -> tuple[DataFrame, bool]:
    """Sampling rate of each cell of ``cells(source, lang, topic, tokens)``, and whether there are few cells.

    The rate is the expected number of copies of a document of the cell: budget times fitted share over
    own share. It may exceed 1.
    """
    alphas = ALPHAS if alphas is None else alphas
    cells = settle(cells)
    few = cells.limit(small + 1).count() <= small
    full = cells.where("tokens > 0")
    full = full.coalesce(1) if few else full
    for dim in DIMENSIONS:
        aimed = targets(full, dim, alphas[dim])
        full = full.join(F.broadcast(aimed) if few else aimed, dim)
    total = cells.agg(F.sum("tokens").cast("double")).first()[0]
    shares = full.withColumn("share", F.col("tokens") / F.lit(total)).withColumn("weight", F.col("share"))
    return settle(rake(shares, rounds).select(*DIMENSIONS, F.round(F.lit(budget) * F.col("weight") / F.col("share"), 6).alias("rate"))), few


def calibrate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, **options) -> DataFrame:
    """Every row of ``docs``, packed in ``doc``, with its cell, ``n_tokens``, ``rate`` and ``copies``.

    ``copies`` is ``rate`` rounded up or down by the draw of the document's id, so that its expectation is
    ``rate``. A null source or language is a category ``(none)``. Texts that are null or without a word have no tokens;
    in a cell without any token the rate is 0. Repeated rows get the same draw. An empty table gives an
    empty result. Columns of ``docs`` may have any names.
    """
    d = described(docs, id_col, text, source, lang, topic)
    cells = d.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    rate, few = rates(cells, **options)
    joined = d.join(F.broadcast(rate) if few else rate, list(DIMENSIONS), "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return joined.withColumn("copies", F.floor(F.col("rate") + draw(F.col("doc_id"))).cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, cell, tokens, sampling rate and copies."""
    return calibrate(docs).select("doc_id", *DIMENSIONS, "n_tokens", "rate", "copies")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn at least once, with their columns, ``mix_rate`` and ``mix_copies``, which
    take the place of columns of ``docs`` with these names."""
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("mix_rate", "mix_copies")]
    return calibrate(docs, **options).where("copies > 0").select(*own, F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))


def residual(cells: DataFrame, rate: DataFrame, alphas: dict[str, float] | None = None) -> float:
    """The largest distance of a marginal's fitted share from its target, for ``cells(source, lang, topic, tokens)``
    and the ``rates`` of them: what raking has left after its rounds."""
    alphas = ALPHAS if alphas is None else alphas
    fitted = cells.where("tokens > 0").join(rate, list(DIMENSIONS)).withColumn("w", F.col("tokens") * F.col("rate"))
    total = fitted.agg(F.sum("w")).first()[0] or 1.0
    off = [fitted.groupBy(d).agg((F.sum("w") / total).alias("got")).join(targets(cells, d, alphas[d]), d).agg(F.max(F.abs(F.col("got") - F.col(f"target_{d}")))).first()[0] for d in DIMENSIONS]
    return max(x or 0.0 for x in off)


def oracle(alphas: dict[str, float] = ALPHAS, rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """``digest`` over the table ``documents`` in DuckDB's SQL."""
    space = r"[\x20\x09-\x0D]+"
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, 'License') OR contains(t, 'Copyright') THEN 'legal'
  WHEN contains(t, '%%%') OR contains(t, '###') OR contains(t, '***') THEN 'markup' ELSE 'prose' END AS topic,
  CAST(len(list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents))""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for dim in DIMENSIONS:
        steps.append(f"t_{dim} AS (SELECT {dim}, p / sum(p) OVER () AS target_{dim} FROM (SELECT {dim}, pow(sum(tokens), {alphas[dim]}) AS p FROM c GROUP BY 1))")
    steps.append("w0 AS (SELECT *, tokens / sum(tokens) OVER () AS share, tokens / sum(tokens) OVER () AS weight FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for dim in DIMENSIONS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * target_{dim} / sum(weight) OVER (PARTITION BY {dim}) AS weight) FROM w{k})")
            k += 1
    steps.append(f"r AS (SELECT source, lang, topic, round({budget} * weight / share, 6) AS rate FROM w{k})")
    return "WITH " + ",\n".join(steps) + (
        "\nSELECT doc_id, source, lang, topic, n_tokens, coalesce(rate, 0.0) AS rate,"
        " CAST(floor(coalesce(rate, 0.0) + coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0, 0.5)) AS BIGINT) AS copies"
        " FROM d LEFT JOIN r USING (source, lang, topic)"
    )
