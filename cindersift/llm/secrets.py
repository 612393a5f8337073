"""Secret scan with corpus-wide ownership frequency.

A scan of one text cannot tell a live credential from the sample key that everybody copies. Here the
candidates of all texts are hashed and counted by distinct repositories and distinct owners: a value
that only a few owners hold looks live, one that many hold is a widely copied example.

Everything on the main path is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: pattern, the group that holds the value, and the least length of that group."""

    name: str
    pattern: str
    group: int
    least: int


ASSIGN = Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20)
HEX = Kind("hex", r"[0-9a-f]{24,}", 0, 24)
#: What the ownership count adds to the base kinds: long strings that mix letters and digits. They are
#: too common to report by their look alone, so only owner-specific ones are.
OPAQUE = Kind("opaque", r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+", 0, 20)
BASE = (ASSIGN, ACCESS, HEX)
KINDS = (*BASE, OPAQUE)
#: A text without a match of this has no candidate of any kind.
ANY = "|".join(k.pattern for k in KINDS)

#: A value held by more owners than this is a widely copied example.
MAX_OWNERS = 2
#: So is one held by more repositories than this, whoever owns them.
MAX_REPOS = 20


def _found(text: Column, rank: int, kind: Kind) -> Column:
    """Matches of one kind in order: gap before the match, its length, the value's length and its hash."""
    whole, value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    pieces = F.zip_with(
        F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(whole)),
        F.arrays_zip(whole.alias("whole"), value.alias("value")),
        lambda gap, m: F.struct(
            F.lit(rank).alias("rank"),
            F.length(gap).cast("long").alias("gap"),
            F.length(m["whole"]).cast("long").alias("n"),
            ((F.length(m["value"]) >= kind.least) & (m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") if kind is OPAQUE else F.lit(True))).alias("ok"),
            F.sha2(m["value"], 256).alias("value"),
        ),
    )
    return F.when(text.rlike(kind.pattern), pieces).otherwise(F.array().cast("array<struct<rank:int,gap:bigint,n:bigint,ok:boolean,value:string>>"))


def candidates(texts: DataFrame) -> DataFrame:
    """Candidate spans of ``texts(row, text, repo, owner)``: row, repo, owner, rank, start, end, value.

    Offsets are code points, the end is exclusive. A match starts where the gaps and matches of its kind
    before it end, which a running sum over the matches of one text gives.
    """
    text = F.col("text")
    exploded = texts.select("row", "repo", "owner", F.posexplode(F.flatten(F.array(*[_found(text, i, k) for i, k in enumerate(KINDS)])))).select("row", "repo", "owner", "pos", "col.*")
    ordered = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = exploded.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(ordered)).withColumn("start", F.col("end") - F.col("n"))
    return placed.where("ok").select("row", "repo", "owner", "rank", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value the distinct repositories and owners that hold it.

    Distinct counts are two-step aggregations, so a value that a third of all repositories hold is first
    reduced in the tasks that read it.
    """
    return found.groupBy("value").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan_secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> tuple[DataFrame, DataFrame]:
    """Secrets of every text: ``(clean, found)``.

    ``clean`` has the rows of ``docs`` without a candidate, each packed in the column ``doc``. ``found`` has all
    others and the column ``secrets``, an array of structs ``start, rank, end, kind, live, value, n_repos, n_owners``
    in text order. Spans of the base kinds (assign, access, hex) are always there and ``live`` says
    whether at most ``max_owners`` owners and ``max_repos`` repositories hold the value; further opaque strings are there only if they
    are live and not inside a base span.

    Null texts count as empty and have no secret. A null repository or owner is not counted. Repeated rows
    are each scanned. A value that occurs twice in a text gives two spans. An empty table gives empty results. The
    time for a text is linear in its length. Columns of ``docs`` may have any names.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    hit = F.col("text").rlike(ANY)
    clean = packed.where(~hit).select("doc")
    held = settle(packed.where(hit).withColumn("row", F.monotonically_increasing_id()))
    spans = settle(candidates(held.drop("doc")))
    # Both sides are written tables, so that adaptive execution splits the rows of a value that many texts hold.
    counted = spans.join(settle(ownership(spans)), "value")
    span = F.struct("start", "rank", "end", F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank") + 1).alias("kind"), ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live"), "value", "n_repos", "n_owners")
    grouped = counted.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))
    opaque = KINDS.index(OPAQUE)
    kept = F.filter("all", lambda s: (s["rank"] < opaque) | (s["live"] & ~F.exists("all", lambda b: (b["rank"] < opaque) & (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    found = held.join(grouped, "row", "left").select("doc", F.coalesce(kept, F.array().cast(grouped.schema["all"].dataType)).alias("secrets"))
    return clean, found


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: id, counts by base kind, digest of the base spans, all spans, how many spans
    look live or are widely copied, and ``spread``, the repositories and owners that hold each span's value."""
    clean, found = scan_secrets(docs, repo=id_col, **options)
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    of_rank = lambda rank: F.filter("secrets", lambda s: s["rank"] == rank)
    some = found.select(
        F.col("doc")[id_col].alias("doc_id"),
        *[F.size(of_rank(i)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("secrets", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["n_repos"].cast("string"), s["n_owners"].cast("string"))), ",").alias("spread"),
    )
    zero = F.lit(0).cast("long")
    none = clean.select(F.col("doc")[id_col].alias("doc_id"), *[zero.alias(f"n_{k.name}") for k in BASE], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_copied"), F.lit("").alias("spread"))
    return none.unionByName(some)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; spans that overlap become one mark.

    Widely copied examples stay. Rows keep their number and columns; ``length`` is recomputed for changed
    texts if ``docs`` has it.
    """
    clean, found = scan_secrets(docs, text=text, **options)
    live = F.filter("secrets", lambda s: s["live"])
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    merged = F.aggregate(
        live,
        empty,
        lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]),
                               F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    body = F.col("doc")[text]
    out = found.withColumn("secrets", merged)
    cut = F.transform("secrets", lambda s, i: body.substr(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("secrets", i - 1)["end"]).cast("int") + 1, (s["start"] - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("secrets", i - 1)["end"])).cast("int")))
    tail = body.substr((F.element_at("secrets", -1)["end"] + 1).cast("int"), F.length(body))
    new = F.when(F.size("secrets") == 0, body).otherwise(F.array_join(F.concat(cut, F.array(tail)), mark))
    packed = out.select(F.struct(*[new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]).alias("new"), (F.size("secrets") > 0).alias("changed"))
    changed = packed.select(*[F.when(F.col("changed"), F.length(F.col("new")[text]).cast(docs.schema[c].dataType)).otherwise(F.col("new")[c]).alias(c) if c == length else F.col("new")[c].alias(c) for c in docs.columns])
    return reduce(DataFrame.unionByName, [clean.select("doc.*"), changed])


def oracle(max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> str:
    """``digest`` over the table ``documents`` in DuckDB's SQL."""
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern = kind.pattern.replace("(?<![A-Za-z0-9])", "").replace("}+", "}").replace("'", "''")
        mixed = "AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')" if kind is OPAQUE else ""
        parts.append(f"""k{rank} AS (SELECT row, doc_id, source, {rank} AS rank, '{kind.name}' AS kind, value, ends - length(whole) AS start, ends FROM (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY row ORDER BY pos) AS ends FROM (
    SELECT row, doc_id, source, unnest(string_split_regex(t, '{pattern}')[1:len(w)]) AS gap, unnest(w) AS whole, unnest(v) AS value, unnest(range(len(w))) AS pos
    FROM (SELECT *, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {kind.group}) AS v FROM d) WHERE len(w) > 0))
  WHERE length(value) >= {kind.least} {mixed})""")
    base = len(BASE)
    counts = ", ".join(f"coalesce(count(*) FILTER (rank = {i}), 0) AS n_{k.name}" for i, k in enumerate(BASE))
    found = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(KINDS)))
    return (
        "WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),\n" + ",\n".join(parts)
        + f""", f AS ({found}),
o AS (SELECT value, count(DISTINCT doc_id) AS n_repos, count(DISTINCT source) AS n_owners FROM f GROUP BY value),
g AS (SELECT f.*, n_repos, n_owners, n_owners <= {max_owners} AND n_repos <= {max_repos} AS live, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(ends AS BIGINT) AS said FROM f JOIN o USING (value)),
s AS (SELECT * FROM g WHERE rank < {base} OR (live AND NOT EXISTS (SELECT 1 FROM g b WHERE b.row = g.row AND b.rank < {base} AND b.start < g.ends AND g.start < b.ends))),
a AS (SELECT row, {counts}, string_agg(said, ',' ORDER BY start, rank, ends) FILTER (rank < {base}) AS base, string_agg(said, ',' ORDER BY start, rank, ends) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, string_agg(n_repos || ':' || n_owners, ',' ORDER BY start, rank, ends) AS spread FROM s GROUP BY row)
SELECT doc_id, """
        + ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE)
        + """, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(spread, '') AS spread
FROM d LEFT JOIN a USING (row)"""
    )
