"""Full-text search by an index of positions.

A row of the index is a token of a document with all its places. A phrase is found by moving the places of its
tokens back by their place in the phrase and intersecting them, so a search reads the rows of its tokens alone, not
the texts. The index is a table in parts by a hash of the token, and each part is sorted by token: a search for a few
tokens opens a few parts and skips most of each by the least and greatest token of its pages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of an index.
PARTS = 16
#: What stands between tokens: all but letters and digits.
BETWEEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Tokens of a text in order: runs of letters and digits, in lower case; none for null."""
    spaced = F.btrim(F.regexp_replace(F.lower(text), BETWEEN, " "))
    return F.when(F.length(spaced) > 0, F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Search:
    """What is asked: any of the phrases, in filings of the forms (all if empty), of a company and of days from ``since`` to ``until``."""

    name: str
    phrases: tuple[str, ...]
    forms: tuple[str, ...] = ()
    cik: int | None = None
    since: str | None = None
    until: str | None = None


def part_of(token: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(parts)).cast("int")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each row of tokens, with its places."""
    for batch in batches:
        for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
            rows, names, ends, flat = [], [], [0], []
            for k, found in enumerate(part.column("t").to_pylist()):
                held: dict[str, list[int]] = {}
                for at, token in enumerate(found):
                    held.setdefault(token, []).append(at)
                rows += [k] * len(held)
                names += held
                for places in held.values():
                    flat += places
                    ends.append(len(flat))
            taken = pa.array(rows, pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("id").take(taken), part.column("_row").take(taken), pa.array(names, pa.string()), listed], ["id", "_row", "token", "places"])


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, token, places (in order, from 0): a row for each token of each document.

    Texts of one id count as one document in which no phrase runs from one text to the next; documents without an id
    or a token have no rows. A text is indexed where it is read: a shuffle of single words would move several times
    the texts.
    """
    told = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("_row"), tokens(F.col(text)).alias("t"))
    kind = told.schema["id"].dataType.simpleString()
    return told.mapInArrow(_placed, f"id {kind}, _row long, token string, places array<int>").withColumnRenamed("id", id_col)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", parts: int = PARTS) -> None:
    """Write the index of ``docs`` to ``path``, once; a part with a frequent token is cut into several files.

    Rows are dealt by part and document, so that a token of a third of all documents does not meet in one task.
    """
    rows = postings(docs, id_col, text).withColumn("part", part_of(F.col("token"), parts))
    dealt = rows.repartition("part", F.pmod(F.xxhash64(id_col), F.lit(8))).sortWithinPartitions("part", "token")
    dealt.write.partitionBy("part").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _asked(spark: SparkSession, searches: Iterable[Search]) -> tuple[DataFrame, list[str]]:
    """The tokens of the phrases as a table (search, phrase, token, offset, size), and all of them in a list."""
    told = [(s.name, k, p) for s in searches for k, p in enumerate(s.phrases)]
    rows = spark.createDataFrame(told, "search string, phrase int, said string").withColumn("t", tokens(F.col("said"))).select("search", "phrase", F.size("t").alias("size"), F.posexplode("t").alias("offset", "token"))
    return rows, sorted({r["token"] for r in rows.select("token").distinct().toLocalIterator()})


def phrase_rows(index: DataFrame, searches: list[Search], id_col: str = "doc_id", parts: int = PARTS) -> DataFrame:
    """``(search, id_col)`` of documents in which some phrase of the search occurs; a phrase without a token occurs nowhere.

    What is broadcast and what passes the driver are the tokens of the phrases asked for.
    """
    asked, wanted = _asked(index.sparkSession, searches)
    spots = index.sparkSession.range(1).select(F.explode(F.array(*[part_of(F.lit(t), parts) for t in wanted])).alias("p")).distinct() if wanted else None
    kept = [r["p"] for r in spots.toLocalIterator()] if wanted else []
    rows = index.where(F.col("part").isin(kept) & F.col("token").isin(wanted))
    moved = rows.join(F.broadcast(asked), "token").select("search", "phrase", "size", "offset", id_col, "_row", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
    lists = moved.groupBy("search", "phrase", "size", id_col, "_row").agg(F.collect_list(F.struct("offset", "starts")).alias("l")).where("size(l) = size")
    least = F.array_sort("l", lambda a, b: F.size(a["starts"]) - F.size(b["starts"]))
    met = lists.withColumn("l", least).where(F.size(F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.get("l", 0)["starts"], lambda s, x: F.array_intersect(s, x["starts"]))) > 0)
    return met.select("search", id_col).distinct()


def search(index: DataFrame, filings: DataFrame, searches: list[Search], id_col: str = "doc_id", parts: int = PARTS) -> DataFrame:
    """``search`` and the columns of ``filings`` (``id_col``, cik, form, filing_date) for each filing that answers.

    Days are ISO text and both ends count. ``filings`` without an id in the index answer nothing; a null form or day
    fails a test of it.
    """
    rules = F.lit(None).cast("string")
    for s in searches:
        test = F.lit(True)
        if s.forms:
            test = test & F.col("form").isin(list(s.forms))
        if s.cik is not None:
            test = test & (F.col("cik") == s.cik)
        if s.since is not None:
            test = test & (F.col("filing_date") >= s.since)
        if s.until is not None:
            test = test & (F.col("filing_date") <= s.until)
        rules = F.when((F.col("search") == s.name) & test, F.lit(s.name)).otherwise(rules)
    found = phrase_rows(index, searches, id_col, parts).join(filings, id_col)
    return found.where(rules.isNotNull()).select("search", *filings.columns)
