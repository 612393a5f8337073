"""Periodic runs of words, found by comparing a text with itself shifted by every lag at once.

The words of a text get numbers; bit b of all numbers in text order is one large integer, a plane. A plane XOR
itself shifted by a lag has a one wherever the words so far apart differ in that bit; the OR over the planes marks
all mismatches. A run of period q is a long stretch of zeros there, and AND with shifts that double isolates the
stretches that are long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words
from .tokens import WORD

#: Least length of a run in words; it must also hold its period twice.
LEAST = 12
#: Planes compared, and the stretch that must be left, before the other planes of a lag are looked at.
FIRST_PLANES, FIRST_STRETCH = 2, 8


def planes(found: list[str]) -> list[int]:
    """A large integer for each bit of the words' numbers, the first word lowest."""
    numbers: dict[str, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    return [int.from_bytes(np.packbits((at >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range((len(numbers) - 1).bit_length())]


def stretches(ones: int, size: int) -> int:
    """Bit i is set where ``size`` ones follow one another from bit i on."""
    have = 1
    while have < size and ones:
        step = min(have, size - have)
        ones &= ones >> step
        have += step
    return ones


def places(bits: int) -> list[int]:
    """Places of the ones, in order."""
    if bits.bit_count() > 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")).tolist()
    out = []
    while bits:
        out.append((bits & -bits).bit_length() - 1)
        bits &= bits - 1
    return out


def runs_of(found: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal run of at least ``least`` words and two periods, by start, then period.

    A stretch that a smaller period explains is found under that period first, with the same ends, as then the
    smaller period divides the larger; so equal ends are met again only by multiples, which are left out. Time is
    the square of the number of words, over the bits of a machine word.
    """
    n, bits = len(found), planes(found)
    held, first = {}, bits[:FIRST_PLANES]
    every = (1 << n) - 1
    for q in range(1, n // 2 + 1 if n >= least else 1):
        need, inside, miss = max(least - q, q), every >> q, 0
        for plane in first:
            miss |= plane ^ (plane >> q)
        same = inside & ~miss
        if not stretches(same, min(need, FIRST_STRETCH)):
            continue
        for plane in bits[FIRST_PLANES:]:
            same &= ~(plane ^ (plane >> q))
        long = 1 if same == inside and need == n - q else stretches(same, need)
        if long:
            for a, z in zip(places(long & ~(long << 1)), places(long & ~(long >> 1)), strict=True):
                held.setdefault((a, z + need + q), q)
    return sorted((a, z - a, q) for (a, z), q in held.items())


def kept_words(found: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return found
    steps = [0] * (len(found) + 1)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [w for w, deep in zip(found, accumulate(steps), strict=False) if not deep]


RUNS = "array<struct<start:long,length:long,period:long>>"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in batch.column("text"):
                found = WORD.findall(text.as_py() or "")
                got = runs_of(found, least)
                counts.append(len(found))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in got])
                kept.append(" ".join(kept_words(found, got)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, RUN), pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``id_col``, n_words, runs (start, length, period; by start, then period) and the text without the repeats, its
    words joined by one space, for each row of ``docs``.

    Words are runs of characters other than ASCII white space. Null and empty texts have no words and no runs, and
    an empty rest. Every row is judged alone: repeated ids give a row each, a null id stays null, ids may have any
    type. Other columns of ``docs`` are not looked at, whatever their names. A text is held whole in its task, with
    one bit a word for each plane; there is no shuffle.
    """
    told = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = told.schema["id"].dataType.simpleString()
    return told.mapInArrow(_searched(least), f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by a hash of the id, repeats a stretch to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    told = docs.select("doc_id", F.col("text").alias("was"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    n = F.size("w").cast("long")
    told = told.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.lit(1).cast("long") + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", place(i).cast("int")))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("was")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The runs of each document in figures: their number, the longest (then the first, then of least period) and
    hashes of all runs and of the text without the repeats."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic(with_planted_period(docs)).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
