"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters has the same
template. Windows of the template are hash-joined between benchmark and documents. Where a document
matches most windows of an item, the fillers of the matched slots are compared: a re-parameterised question
replaces each filler by one other throughout, so an item's filler should go with one filler of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .tokens import runs

#: Words in a template window, the part of an item's windows to be matched, and of slot fillers to agree.
WINDOW = 5
COVERAGE = 0.8
CONSISTENT = 0.8
#: Bits of the map that tells windows no item has; 8 MB, whatever the benchmark.
MAP_BITS = 1 << 26
#: Place of the whole document, besides those of single occurrences.
ANYWHERE = -(1 << 40)

#: Units that stand after a number.
UNITS = frozenset("mm cm m km g kg mg t l ml s sec min h hr hrs hours hour minutes minute seconds days day weeks week months years year inches inch feet foot miles mile pounds pound euro euros dollars dollar cents usd eur percent % $ € £ kwh w kw v a hz mb gb tb".split())
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+|\n")
NUM, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
BREAK = 9


class Words(dict):
    """Numbers of raw words, and by number the hash of the literal form, the kind, whether it ends a sentence and
    whether it is shouted; remembered within bounds. A new word is added to the arrays, which are never made anew but
    when they are full."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self._make(most)

    def _make(self, size: int) -> None:
        self.hashes, self.kinds, self.ends, self.shouts = (np.empty(size, t) for t in (np.uint64, np.int8, bool, bool))

    def __missing__(self, raw: str) -> int:
        self[raw] = at = len(self)
        if raw.isalpha():  # neither edges to strip nor a number nor an end
            low = raw.lower()
            kind, ends = 3 if low in UNITS else 2 if raw[0].isupper() else 0, False
        else:
            core = EDGES.sub("", raw) or raw
            low = core.lower()
            kind = BREAK if raw == "\n" else 1 if NUMBER.fullmatch(core) else 3 if low in UNITS else 2 if core[:1].isupper() else 0
            ends = raw[-1] in ".!?:;|\n"
        self.hashes[at], self.kinds[at], self.ends[at], self.shouts[at] = xxhash.xxh64_intdigest(low), kind, ends, len(low) > 3 and raw.isupper()
        return at

    def of(self, found: list[str]) -> tuple[np.ndarray, ...]:
        if len(self) + len(found) > self.most:
            self.clear()
            if len(found) > len(self.hashes):
                self._make(len(found))
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return self.hashes[at], self.kinds[at], self.ends[at], self.shouts[at]


@lru_cache(1)
def remembered() -> Words:
    """The words that a worker remembers from task to task."""
    return Words()


def template(text: str, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Canonical token hashes and kinds of a text, both again with leading words as names, and the raw words.

    Kinds are 0 literal, 1 number, 2 name, 3 unit. A capitalised word is a name unless it begins a
    sentence or a line, where it can be either, or is shouted; a unit must stand after a number.
    """
    found = TOKEN.findall(text)
    h, kind, ends, shout = known.of(found)
    begins, after = np.ones(len(h), bool), np.zeros(len(h), bool)
    begins[1:], after[1:] = ends[:-1], kind[:-1] == 1
    leading = (kind == 2) & begins & ~shout
    k = np.where((kind == 2) & (begins | shout) | (kind == 3) & ~after, 0, kind)
    word = kind != BREAK
    k, h, leading = k[word], h[word], leading[word]
    for code, mark in ((1, NUM), (2, NAME), (3, UNIT)):
        h[k == code] = mark
    named, other = k.copy(), h.copy()
    named[leading], other[leading] = 2, NAME
    return h, k, other, named, [w for w in found if w != "\n"]


def _windows(sent, window: int):
    """Windows of texts in both forms; those that no item has, by the map ``sent``, are left out. ``win`` names an
    item's window, whichever form is matched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, wanted = remembered(), None if sent is None else sent.value
        for batch in batches:
            rows = []
            for row, text in zip(batch["row"], batch["text"], strict=True):
                if not text:
                    continue
                h, k, other, named, found = template(text, known)
                literal, moved = runs(h, window), runs(other, window)
                for keys, kinds, places in ((literal, k, np.arange(len(literal))), (moved, named, np.flatnonzero(literal != moved))):
                    if wanted is not None and len(places):
                        bit = keys[places] & np.uint64(64 * len(wanted) - 1)
                        places = places[(wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                    for p in places.tolist():
                        slots = [f"{kinds[i]}{(EDGES.sub('', found[i]) or found[i]).lower()}" for i in range(p, min(p + window, len(k))) if kinds[i]]
                        rows.append((row, p, int(keys[p].astype(np.int64)), int(literal[p].astype(np.int64)), slots))
            yield pd.DataFrame(rows, columns=["row", "pos", "key", "win", "slots"])

    return run


WINDOWS = "row long, pos int, key long, win long, slots array<string>"


def key_map(asked: DataFrame) -> np.ndarray:
    """A bit for each remainder of the keys; at most MAP_BITS / 64 numbers come to the driver."""
    bit = F.col("key").bitwiseAND(F.lit(MAP_BITS - 1))
    words = asked.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast((key & {MAP_BITS - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds: doc_id, item_id, n_matched, n_windows,
    coverage, consistency.

    A pair is reported if at least ``coverage`` of the item's distinct windows are in the document and at
    least ``consistent`` of the matched slot fillers go with the most frequent filler of the document for
    them (1 if there are no slots), over the whole document or over one occurrence of the item in it. An item shorter than a window is one window. Null or empty texts
    match nothing, nor do items without an id. Documents without an id are left out. Rows that repeat an
    id count as one document or item with all their texts. Integer ids only.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("row"), F.col(item_text).alias("text"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row"), F.col(text).alias("text"))
    asked = settle(items.mapInPandas(_windows(None, window), WINDOWS))
    sent = docs.sparkSession.sparkContext.broadcast(key_map(asked))
    hits = texts.mapInPandas(_windows(sent, window), WINDOWS)
    sizes = asked.groupBy(F.col("row").alias("item_id")).agg(F.count_distinct("win").alias("n_windows"), F.floor((F.max("pos") + window) / 2).alias("half"))
    pairs = settle(hits.drop("win").join(asked.select(F.col("row").alias("item_id"), "key", "win", F.col("pos").alias("at"), F.col("slots").alias("asked")), "key").select(F.col("row").alias("doc_id"), "item_id", "win", (F.col("pos") - F.col("at")).alias("shift"), "asked", "slots"))
    covered = pairs.groupBy("doc_id", "item_id").agg(F.count_distinct("win").alias("n_matched")).join(sizes, "item_id").where(F.col("n_matched") >= coverage * F.col("n_windows"))
    near = pairs.join(covered.select("doc_id", "item_id", "half"), ["doc_id", "item_id"])
    # Occurrences of an item are at least its length apart, so none of these overlapping ranges of shifts has two.
    nth = F.floor(F.col("shift") / F.col("half"))
    placed = settle(near.withColumn("place", F.explode(F.array(F.lit(None).cast("long"), nth, nth - 1))))
    by = ["doc_id", "item_id", "place"]
    held = placed.groupBy(*by).agg(F.count_distinct("win").alias("n_matched")).join(sizes.drop("half"), "item_id").where(F.col("n_matched") >= coverage * F.col("n_windows")).withColumn("at", F.coalesce("place", F.lit(ANYWHERE)))
    fillers = placed.where(F.size("slots") > 0).select(*by, F.explode(F.arrays_zip("asked", "slots")).alias("z")).withColumn("at", F.coalesce("place", F.lit(ANYWHERE)))
    votes = fillers.groupBy("doc_id", "item_id", "at", F.col("z.asked").alias("asked"), F.col("z.slots").alias("filler")).count()
    agreed = votes.groupBy("doc_id", "item_id", "at", "asked").agg(F.max("count").alias("most"), F.sum("count").alias("all")).groupBy("doc_id", "item_id", "at").agg((F.sum("most") / F.sum("all")).alias("agreed"))
    judged = held.join(agreed, ["doc_id", "item_id", "at"], "left").withColumn("consistency", F.round(F.coalesce("agreed", F.lit(1.0)), 6)).where(F.col("consistency") >= consistent)
    best = judged.groupBy("doc_id", "item_id", "n_windows").agg(F.max(F.struct((F.col("at") == ANYWHERE).alias("whole"), "n_matched", "consistency")).alias("m")).select("doc_id", "item_id", "m.n_matched", "n_windows", "m.consistency")
    return best.select("doc_id", "item_id", "n_matched", "n_windows", F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage"), "consistency")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without an id stay."""
    dirty = matches(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(settle(dirty), id_col, "left_anti").select(*docs.columns)
