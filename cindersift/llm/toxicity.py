"""Toxicity by a factorization machine over hashed terms.

Besides a weight, each term has a short vector, and each pair of terms of a text adds the product of
their vectors: an insult together with a mention of a group can weigh more than both alone, which additive
weights cannot express.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out

#: The classifier is fitted on at most so many labelled documents, the first by hash of their id, half of each label if there are so many.
MAX_FIT = 8_000
BITS, FACTORS = 17, 4
EPOCHS, RATE, DECAY = 15, 0.3, 1e-3
#: A bucket is used if so many training texts have it and its chi-square against the label is at least so large.
LEAST_TEXTS, LEAST_CHI2 = 5, 12.0
#: The same of a pair of buckets, of which there are many more.
LEAST_PAIR_CHI2 = 100.0
TERM = re.compile(r"\w+")


class Buckets(dict):
    """Buckets of terms by hash; bounded memory."""

    def __missing__(self, term: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[term] = value = xxhash.xxh64_intdigest(term) & ((1 << BITS) - 1)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets of a text's lower-cased terms."""
        found = set(TERM.findall(text.lower())) if text else ()
        return np.unique(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))


def _chi2(a: np.ndarray, c: np.ndarray, p: int, n: int) -> np.ndarray:
    """Chi-square of a term in ``c`` of ``n`` texts and ``a`` of the ``p`` toxic ones."""
    spread = c * (n - c) * p * (n - p)
    return np.divide(n * (a * n - c * p) ** 2, spread, out=np.zeros_like(a), where=spread > 0)


def _telling(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets whose presence in a training text depends on its label, alone or together with another one.

    A pair counts if it tells more than twice as much as each of the two, so that a term which tells nothing by
    itself, as the mention of a group, is known where its company makes the difference. All pairs of buckets
    that are frequent in toxic texts are looked at, those of one bucket at once, from the texts that hold it; the
    memory that takes grows with the buckets of the texts, not with their pairs.
    """
    toxic = [x for x, y in zip(texts, labels, strict=True) if y]
    n, p = len(texts), len(toxic)
    a = np.bincount(np.concatenate(toxic), minlength=1 << BITS).astype(float)
    c = np.bincount(np.concatenate(texts), minlength=1 << BITS).astype(float)
    alone = _chi2(a, c, p, n)
    known = (c >= LEAST_TEXTS) & (alone >= LEAST_CHI2)
    often = np.flatnonzero(a >= LEAST_TEXTS)
    place = np.full(1 << BITS, -1)
    place[often] = np.arange(len(often))
    own = [x[x >= 0] for x in (place[x] for x in texts)]
    of_text = np.repeat(np.arange(n), [len(x) for x in own])
    order = np.argsort(np.concatenate(own), kind="stable")
    holders = np.split(of_text[order], np.cumsum(np.bincount(np.concatenate(own), minlength=len(often)))[:-1]) if len(often) else []
    marked = np.asarray(labels, bool)
    for k, rows in enumerate(holders):
        both = np.bincount(np.concatenate([own[i] for i in rows]), minlength=len(often))
        two = np.flatnonzero(both >= LEAST_TEXTS)
        bad = np.bincount(np.concatenate([np.empty(0, np.int64), *(own[i] for i in rows[marked[rows]])]), minlength=len(often))[two].astype(float)
        least = np.maximum(LEAST_PAIR_CHI2, 2 * np.maximum(alone[often[k]], alone[often[two]]))
        tell = two[_chi2(bad, both[two].astype(float), p, n) >= least]
        if len(tell):
            known[often[k]] = known[often[tell]] = True
    return known


class Machine:
    """Bias, weights and factors; a text is the set of its buckets that training met often enough."""

    def __init__(self, seed: int = 7):
        self.bias = 0.0
        self.w = np.zeros(1 << BITS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (1 << BITS, FACTORS)).astype(np.float32)
        self.known = np.zeros(1 << BITS, bool)

    def raw(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = self.v[x]
        s = v.sum(axis=0)
        return float(self.bias + self.w[x].sum() + 0.5 * ((s * s).sum() - (v * v).sum())), s

    def score(self, x: np.ndarray) -> float:
        z, _ = self.raw(x[self.known[x]])
        return 1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0))))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
        """Stochastic gradient steps scaled per parameter by past gradients; rows in a fixed shuffled order."""
        if not len(texts) or labels.min() == labels.max():
            self.bias = -6.0 if not len(texts) or not labels.max() else 6.0
            return self
        self.known = _telling(texts, labels)
        rows = [x[self.known[x]] for x in texts]
        self.bias = float(np.log(labels.mean() / (1 - labels.mean())))
        gw, gv = np.full(1 << BITS, 1e-2, np.float32), np.full((1 << BITS, FACTORS), 1e-2, np.float32)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                x = rows[i]
                z, s = self.raw(x)
                g = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - labels[i]
                self.bias -= 0.01 * g
                if not len(x):
                    continue
                dw = g + DECAY * self.w[x]
                v = self.v[x]
                dv = g * (s - v) + DECAY * v
                gw[x] += dw * dw
                gv[x] += dv * dv
                self.w[x] -= RATE * dw / np.sqrt(gw[x])
                self.v[x] -= 0.2 * RATE * dv / np.sqrt(gv[x])
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_FIT) -> Machine:
    """Fit on labelled documents: at most ``most``, the bound of what the driver holds; null labels and texts teach nothing. A document labelled both ways is toxic. Ids may be of any type; rows that repeat an id are learned in the order of their terms."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    halves = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    given = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    joined = given.join(F.broadcast(chosen), "doc_id")
    kind = joined.schema["doc_id"].dataType.simpleString()
    rows = joined.mapInPandas(_bucketed, f"doc_id {kind}, toxic int, x array<long>").orderBy("doc_id", "x").toLocalIterator()
    texts, marks = [], []
    for r in rows:
        texts.append(np.array(r["x"], np.int64))
        marks.append(r["toxic"])
    machine, y = Machine(), np.array(marks, np.float64)
    machine.fit(texts, y)
    seen = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(y) and 0 < y.mean() < 1:  # the sample's share of toxic rows is not that of the labels
        machine.bias += float(np.log(seen[1] / seen[0]) - np.log(y.mean() / (1 - y.mean())))
    return machine


def _bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Buckets()
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "x": [known.of(t) for t in batch["text"]]})


def _scored(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, known = sent.value, Buckets()
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "score": [machine.score(known.of(t)) for t in batch["text"]]})

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score from 0 to 1, predicted 1 if that is at least 0.5.

    The machine, of a size that its parameters fix, is broadcast. A null or empty text has the score of
    the bias alone. Without labels of both kinds every score is near the one label's value, 0 if there is none. Repeated rows and null ids are scored like others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    given = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    kind = given.schema["doc"].dataType.simpleString()
    return given.mapInPandas(_scored(sent), f"doc {kind}, score double").select(F.col("doc").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a machine that learned from those not held out."""
    machine = fit(docs, labels.where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
