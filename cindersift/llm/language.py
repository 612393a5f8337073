"""Language identification: words first, character n-grams for unseen words.

A known word adds its log frequency in each language. An unseen word is scored by its longest character
n-grams that any language knows, then shorter ones, down to single letters. Sums over a text's words give a
posterior over the languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on about so many labelled documents (exactly: each with this expectation over the
#: number of them), drawn by hash of their id. Their words, and so the model, are what this bounds.
MAX_FIT = 20_000
#: Least count of a word in a language.
LEAST_COUNT = 2
LONGEST = 5
UND = "und"
#: Runs of letters, and of numeric characters that are no decimal digits, such as fractions.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words that are looked up and summed at once.
CHUNK = 4096


def letter_runs(text: str) -> list[str]:
    """The longest runs of letters of ``text``; other numeric characters, which are rare, part them."""
    found = LETTERS.findall(text)
    if text.isascii() or "".join(found).isalpha():
        return found
    return [run for word in found for run in ([word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split())]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from collections import Counter

    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if text:
                counts.setdefault(lang, Counter()).update(letter_runs(text.lower()))
        yield pd.DataFrame([(lang, w, n) for lang, c in counts.items() for w, n in c.items()], columns=["lang", "word", "n"])


class Model:
    """Log frequencies by language of words and of n-grams, as one matrix with a row for each term."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.langs = sorted({lang for lang, *_ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        totals: dict[tuple[str, int], int] = {}
        for lang, _, size, n in rows:
            totals[lang, size] = totals.get((lang, size), 0) + n
        self.index: dict[tuple[int, str], int] = {}
        for _, term, size, _ in rows:
            self.index.setdefault((size, term), len(self.index))
        self.table = np.zeros((len(self.index), len(self.langs)), np.float32)
        for (size, _), i in self.index.items():
            self.table[i] = [np.log(0.1 / (totals.get((lang, size), 0) + 1)) for lang in self.langs]
        for lang, term, size, n in rows:
            self.table[self.index[size, term], at[lang]] = np.log(n / (totals[lang, size] + 1))

    def word(self, word: str) -> np.ndarray:
        """The word's scores; zeros if neither it nor any of its letters was seen."""
        i = self.index.get((0, word))
        if i is not None:
            return self.table[i]
        marked = f"<{word}>"
        for size in range(LONGEST, 0, -1):
            found = [i for k in range(len(marked) - size + 1) if (i := self.index.get((size, marked[k : k + size]))) is not None]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_FIT) -> Model:
    """Fit on the rows of ``docs`` with a language and a text.

    Word counts come from about ``most`` documents, n-gram counts from the word counts. That sample bounds what
    the driver gathers, whatever the number of documents and languages.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    n = labelled.count()
    if n > most:
        labelled = labelled.where(F.xxhash64("doc_id") < -(1 << 63) + (most << 64) // n)
    counts = labelled.select("lang", "text").mapInPandas(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).cache()
    known = counts.select("lang", F.col("word").alias("term"), F.lit(0).alias("size"), "n")
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    size = F.explode(F.array(*[F.lit(k) for k in range(1, LONGEST + 1)])).alias("size")
    grams = counts.select("lang", "n", marked.alias("marked"), size).where(F.length("marked") >= F.col("size"))
    grams = grams.select("lang", "size", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("marked") - F.col("size") + 1), lambda i: F.col("marked").substr(i, F.col("size")))).alias("term"))
    grams = grams.groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for part in (known, grams) for r in part.select("lang", "term", "size", "n").orderBy("lang", "size", "term").toLocalIterator()]
    counts.unpersist()
    return Model(rows)


class _Places(dict):
    """The row of ``table`` that has a word's scores, for words met so far; forgotten between chunks if many."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.table = np.empty((CHUNK, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at] = self.model.word(word)
        self[word] = at
        return at

    def summed(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.table.shape[1])
        for k in range(0, len(words), CHUNK):
            if len(self) >= self.most:
                self.clear()
            some = words[k : k + CHUNK]
            places = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            total += self.table[places].sum(axis=0, dtype=np.float64)
        return total


def _predicted(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        places = _Places(model)
        for batch in batches:
            langs, sure = [], []
            for text in batch["text"]:
                words = letter_runs(text.lower()) if text else []
                if not words or not model.langs:
                    langs.append(UND)
                    sure.append(0.0)
                    continue
                total = places.summed(words)
                best = int(total.argmax())
                langs.append(model.langs[best])
                sure.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            yield pd.DataFrame({"doc": batch["doc"], "lang_pred": langs, "score": sure})

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the posterior of the predicted language).

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. A
    text none of whose letters is known gets the first language by name with an even posterior, as do ties. Repeated
    rows and null ids are predicted like others; whole texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    kind = given.schema["doc"].dataType.simpleString()
    return given.mapInPandas(_predicted(sent), f"doc {kind}, lang_pred string, score double").withColumnRenamed("doc", "doc_id")


def held_out(id_col: str = "doc_id"):
    """Whether a document's id, as text, has CRC-32 divisible by five; true for a null id, which trains nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def digest(docs: DataFrame) -> DataFrame:
    """Predictions of every document by a model that learned from those not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
