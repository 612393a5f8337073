"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs fall into a fixed number of buckets by hash. Two multinomials over the buckets, one
of trusted documents and one of the whole corpus, give each bucket a log ratio; a document's score is the
mean over its n-grams. Text unlike the target scores low. Every document is decided by the same threshold.

Counting reads the corpus once and reduces it in the reading tasks to one row a bucket. Scoring is a
projection: the log ratios, as many as there are buckets whatever the corpus, go along as one literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

BUCKETS = 8192
#: Trusted documents are a classifier's training rows: at most so many, the first by hash of their id.
MAX_TRUSTED = 20_000
#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.1
WINDOW = 8
LEAST_WORDS = 20
SYMBOLS = r"[#*$%&|<>]"


#: Slices to the end of an array.
REST = 1 << 30


def joined(hashes: str, step: int) -> Column:
    """At each position the hash of the element there and the one ``step`` on (null beyond the end)."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(1 + step), F.lit(REST)), lambda a, b: F.xxhash64(a, b))


def hashed_words(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def bucket(value: Column, n: int) -> Column:
    return F.pmod(value, F.lit(n)).cast("int")


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of at most ``most`` documents labelled as good, the first by hash of the id."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(texts: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket from ``texts(doc_id, text)``; add-one counts on both sides.

    Without trusted documents, or without any text, all ratios are 0. ``trusted`` holds at most
    ``MAX_TRUSTED`` ids, which bounds what is broadcast; the result has ``n`` numbers.
    """
    flagged = texts.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    hashed = flagged.select("good", words(F.col("text")).alias("tokens")).select("good", hashed_words(F.col("tokens")).alias("h1"))
    grams = hashed.select("good", F.explode(F.concat("h1", joined("h1", 1))).alias("gram")).select("good", bucket(F.col("gram"), n).alias("bucket"))
    counts = {r["bucket"]: (r["n"], r["good"]) for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("good")).collect()}
    raw, good = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not good:
        return [0.0] * n
    return [round(math.log((counts.get(b, (0, 0))[1] + 1) / (good + n)) - math.log((counts.get(b, (0, 0))[0] + 1) / (raw + n)), 5) for b in range(n)]


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` packed into one column ``doc`` plus the counts of the base rules and the hashes of words and pairs.

    The columns are steps of one projection chain; no row moves.
    """
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(F.struct("*").alias("doc"))
    d = d.select("doc", words(body).alias("tokens"), lines.alias("lines"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    d = d.select("doc", "n_symbols", F.size("tokens").cast("long").alias("n_words"), F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashed_words(F.col("tokens")).alias("h1"))
    d = d.withColumn("h2", joined("h1", 1)).withColumn("h4", joined("h2", 2)).withColumn("h8", joined("h4", 4))
    d = d.withColumn("windows", F.slice("h8", F.lit(1), F.greatest(F.size("h8") - (WINDOW - 1), F.lit(0)))).drop("h4", "h8")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    d = d.withColumn("twice", F.sort_array(F.transform(F.filter("sorted", lambda x, k: same(x, F.get("sorted", k - 1)) | same(x, F.get("sorted", k + 1))), lambda x: x["i"])))
    covered = F.aggregate("twice", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    return d.select("doc", "h1", "h2", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, n: int = BUCKETS) -> DataFrame:
    """Every row of ``docs``, packed in ``doc``, with the base counts, ``base_failed``, ``ratio``, ``kept``.

    A null text has no words. A text without words has ratio 0 and fails the base rules. Repeated rows and
    ids are assessed one by one; a null id is never trusted. An empty table, or one without labels, gives
    ratio 0 everywhere. Further columns of ``docs`` ride along in ``doc`` under any name.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    ratios = F.split(F.lit(",".join(map(str, log_ratios(texts, trusted_ids(labels), n)))), ",").cast("array<double>")
    d = base_columns(docs, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    logs = F.zip_with("h1", "h2", lambda one, two: F.get(ratios, bucket(one, n)) + F.get(ratios, bucket(two, n)))
    total = F.aggregate(logs, F.lit(0.0), lambda a, b: a + b)
    d = d.withColumn("ratio", F.when(F.col("n_words") > 0, F.round(total / (2 * F.col("n_words")), 6)).otherwise(F.lit(0.0))).drop("h1", "h2")
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, counts of the base rules, the verdicts and the ratio."""
    return assess(docs, labels).select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    # The partition number keeps the optimizer from writing the verdict out again below each step of its projections.
    return assess(docs, labels, **options).withColumn("part", F.spark_partition_id()).where("kept AND part >= 0").select("doc.*")
