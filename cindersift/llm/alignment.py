"""Cross-tokenizer alignment: which tokens of two tokenizers end together, in a document and over the corpus.

Each document is encoded by both sides once. Places where a token of A and a token of B both end are links; the links
of a document are counted by pair of ids before anything moves. These postings are dealt by B's id, and by a
further number if the id is frequent, and meet there the counts of the pairs and the highest count of the id, which
are summed from partial sums and dealt alike; both sides are sorted streams that may spill. What a posting adds to its
document is summed by document.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Postings of one B id that are dealt together.
STREAM = 50_000
#: Characters encoded at once in a task.
AT_ONCE = 1_000_000
#: Words remembered by a worker.
REMEMBERED = 400_000
#: Texts that are cut into words here: printable ASCII, tab and line ends, Latin letters and signs up to U+024F, dashes and quotes.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027]*")
_LETTER, _NUMBER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: Fixed value: the words of byte-level vocabularies, for these texts.
PLAIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")
MARK = "▁"


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBPE:
    """Side A. Texts of letters whose kind no edition of Unicode moves are cut into words here and a word is encoded
    once; others go to the library whole. Either way the library encodes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told["pre_tokenizer"] or {}
        self.by_words = told["normalizer"] is None and {k: cut.get(k) for k in ("type", "add_prefix_space", "use_regex")} in [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": u} for u in (True, None)]
        letters = byte_of_letter()
        self.spelled = [bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode() for entry in map(self.library.id_to_token, range(self.library.get_vocab_size()))]
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.known
        cut = [PLAIN_WORD.findall(t) if self.by_words and PLAIN.fullmatch(t) else None for t in texts]
        new = {w for words in cut if words for w in words}.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {w for words in cut if words for w in words}
        ask = list(new)
        known.update(zip(ask, (e.ids for e in self.library.encode_batch_fast(ask, add_special_tokens=False)), strict=True))
        whole = iter(self.library.encode_batch_fast([t for t, words in zip(texts, cut, strict=True) if words is None], add_special_tokens=False))
        return [next(whole).ids if words is None else list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]


@lru_cache(2)
def sides(path_a: str, path_b: str):
    """Both tokenizers and, for each, the bytes of every id and their numbers; and the ids as texts with what may come
    after them in a group: a comma, a bar or a semicolon."""
    a, b = ByteBPE(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    spelled_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(b.get_piece_size())]
    most = max(len(a.spelled), len(spelled_b))
    named = [f"{i}{mark}" for mark in ",|;" for i in range(most)]
    return a, b, (a.spelled, np.array([*map(len, a.spelled)], np.int64)), (spelled_b, np.array([*map(len, spelled_b)], np.int64)), named


def grouped(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, named: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of both sides between the places where both end, ``at_a`` and ``at_b``."""
    most, put = len(named) // 3, np.empty(len(a) + len(b), np.int64)
    size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    marked_a, marked_b = a.copy(), b.copy()
    marked_a[at_a] += most
    marked_b[at_b] += 2 * most
    put[np.arange(len(a)) + np.repeat(at_b + 1 - size_b, size_a)] = marked_a
    put[np.arange(len(b)) + np.repeat(at_a + 1, size_b)] = marked_b
    return "".join(map(named.__getitem__, put.tolist()))[:-1]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with AT_ONCE characters at most, or one text."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > AT_ONCE:
            yield begin, k
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


PAIRS = "array<struct<a:int,b:int,times:int>>"
PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, (spelled_a, size_a), (spelled_b, size_b), named = sides(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in slices(texts):
                counts, groups, ends, linked = [], [], [0], [[], [], []]
                said = [f" {t}" if t else "" for t in texts[begin:end]]
                for text, a, b in zip(said, left.encode(said), right.encode([t[1:] for t in said], num_threads=1), strict=True):
                    raw = text.encode()
                    if not text or b"".join([spelled_a[i] for i in a]) != raw or b"".join([spelled_b[i] for i in b]) != raw:
                        counts.append((0, 0, 0))
                        groups.append("")
                        ends.append(ends[-1])
                        continue
                    ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
                    _, at_a, at_b = np.intersect1d(size_a[ids_a].cumsum(), size_b[ids_b].cumsum(), assume_unique=True, return_indices=True)
                    pairs, times = np.unique(ids_a[at_a] << 32 | ids_b[at_b], return_counts=True)
                    for column, values in zip(linked, (pairs >> 32, pairs & 0xFFFFFFFF, times), strict=True):
                        column.append(values.astype(np.int32))
                    counts.append((len(a), len(b), len(at_a)))
                    groups.append(grouped(ids_a, ids_b, at_a, at_b, named))
                    ends.append(ends[-1] + len(pairs))
                flat = [pa.array(np.concatenate(c) if c else [], pa.int32()) for c in linked]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(PAIR)))
                numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, end - begin), *numbers, pa.array(groups, pa.string()), listed], ["id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    return run


def aligned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """For each row of ``docs`` its id, n_a, n_b, n_groups, groups (``a1,a2|b1;...``) and pairs: linked ids and how often.

    A text that is null or empty, or that one side does not give back byte by byte, has no tokens: zeros, an empty
    string, no pairs.
    """
    told = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = told.schema["id"].dataType.simpleString()
    run = _aligned(path_a or public_tokenizers.path(SIDE_A), path_b or public_tokenizers.path(SIDE_B))
    return told.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, groups string, pairs {PAIRS}")


def pair_counts(postings: DataFrame, stream: int = STREAM) -> tuple[DataFrame, DataFrame]:
    """Of ``postings(a, b, times)``: the links of each pair with the highest count of its B id (a, b, links, best), and
    of each B id the streams of about ``stream`` postings that it is dealt to (b, streams)."""
    pairs = written(postings.groupBy("a", "b").agg(F.sum("times").cast("long").alias("links"), F.count(F.lit(1)).alias("rows")))
    of_b = written(pairs.groupBy("b").agg(F.max("links").alias("best"), F.ceil(F.sum("rows") / stream).cast("int").alias("streams")))
    return pairs.join(F.broadcast(of_b), "b").select("a", "b", "links", "best", "streams"), of_b.select("b", "streams")


def alignment(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, stream: int = STREAM, hashed: bool = False) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for each row of ``docs``.

    n_best counts links whose pair is one of the most frequent of its B id in all of ``docs``, ties included;
    count_sum adds the corpus-wide count over the links. With ``hashed``, groups is its SHA-256 in hex, or empty
    without tokens. Rows are told apart by place, so repeated ids give a row each and count each; a null id stays
    null, ids may have any type, an empty table gives an empty result. Other columns are not looked at. What is
    broadcast has a row for each entry of B's vocabulary at most.
    """
    groups = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("") if hashed else F.col("groups")
    texts = written(aligned(docs, id_col, text, path_a, path_b).select("id", "n_a", "n_b", "n_groups", groups.alias("groups"), "pairs").withColumn("row", F.monotonically_increasing_id()))
    postings = texts.select("row", F.inline("pairs"))
    counts, of_b = pair_counts(postings, stream)
    dealt = postings.join(F.broadcast(of_b), "b").withColumn("nth", F.pmod(F.xxhash64("row"), F.col("streams")).cast("int")).drop("streams")
    every = counts.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("streams") - 1))).drop("streams")
    met = dealt.join(every, ["b", "nth", "a"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("links") == F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("links")).cast("long").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return texts.drop("pairs").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups")


def digest(docs: DataFrame) -> DataFrame:
    return alignment(docs, hashed=True).withColumnRenamed("groups", "groups_sha256")
