"""SentencePiece BPE by a table of prefixes.

The encoding of a prefix of a text ends in one token only, and it is the encoding of the prefix before that token
with this token added. A token may follow another if the two together are encoded as just these two, and a whole
text is encoded by a sequence of tokens in which each may follow the one before. So one pass fills a table: for
each prefix the automaton of all pieces gives the tokens that can end it, and the one that may follow the last
token of the prefix before it is kept. The ids are read off the table from the end.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space in pieces.
MARK = "▁"
#: Stretches and pairs remembered by a worker; longer stretches are not.
REMEMBERED, LONGEST = 400_000, 64

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """The pieces of a BPE model with byte fallback, and its rules of merging."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        if any(map(model.is_unused, ids)) or "".join(model.encode("  a", out_type=str)) != MARK * 3 + "a":
            raise ValueError("only models without unused pieces that keep all white space and put a space before a text are supported")
        self.bytes_at = {int(names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes_at) != 256:
            raise ValueError("only models with byte fallback are supported")
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id_of = {names[i]: i for i in normal}
        self.score = {names[i]: model.get_score(i) for i in normal}
        self.size = len(names)
        self.spelled = [b""] * len(names)
        for i in ids:
            self.spelled[i] = b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace(MARK, " ").encode()
        for byte, i in self.bytes_at.items():
            self.spelled[i] = bytes([byte])
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        # No piece goes on with a mark after another character, so no token lies across such a place.
        cut = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.id_of)
        self.stretches = re.compile(f"{MARK}+[^{MARK}]*" if cut else "(?s:.+)")
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges from single characters, the best score first, then the leftmost; for texts of two tokens at most."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, last: str, token: str) -> bool:
        """Whether the two together are encoded as these two; with nothing before, whether a token is encoded as itself."""
        key = (last, token)
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[key] = fits = self.merged(last + token) == ([last, token] if last else [token])
        return fits

    def last_tokens(self, text: str) -> list[str]:
        """The last token of each prefix. A character that is no piece is a token of its own."""
        ending: list[list[str]] = [[] for _ in text]
        for at, piece in self.automaton.iter(text):
            ending[at].append(piece)
        out: list[str] = []
        for at, pieces in enumerate(ending):
            for piece in pieces:
                if self.may_follow(out[at - len(piece)] if at >= len(piece) else "", piece):
                    out.append(piece)
                    break
            else:
                out.append(text[at])
        return out

    def _stretch(self, text: str) -> tuple[int, ...]:
        last, at, tokens = self.last_tokens(text), len(text), []
        while at:
            tokens.append(last[at - 1])
            at -= len(tokens[-1])
        ids: list[int] = []
        for token in reversed(tokens):
            number = self.id_of.get(token)
            ids.extend([number] if number is not None else [self.bytes_at[b] for b in token.encode()])
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if text:
            known = self.known
            for part in self.stretches.findall(MARK + text.replace(" ", MARK)):
                ids = known.get(part)
                if ids is None:
                    ids = self._stretch(part)
                    if len(part) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[part] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, but for the one that encoding puts first; bytes that are no character are replaced one by one."""
        return b"".join([self.spelled[i] for i in ids]).removeprefix(b" ").decode(errors="each_byte")


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ends, ids, texts = [0], [], []
                for text in part.column("text"):
                    got = pieces.encode(text.as_py() or "")
                    ids.append(np.array(got, np.int32))
                    ends.append(ends[-1] + len(got))
                    texts.append(pieces.decode(got))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), listed, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ids (an array) and decoded, the text that the ids give, for each row of ``docs``.

    Ids are those that the library gives without begin and end; null and empty texts have none and give an empty
    text. Marks (U+2581) inside a text come back as spaces. Every row is encoded alone: repeated ids give a row
    each, null ids stay null, ids may have any type; other columns are not looked at, whatever their names. Memory
    grows with the longest stretch between two spaces, time in proportion to the text; there is no shuffle.
    """
    told = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = told.schema["id"].dataType.simpleString()
    return told.mapInArrow(_encoded(path or public_tokenizers.path(MODEL)), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The number of ids of each document and hashes of them and of the decoded text."""
    found = encoded(docs)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
