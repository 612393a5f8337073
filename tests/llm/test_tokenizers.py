"""Encoding by the prefix table and the alignment of two tokenizers, against the libraries and plain Python."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cindersift.llm import alignment, pieces

ODD = ["", " ", "  ", "   a", "\n\n\t", "▁", " ▁a▁ ", "<s>", "</s> <unk>", "<0x41>", "<|endoftext|>", "naïve café", "漢字かな", "😀‍👍🏽", "\x00\x01", "﻿x", "a" * 3000, " " * 700, "ab" * 900 + "  x", "a\r\nb", "٣٤", "é", "x" * 40 + "​" * 9]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.fixture(scope="module")
def table():
    return pieces.model(public_tokenizers.path(pieces.MODEL))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_are_encoded_and_decoded_as_by_the_library(text, table, library):
    ids = table.encode(text)
    assert ids == library.encode(text)
    assert table.decode(ids) == library.decode(ids)


def test_random_texts_are_encoded_as_by_the_library(table, library):
    r = random.Random(7)
    names, letters = sorted(table.id_of), "aábcde thinr  ▁\n\t<>s0xAF/é😀漢字ſß"
    for k in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40))) if k % 2 else "".join(r.choice(names) for _ in range(r.randint(1, 8))).replace("▁", " " if k % 4 else "▁")
        ids = table.encode(text)
        assert ids == library.encode(text), text
        assert table.decode(ids) == library.decode(ids), text


def test_ids_of_no_text_are_decoded_as_by_the_library(table, library):
    r = random.Random(8)
    for _ in range(2000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 6))]
        if ids and ids[0] < 259:
            ids = [r.randrange(300, 32000), *ids]
        assert table.decode(ids) == library.decode(ids), ids


def test_a_token_may_follow_just_where_the_library_leaves_both(table, library):
    names = [n for n in sorted(table.id_of) if not n.startswith("▁") and len(n) < 5]
    r = random.Random(9)
    for _ in range(3000):
        a, b = r.choice(names), r.choice(names)
        first, second = "\n" + a, b  # a line feed is a byte and no part of a longer piece
        kept = library.encode(first + second, out_type=str)[2:] == [a, b]
        assert table.may_follow(a, b) == kept, (a, b)


def test_what_is_remembered_is_bounded(table, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    texts = [f"wörd{k} other{k * 7} <x{k}>" for k in range(30)]
    assert [table.encode(t) for t in texts] == library.encode(texts)


DOCS = [(1, "The cat sat."), (2, None), (3, ""), (1, "The cat sat."), (None, "cat  cat"), (4, "▁ mark"), (5, "naïve 漢字 😀 <|endoftext|> </s>"), (6, "the the the The cat"), (7, "word " * 5000)]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "x", [1], 0) for i, t in rows], "doc_id long, text string, ids string, pairs array<int>, row int")


def test_encoding_of_a_table(spark, library):
    got = pieces.encoded(frame(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in got) == sorted((i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in DOCS)
    assert pieces.digest(frame(spark, [])).collect() == []
    row = pieces.digest(frame(spark, [(9, "a b")])).first()
    ids = library.encode("a b")
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"a b").hexdigest())


def brute(rows):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each row, from the libraries' own pieces."""
    a_side = Tokenizer.from_file(public_tokenizers.path(alignment.SIDE_A))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SIDE_B))
    letters, told, total = alignment.byte_of_letter(), [], collections.Counter()
    for _, text in rows:
        said = f" {text}" if text else ""
        a = a_side.encode(said, add_special_tokens=False).ids
        b = b_side.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != said.encode() or b"".join(bytes_b) != said.encode():
            told.append(None)
            continue
        ends = {sum(map(len, bytes_a[: k + 1])): k for k in range(len(a))} if len(a) < 500 else {}
        if not ends:
            at = 0
            for k, piece in enumerate(bytes_a):
                at += len(piece)
                ends[at] = k
        links, groups, at, i, j = [], [], 0, 0, 0
        for k, piece in enumerate(bytes_b):
            at += len(piece)
            if at in ends:
                links.append((a[ends[at]], b[k]))
                groups.append(",".join(map(str, a[i : ends[at] + 1])) + "|" + ",".join(map(str, b[j : k + 1])))
                i, j = ends[at] + 1, k + 1
        total.update(links)
        told.append((len(a), len(b), links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if t is None else (t[0], t[1], len(t[2]), len(t[2]), sum(total[x] == best[x[1]] for x in t[2]), sum(total[x] for x in t[2]), t[3]) for t in told]


@pytest.mark.parametrize("stream", [1, 2, alignment.STREAM])
def test_alignment_equals_brute_force_however_streams_are_split(spark, stream):
    got = alignment.alignment(frame(spark), stream=stream).collect()
    want = [(i, *rest) for (i, _), rest in zip(DOCS, brute(DOCS), strict=True)]
    key = lambda r: (r[0] or 0, r[7], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_texts_that_a_side_does_not_give_back_have_no_tokens(spark):
    rows = {r["doc_id"]: r for r in alignment.digest(frame(spark)).collect()}
    assert rows[4]["n_a"] == rows[4]["n_groups"] == rows[4]["count_sum"] == 0 and rows[4]["groups_sha256"] == ""
    assert rows[2]["groups_sha256"] == rows[3]["groups_sha256"] == ""


def test_alignment_of_an_empty_table_and_of_string_ids(spark):
    assert alignment.digest(frame(spark, [])).collect() == []
    named = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    assert alignment.digest(named).first()["doc_id"] == "x"


def test_slices_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(alignment, "AT_ONCE", 10)
    texts = ["a" * n for n in (3, 20, 0, 5, 5, 1, 40)]
    cut = list(alignment.slices(texts))
    assert [k for b, e in cut for k in range(b, e)] == list(range(len(texts)))
    assert all(e - b == 1 or sum(map(len, texts[b:e])) <= 10 for b, e in cut)
