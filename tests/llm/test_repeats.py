"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from cindersift.llm import repeats


def brute(words, least=12):
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, 2 * q):
                held = words[i : i + size]
                if not any(all(held[k] == held[k + p] for k in range(size - p)) for p in range(1, q)):
                    out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def rest(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(500):
        n, letters = r.randint(0, 70), r.choice(["ab", "abc", "a", "abcdefgh"])
        words = [r.choice(letters) for _ in range(n)]
        if r.random() < 0.6 and n > 4:
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        least = r.choice([12, 2, 5])
        runs = repeats.runs_of(words, least)
        assert runs == brute(words, least), (words, least)
        assert repeats.kept_words(words, runs) == rest(words, runs)


def test_the_first_stretch_does_not_hide_runs_of_rare_words():
    r = random.Random(5)
    block = [f"w{r.randrange(10_000)}" for _ in range(400)]
    words = [f"x{r.randrange(10_000)}" for _ in range(300)] + block * 2 + block[:100] + [f"y{r.randrange(10_000)}" for _ in range(300)]
    assert repeats.runs_of(words) == brute(words) == [(300, 900, 400)]


@pytest.mark.parametrize("words", [["a"] * 20_000, ["a", "b"] * 10_000, ["a"] * 9_999 + ["b"] + ["a"] * 10_000])
def test_long_texts(words):
    runs = repeats.runs_of(words)
    assert runs[0][0] == 0 and max(n for _, n, _ in runs) >= 10_000
    assert len(repeats.kept_words(words, runs)) < 10_010


def test_stretches_and_places():
    r = random.Random(6)
    for _ in range(300):
        bits = [r.random() < 0.8 for _ in range(r.randint(1, 90))]
        size = r.randint(1, 12)
        number = sum(1 << k for k, b in enumerate(bits) if b)
        want = [k for k in range(len(bits) - size + 1) if all(bits[k : k + size])]
        assert repeats.places(repeats.stretches(number, size)) == want


ROWS = [(1, "x " + "a b c " * 6 + "end"), (2, None), (3, ""), (4, " \n\t"), (1, "x " + "a b c " * 6 + "end"), (None, "z " * 13), (5, "no repeat in here"), (6, "q" * 5000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, [1], "w") for i, t in rows], "doc_id long, text string, runs array<int>, collapsed string")


def test_table_of_runs(spark):
    got = {(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in repeats.periodic(frame(spark)).collect()}
    assert got == {(1, 20, ((1, 18, 3),), "x a b c end"), (2, 0, (), ""), (3, 0, (), ""), (4, 0, (), ""), (None, 13, ((0, 13, 1),), "z"), (5, 4, (), "no repeat in here"), (6, 1, (), "q" * 5000)}
    assert repeats.periodic(frame(spark)).count() == len(ROWS)
    assert repeats.digest(frame(spark, [])).collect() == []


def test_digest_equals_the_contract_in_plain_python(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 120)))) for k in range(300)]
    got = {row["doc_id"]: tuple(row)[1:] for row in repeats.digest(frame(spark, rows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(words), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[key] == (len(runs), *four, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(rest(words, runs)))), key
    assert planted > 10
