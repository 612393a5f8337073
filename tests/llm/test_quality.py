import math
import re
from collections import Counter

import xxhash

from cindersift.llm import quality
from cindersift.llm.common import table


def xx(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = [xx(w.encode()) for w in words]
    pairs = [xx((h[i + 1] & (2**64 - 1)).to_bytes(8, "little"), xx((h[i] & (2**64 - 1)).to_bytes(8, "little")) & (2**64 - 1)) if i + 1 < len(h) else xx((h[i] & (2**64 - 1)).to_bytes(8, "little")) for i in range(len(h))]
    return words, [x % quality.BUCKETS for x in h + pairs]


def repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a b c d e f g h " * 40), (9003, "x # $ |\nx # $ |\n\n"), (None, "word")], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    labels = table(spark, sf, "labels")
    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, trusted = Counter(), Counter()
    for r in rows:
        _, g = grams(r.text)
        raw.update(g)
        if r.doc_id in good:
            trusted.update(g)
    n_raw, n_good = sum(raw.values()), sum(trusted.values())
    ratio = {b: round(math.log((trusted[b] + 1) / (n_good + quality.BUCKETS)) - math.log((raw[b] + 1) / (n_raw + quality.BUCKETS)), 5) for b in range(quality.BUCKETS)}
    want = []
    for r in rows:
        words, g = grams(r.text)
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep, score = repeats(words), sum(ratio[b] for b in g) / len(g) if g else 0.0
        failed = len(words) < 20 or 100 * rep > 30 * len(words)
        want.append((r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), rep, failed, round(score, 4)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.ratio, 4)) for r in quality.digest(docs, labels).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:7] == w[:7] and abs(g[7] - w[7]) < 2e-4, (g, w)


def test_separates_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = quality.digest(docs, labels).join(labels, "doc_id").where("n_words >= 20").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.4


def test_without_labels_all_ratios_are_zero(spark, sf):
    docs = table(spark, sf, "documents")
    got = quality.digest(docs, table(spark, sf, "labels").limit(0))
    assert got.where("ratio <> 0").count() == 0 and got.count() == docs.count()


def test_decontamination_judges_each_occurrence(spark):
    from cindersift.llm import decontaminate

    ask = "if {} has {} apples and gives {} of them to {} then how many of the apples does {} keep".format
    item, other = ask("Ann", 12, 5, "Bob", "Ann"), ask("Carl", 30, 7, "Dora", "Carl")
    mess = ask("Eve", 3, 4, "Fay", "Gus")
    filler = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(0, f"{item} . {other}"), (1, f"{item} {filler} {other} {filler} {ask('Hal', 8, 2, 'Ida', 'Hal')}"), (2, mess), (3, filler)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.matches(docs, bench).collect()}
    assert {0, 1} <= got and 3 not in got
