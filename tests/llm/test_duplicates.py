import random

import numpy as np
import pandas as pd
import pytest

from cindersift.llm import near_dup, passages
from cindersift.llm.graph import components
from cindersift.llm.tokens import WordHashes, runs


def corpus(seed=3, n=30, size=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    return rng, [[rng.choice(vocab) for _ in range(size)] for _ in range(n)]


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[i] = f"e{rng.randrange(9999)}"
        elif kind < 0.75:
            out.insert(i, f"e{rng.randrange(9999)}")
        else:
            del out[i]
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_agrees_with_full_edit_distance():
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randrange(9) for _ in range(rng.randrange(1, 60))]
        b = edited(rng, a, rng.randrange(0, len(a) // 3 + 2)) or [1]
        code = {w: i for i, w in enumerate({str(x) for x in a + b})}
        x, y = (np.array([code[str(w)] for w in s], np.uint64) for s in (a, b))
        assert near_dup.alike(x, y, 0.8) == (distance(list(x), list(y)) <= int(0.2 * max(len(x), len(y)) + 1e-9))


def test_classes_hold_all_close_pairs_and_no_others(spark):
    rng, base = corpus()
    texts = [" ".join(b) for b in base]
    want = list(range(len(texts)))
    for i in range(12):
        texts += [" ".join(edited(rng, base[i], 1)), " ".join(base[i]).upper()]
        want += [i, i]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1003, "one"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == dict(enumerate(want)) | {1000: 1000, 1001: 1001, 1002: 1002, 1003: 1002}
    kept = near_dup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == list(range(len(base))) + [1000, 1001, 1002]
    assert sum(r.doc_id is None for r in kept) == 1


def test_hot_group_of_copies_is_one_class(spark):
    rng, base = corpus(9, 1)
    docs = spark.createDataFrame([(i, " ".join(base[0] if i % 3 else edited(rng, base[0], 2))) for i in range(300)], "doc_id long, text string")
    assert {r.class_id for r in near_dup.classes(docs).collect()} == {0}


def test_near_pairs_inside_a_boilerplate_group_are_found(spark):
    rng, (shared, *own) = corpus(21, 61)
    own = [w[:18] for w in own]
    texts = [shared + w for w in own]
    pairs = [(k, k + 20) for k in range(15, 35)]
    for a, b in pairs:
        texts[b] = edited(rng, texts[a], 1)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # At 0.95 texts that share nine tenths of their words are unlike, and so are all heads.
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs, least=0.95).collect()}
    assert got == {i: i for i in range(60)} | {b: a for a, b in pairs}

def test_classes_do_not_depend_on_the_size_of_table_or_groups(spark, monkeypatch):
    rng, (shared, *own) = corpus(33, 81, 60)
    texts = [own[k][:40] + shared[:30] for k in range(60)]
    for a in range(10, 30):
        texts[a + 25] = edited(rng, texts[a], 6)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = [set(near_dup.sketches(code(t), np.array([len(t)]))[0].tolist()) for t in texts]
    near = [(b, a) for a in range(60) for b in range(a) if sketch[a] & sketch[b] and near_dup.alike(code(texts[a]), code(texts[b]))]
    label = list(range(60))
    for a, b in sorted(near):
        label = [label[a] if x == label[b] else x for x in label]
    assert sum(i != x for i, x in enumerate(label)) >= 10
    for paired in (2, 1000):
        monkeypatch.setattr(near_dup, "PAIRED", paired)
        got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
        assert got == {i: min(j for j in range(60) if label[j] == label[i]) for i in range(60)}, paired


def test_unlike_texts_of_a_large_group_make_no_rows(spark, monkeypatch):
    rng, (shared, *own) = corpus(34, 201, 160)
    texts = [own[k][:40] + shared[:120] for k in range(200)]
    for a in range(60, 90):
        texts[a + 60] = edited(rng, texts[a], 8)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    counts, compared = [], near_dup._compared

    def counted(links, *rest):
        counts.append(links.count())
        return compared(links, *rest)

    monkeypatch.setattr(near_dup, "_compared", counted)
    want = {i: i for i in range(200)} | {a + 60: a for a in range(60, 90)}
    for block in (2048, 40):  # a group is one block; groups are parted by rare k-mers and dealt to several blocks
        monkeypatch.setattr(near_dup, "BLOCK", block)
        counts.clear()
        assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == want, block
        assert max(counts[2:]) < 5 * len(texts), (block, counts)


def code(words):
    return WordHashes().of([w.lower() for w in words])


def test_recall_at_the_threshold():
    rng = random.Random(8)
    code = lambda words: np.array([hash(w) & (2**64 - 1) for w in words], np.uint64)
    for size in (20, 60, 300):
        met = total = 0
        for _ in range(150):
            a = [f"w{rng.randrange(4000)}" for _ in range(size)]
            b = edited(rng, a, max(1, int(0.14 * size)))
            x, y = code(a), code(b)
            if near_dup.alike(x, y):
                one, two = near_dup.sketches(np.concatenate([x, y]), np.array([len(x), len(y)]))
                total += 1
                met += bool(set(one) & set(two))
        assert total >= 100 and met >= 0.9 * total, (size, met, total)


def test_band_bounds_the_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(30))]
        b = [rng.randrange(5) for _ in range(rng.randrange(30))]
        want = distance(a, b)
        for w in (1, 4, 40):
            got = near_dup.banded(a, b, w)
            assert got == want if want <= w else got >= want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(20)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: min(y for y in parent if find(y) == find(x)) for x in parent if sum(find(y) == find(x) for y in parent) > 1}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_repeated_passages_against_brute_force(spark):
    rng, base = corpus(11, 14, 220)
    passage, other = base[0][20:90], base[1][10:75]
    for i in (3, 4, 5):
        base[i][50:50] = passage
    base[6][0:0] = other
    base[7].extend(edited(rng, other, 1))
    base[8] = base[8][:100] + base[8][20:90] + base[8][100:]  # inside one document alone
    base[9][30:30] = passage[:30]  # too short
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(50, None), (51, ""), (52, "short text"), (None, " ".join(base[0]))]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    width = passages.LEAST
    code = {w: i for i, w in enumerate({w for b in base for w in b})}
    tokens = [runs(np.array([code[w] for w in b], np.uint64), passages.SHINGLE) for b in base]
    sets = [[frozenset(t[s : s + width].tolist()) for s in range(len(t) - width + 1)] for t in tokens]
    linked = {i: set() for i in range(len(base))}
    for i in range(len(base)):
        for j in range(i):
            for s, x in enumerate(sets[i]):
                if any(len(x & y) >= 0.8 * len(x | y) for y in sets[j]):
                    linked[i].add(j)
                    linked[j].add(i)
                    break
    assert {r.doc_id for r in got} == {i for i, v in linked.items() if v} == {0, 1, 3, 4, 5, 6, 7}
    by_doc = {r.doc_id: r for r in got}
    assert {by_doc[i].class_id for i in (0, 3, 4, 5)} == {0} and {by_doc[i].class_id for i in (1, 6, 7)} == {1}
    assert by_doc[3].n_docs == 4 and by_doc[3].start_word <= 50 and by_doc[3].end_word >= 120
    assert by_doc[0].start_word <= 20 and by_doc[0].end_word >= 90


def test_passages_that_share_only_keys_with_unlike_heads(spark):
    # Every key that 400 and 401 share has a smaller and a larger document with 44 of its 50 words at most.
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(4000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = some(50)
    docs = {k: some(30) + shared + some(30) for k in (400, 401)}
    docs |= {k: some(30) + shared[k % 4 :][: 44 - k % 3] + some(30) for k in (*range(6), *range(990, 996))}
    got = passages.repeated(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {400: 400, 401: 400}


def test_unlike_windows_of_one_key_make_few_links(spark, monkeypatch):
    # All documents share 40 words, too few to be alike, so all their windows of those keys differ; two have the 50 whole.
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(9000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = some(50)
    docs = {k: some(30) + shared[5:45] + some(30) for k in range(80)} | {k: some(30) + shared + some(30) for k in (40, 41)}
    compared, links = passages._compared, []
    monkeypatch.setattr(passages, "_compared", lambda asked, *more: links.append(asked.count()) or compared(asked, *more))
    got = passages.repeated(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {40: 40, 41: 40}
    assert sum(links) < 6 * len(docs)


@pytest.mark.parametrize("width,letters", [(10, 9), (10, 400), (46, 5000)])
def test_alike_starts_share_a_first_token(width, letters):
    rng = random.Random(width * letters)
    alike = 0
    for _ in range(150):
        x = [rng.randrange(letters) for _ in range(width + rng.randrange(12))]
        y = list(x)
        for _ in range(rng.randrange(4)):
            y[rng.randrange(len(y))] = rng.randrange(letters)
        often = np.array(rng.sample(x, min(4, len(x))), np.int64)
        whole = len(set(x)) == len(x) and len(set(y)) == len(y)
        flat = np.array(x + y, np.uint64)
        piece = np.repeat([0, 1], [len(x), len(y)])
        at = passages.first_tokens(flat, piece, [often, often], np.array([whole, whole]), width, passages.SIMILAR)
        met = set(flat[at[at < len(x)]].tolist()) & set(flat[at[at >= len(x)]].tolist())
        found = [set(x[s : s + width]) for s in range(len(x) - width + 1)], [set(y[s : s + width]) for s in range(len(y) - width + 1)]
        if any(len(a & b) >= 0.8 * len(a | b) for a in found[0] for b in found[1]):
            alike += 1
            assert met
    assert alike > 30


@pytest.mark.parametrize("letters", [3, 8, 30, 300])
def test_similar_starts_of_texts_that_repeat_words(letters):
    rng = random.Random(letters)
    for _ in range(100):
        x = [rng.randrange(letters) for _ in range(rng.randint(10, 60))]
        y = [v if rng.random() < 0.9 else rng.randrange(letters) for v in x] + [1] * rng.randrange(2)
        sets = [[set(z[s : s + 10]) for s in range(len(z) - 9)] for z in (x, y)]
        want = [s for s, (a, b) in enumerate(zip(*sets, strict=False)) if len(a & b) >= 0.8 * len(a | b)]
        assert passages.similar_starts(np.array(x, np.uint64), np.array(y, np.uint64), 10, 0.8).tolist() == want


def test_pairs_are_verified_at_once(monkeypatch):
    rng = random.Random(6)
    rows, want, slow = [], [], 0
    for k in range(300):
        letters = rng.choice([1, 2, 3, 4000, 100_000])
        one = [rng.randrange(letters) for _ in range(rng.randrange(10, 60))]
        two = [w if rng.random() < 0.95 else rng.randrange(letters) for w in one][: rng.randrange(8, 70)] + [1] * rng.randrange(2)
        rows.append((k, 1000 + k, 5 * k, k - 9, np.array(one, np.int32), np.array(two, np.int32)))
        x, y = (runs(np.array(w, np.int64).view(np.uint64), passages.SHINGLE) for w in (one, two))
        n = min(len(x), len(y))
        starts = passages.similar_starts(x, y, 10, 0.8).tolist() if min(len(one), len(two)) >= 14 else []
        slow += one != two and bool(len(set(x[:n].tolist())) < n or len(set(y[:n].tolist())) < n)
        for s in starts:
            if s - 1 not in starts:
                e = next(e for e in range(s, 99) if e + 1 not in starts)
                want.append((k, 5 * k + s, 5 * k + e + 14, 1000 + k, 5 * k + s + k - 9, 5 * k + e + 14 + k - 9))
    called, similar = [], passages.similar_starts
    monkeypatch.setattr(passages, "similar_starts", lambda *x: called.append(1) or similar(*x))
    batch = pd.DataFrame(rows, columns=["a", "b", "lo", "shift", "words_a", "words_b"])
    got = pd.concat(passages._verified(10, 0.8)(iter([batch, batch[:0]])))
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want) and len(want) > 100
    assert slow > 50 and not called  # none is compared one by one


def test_groups_are_met_without_a_join(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(near_dup, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    groups = spark.createDataFrame([(n, k) for k, ns in {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2], 4: [5], 5: [2, 4, 3, 1]}.items() for n in ns], "node long, key long")
    got = sorted(tuple(r) for r in near_dup._met(groups).select("key", "node", "lo", "hi", "size").collect())
    assert got == sorted([(1, n, 1, 3, 3) for n in (1, 2, 3)] + [(3, n, 1, 2, 2) for n in (1, 2)] + [(5, n, 1, 4, 4) for n in (1, 2, 3, 4)])
    assert not any("Join" in p for p in plans)


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    _, base = corpus(5, 12)
    rows = [(i, " ".join(b)) for i, b in enumerate([*base, base[0], base[3]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dup.keep_one(spark.read.parquet(str(tmp_path / "docs")))
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in kept.collect()} == set(range(12))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_tables_of_ids_have_few_files(spark):
    rng, base = corpus(41, 200, 40)
    base[100:] = [edited(rng, b, 1) for b in base[:100]]
    docs = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base)], "doc_id long, text string")
    links = spark.createDataFrame([(i + 100, j) for i in range(100) for j in (i, (i + 1) % 100)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        alike = near_dup._compared(links, None, docs, near_dup.SIMILAR)
        named = components(alike)
        assert {(r.a, r.b) for r in alike.collect()} == {(i + 100, i) for i in range(100)}
        assert {r.node: r.label for r in named.collect()} == {i: i % 100 for i in range(200)}
        cores = spark.sparkContext.defaultParallelism
        assert len(named.inputFiles()) <= cores and len(alike.inputFiles()) <= 2 * cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert passages.repeated(none).count() == 0 and near_dup.classes(none).count() == 0 and near_dup.keep_one(none).count() == 0
