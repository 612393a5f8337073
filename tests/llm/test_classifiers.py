import textwrap

import numpy as np
from pyspark.sql import functions as F

from cindersift.llm import decontaminate, language, licenses, toxicity
from cindersift.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def test_template_matches_survive_new_numbers_and_names(spark):
    item = "On that day the farmer told Alice that 12 kg of apples cost 30 dollars, so how many apples can Alice buy for 90 dollars in total?"
    same = "intro words here. On that day the farmer told Robert that 7 kg of apples cost 21 dollars, so how many apples can Robert buy for 63 dollars in total? more words."
    mixed = "On that day the farmer told Bob that 7 kg of apples cost 21 dollars, so how many apples can Carol buy for 63 dollars in total?"
    plain = "The farmer went home and nobody asked how many apples there were in the end of that long day."
    docs = spark.createDataFrame([(1, same), (2, item), (3, plain), (4, None), (5, ""), (None, item), (6, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, bench, consistent=0.9).collect()}
    assert set(got) == {1, 2} and got[1].item_id == 7 and got[1].consistency == 1.0
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench, consistent=0.9).collect()} == {3, 4, 5, 6, None}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_planted_benchmark_items_are_found(spark):
    docs, bench = table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if r.text and t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert want <= got and len(got) <= 1.5 * len(want) + 3


def test_a_full_key_map_changes_no_result(spark, monkeypatch):
    docs, bench = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    one = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAP_BITS", 64)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == one


def test_language_accuracy_on_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, "123 !!"), (90004, "жук"), (90005, "½ ² ① Ⅷ"), (None, "the and of with")], "doc_id long, text string")
    got = language.digest(docs.unionByName(odd, allowMissingColumns=True)).join(docs.select("doc_id", "lang"), "doc_id", "left").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97
    by = got.set_index("doc_id").lang_pred
    assert list(by[[90001, 90002, 90003]]) == ["und"] * 3 and by[90005] in (set(held.lang) if any(map(str.isalpha, "½²①Ⅷ")) else {"und"}) and by[90004] in set(held.lang) and got.score.between(0, 1).all()
    assert set(language.digest(docs.withColumn("lang", F.lit(None).cast("string")).limit(20)).toPandas().lang_pred) == {"und"}


def test_backoff_scores_unseen_words_by_their_parts():
    m = language.Model([("a", "zug", 0, 5), ("a", "<zug", 4, 5), ("a", "zu", 2, 5), ("a", "z", 1, 5), ("b", "q", 1, 9), ("b", "qu", 2, 9)])
    assert m.word("zug")[0] > m.word("zug")[1] and m.word("zuzu")[0] > m.word("zuzu")[1] and m.word("quq")[1] > m.word("quq")[0]
    assert not m.word("7").any()


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    some = docs.join(labels, "doc_id", "left_semi")
    got = toxicity.digest(some, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.75 and clean.predicted.mean() < 0.01 and got.score.between(0, 1).all()


def test_interaction_is_learned():
    import numpy as np

    x = [np.array(s) for s in ([1, 2, 9], [1, 9], [2, 9], [9]) for _ in range(60)]
    y = np.array([1.0] * 60 + [0.0] * 180)
    m = toxicity.Machine().fit(x, y, epochs=40)
    assert m.score(np.array([1, 2, 9])) > 0.5 > max(m.score(np.array([1, 9])), m.score(np.array([2, 9])))


def test_toxicity_without_labels(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    odd = docs.unionByName(spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string"), allowMissingColumns=True)
    got = toxicity.digest(odd, labels.limit(0)).toPandas()
    assert len(got) == docs.count() + 2 and (got.predicted == 0).all()


def test_licence_families(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, "Plain words.\nUsed under some licence nobody knows, licensed under terms"), (90001, None)], "doc_id long, text string")
    got = licenses.scan(docs.unionByName(odd, allowMissingColumns=True)).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) + 4
    for cue, family in (("Apache License", "apache"), ("MIT License", "mit"), ("GNU General Public", "gpl"), ("CC BY-NC", "cc-by-nc")):
        hit = got[got.doc_id.map(lambda d, c=cue: c in (texts.get(d) or ""))]
        assert len(hit) and (hit.family == family).all() and hit.confirmed.all()
    quiet = got[~got.doc_id.map(lambda d: any(w in (texts.get(d) or "").lower() for w in ("licen", "copyright", "rights")))]
    assert (quiet[quiet.doc_id != 90003].family == "none").mean() > 0.995


def test_pair_without_marginal_effect_is_learned():
    rng = np.random.default_rng(3)
    filler = [f"f{i}" for i in range(200)]
    known, rows, marks = toxicity.Buckets(), [], []
    for _ in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append(known.of(" ".join([*rng.choice(filler, 12), *["idiot"] * insult, *["people"] * group])))
        marks.append(float(insult == group))
    machine = toxicity.Machine().fit(rows[:1200], np.array(marks[:1200]))
    right = [(machine.score(x) >= 0.5) == y for x, y in zip(rows[1200:], marks[1200:])]
    assert np.mean(right) > 0.95


def test_labels_both_ways_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "bad awful words" if i % 2 else "good plain words") for i in range(60)] + [(61, None), (61, None), (None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    one, two = (sorted((r.doc_id or -1, r.score) for r in toxicity.digest(d, labels).collect()) for d in (docs, docs.orderBy(F.desc("doc_id"))))
    assert one == two and len(one) == 63
    assert toxicity.digest(docs.limit(0), labels).count() == 0 and {r.predicted for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0}


def test_wrapped_notices_are_paragraphs(spark):
    plain = [(100 + i, f"ordinary line {i} about rivers and stones\nanother one about the {w} that fell") for i, w in enumerate("rain snow leaf roof star bell".split() * 8)]
    notices = {family: max(wordings, key=len) for family, wordings in licenses.TEMPLATES.items() if family in ("mit", "bsd", "gpl", "apache")}
    rows = []
    for k, (family, text) in enumerate(sorted(notices.items())):
        for w, mark in ((76, ""), (60, "# "), (70, " * ")):
            rows.append((10 * k + w % 7, "\n".join(mark + line for line in textwrap.wrap(text, w)), family))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + plain + [(None, None), (999, "")], "doc_id long, text string")
    got = licenses.scan(docs)
    found = {r.doc_id: r for r in got.collect()}
    assert [(k, found[k].family, found[k].confirmed) for k, _, _ in rows] == [(k, f, True) for k, _, f in rows]
    assert all(found[k].family == "none" for k, _ in plain) and found[999].family == found[None].family == "none"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_never_seen_are_unknown_and_prose_is_none(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    zlib = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    mozilla = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    unlicense = "This is free and unencumbered software released into the public domain."
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."
    prose = ["The hall was reserved for the evening, permission came late and drinks were free of charge.", "Public software projects often change their terms without telling anyone.", "She asked for permission to copy the file and was told to wait.", "All the rights he had were reserved for his children."]
    known = {"mit": "Released under the MIT License.", "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "proprietary": "All rights reserved."}
    rows = [(i, t) for i, t in enumerate([isc, zlib, mozilla, unlicense, lesser])] + [(100 + i, t) for i, t in enumerate(prose)] + [(200 + i, t) for i, t in enumerate(known.values())]
    model = licenses.train(spark, table(spark, FOLDER, "documents"))
    found = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    assert [found[i] for i in range(5)] == ["unknown"] * 5
    assert [found[100 + i] for i in range(len(prose))] == ["none"] * len(prose)
    assert [found[200 + i] for i in range(len(known))] == list(known)


def test_toxicity_with_ids_of_text_and_repeated_ids(spark):
    docs = spark.createDataFrame([(f"d{i // 2}", f"bad awful words {i}" if i // 2 % 2 else f"good plain words {i}") for i in range(120)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.digest(d, labels).collect()) for d in (docs, docs.orderBy(F.desc("text"))))
    assert one == two and len(one) == 120


def test_telling_pairs_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = [np.unique(rng.integers(0, 1 << toxicity.BITS, 40 if k % 20 else 20000)) for k in range(400)]
    labels = np.array([float(k % 20 == 0) for k in range(400)])
    for k in range(100, 300):
        texts[k] = np.unique(np.append(texts[k], [5, 9] if labels[k] else [5 if k % 2 else 9]))
    tracemalloc.start()
    known = toxicity._telling(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert known[5] and known[9] and peak < 150e6
