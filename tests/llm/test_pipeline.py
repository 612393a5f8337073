import pytest

import __spark_entry__
import corpus_pipeline
from cindersift.llm import decontaminate, language, licenses, mixing, near_dup, passages, quality, secrets, toxicity
from cindersift.llm.common import table

CLASH = ["row", "key", "doc", "a", "b", "label", "node", "tokens", "term", "rate", "copies", "secrets", "kept", "row_pos"]


def clashing(docs):
    for c in CLASH:
        docs = docs.withColumn(c, docs.text)
    return docs


def test_stages_keep_what_they_should(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(before)
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in quality.digest(docs, table(spark, sf, "labels")).collect()}
            assert set(rows) == {d for d, k in verdict.items() if k}
        elif name == "near_duplicates":
            assert set(rows) == {r.class_id for r in near_dup.classes(docs).collect()}
        elif name == "decontamination":
            assert set(before) - set(rows) == {r.doc_id for r in decontaminate.matches(docs, table(spark, sf, "benchmark")).collect()}
        else:
            assert set(rows) == set(before) and all(rows[d].text == before[d].text or "[SECRET]" in rows[d].text for d in rows)
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    last = corpus_pipeline.mix(spark, docs, sf).collect()
    want = {r.doc_id: r.copies for r in mixing.digest(docs).collect() if r.copies}
    assert {r.doc_id: r.mix_copies for r in last} == want


def test_run_is_the_stages_one_after_another(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= table(spark, sf, "documents").count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["secrets", "redact", "quality", "near_dup", "keep_one", "passages", "decontaminate", "mixing", "language", "toxicity", "licenses"])
def test_columns_may_have_any_name(spark, sf, name):
    docs = table(spark, sf, "documents").limit(60)
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    run = {
        "secrets": secrets.digest, "redact": secrets.redact, "quality": lambda d: quality.digest(d, labels), "near_dup": near_dup.classes, "keep_one": near_dup.keep_one, "passages": passages.repeated,
        "decontaminate": lambda d: decontaminate.matches(d, bench), "mixing": mixing.digest, "language": language.digest, "toxicity": lambda d: toxicity.digest(d, labels), "licenses": licenses.scan,
    }[name]
    few = run(docs).count()
    assert run(clashing(docs)).count() == few
