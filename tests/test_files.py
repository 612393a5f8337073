"""CSV files with a header each, and the counts that are taken while a scan is written."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cindersift.plans import scan
from cindersift.sources import headed, sinks

NASTY = [("plain", 1.5), ('quote " and, comma', None), ("two\nlines\r\nthree", -0.0), ("", 2.0), (None, 1e300), ("# no comment", 3.0), ("ünï 😀", 4.0)]
NAMES = ("na,me", 'qu"ote')


def frame(spark, rows=NASTY):
    return spark.createDataFrame(rows, "a string, b double").toDF(*NAMES)


def parts(path):
    return sorted(path.glob("*.csv"))


def test_files_read_back_equal(spark, tmp_path):
    df = frame(spark, NASTY * 3).repartition(3)
    sinks.write_csv(df, f"file://{tmp_path}/c")
    back = headed.read_headed(spark, f"file://{tmp_path}/c", df.schema)
    key = lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0.0)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, df.collect()), key=key)
    files = parts(tmp_path / "c")
    assert len(files) == 3
    for f in files:
        head = f.read_text().split("\n")[:2]
        assert head == [f"# {sinks.DISCLAIMER}", '"na,me","qu""ote"']
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == [p.name for p in files]


def test_overwriting_appending_and_nothing_to_write(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    headed.write_headed(frame(spark).coalesce(1), path)
    headed.write_headed(frame(spark, NASTY[:2]).coalesce(1), path, mode="append")
    read = lambda: headed.read_headed(spark, path, frame(spark).schema).count()
    assert read() == len(NASTY) + 2
    headed.write_headed(frame(spark, NASTY[:1]), path)
    assert read() == 1 and len(parts(tmp_path / "c")) == 1
    headed.write_headed(frame(spark).limit(0), path, "two\nlines")
    assert read() == 0 and [p.read_text() for p in parts(tmp_path / "c")] == ['# two\n# lines\n"na,me","qu""ote"\n']


def test_a_job_that_fails_leaves_the_files_as_they_were(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    headed.write_headed(frame(spark).coalesce(1), path)
    before = [p.read_text() for p in parts(tmp_path / "c")]
    bad = frame(spark).repartition(2).withColumn("c", F.raise_error("broken"))
    with pytest.raises(Exception, match="broken"):
        headed.write_headed(bad, path)
    assert [p.read_text() for p in parts(tmp_path / "c")] == before


def test_counts_are_taken_while_the_scan_is_written(spark, sf, tmp_path):
    ranked, excluded = scan.run(scan.signals(spark, sf), scan.Request(no_serial_splitter=True))
    failures = spark.createDataFrame([("ZZZ", "no answer")], "ticker string, reason string")
    assert sinks.write_scan(ranked, excluded, str(tmp_path / "s"), failures, preset="penny")
    meta = json.loads(spark.read.text(str(tmp_path / "s/meta")).first().value)
    n, out = ranked.count(), {r.reason: r["count"] for r in excluded.groupBy("reason").count().collect()}
    assert meta["universe_counts"] == {"scanned": n + sum(out.values()) + 1, "ranked": n, "gated": ranked.where("gated").count(), "evidence_complete": ranked.where("size(suppressed) = 0").count(), "excluded": sum(out.values()), "failed": 1}
    assert meta["excluded_by_reason"] == out and meta["preset"] == "penny"
    assert meta["suppressed_by_module"] == {r.m: r["count"] for r in ranked.select(F.explode("suppressed").alias("m")).groupBy("m").count().collect()}
    assert spark.read.json(str(tmp_path / "s/failures")).first().ticker == "ZZZ"
