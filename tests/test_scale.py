"""Ranks, as-of lookups, phrase search, archives and shared relations against plain Python."""

from __future__ import annotations

import bisect
import datetime
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from cindersift.operators import ordering, search
from cindersift.operators.asof import nearest
from cindersift.operators.shared import scope, settled, share
from cindersift.plans import derived, scan
from cindersift.sources import archive

DAY0 = datetime.date(2000, 1, 1)


def day(n):
    return None if n is None else (DAY0 + datetime.timedelta(days=n)).isoformat()


def _near(asked, points, before, after):
    best = {}
    for key, d, name, v in points:
        if key is not None and d is not None:
            best[key, d] = min(best.get((key, d), (name, v)), (name, v))
    out = []
    for key, d, label in asked:
        found = [(abs(p - d), best[k, p], p - d) for (k, p) in best if k == key and d is not None and -before <= p - d <= after]
        out.append((label, *((min(found)[1][1], min(found)[2]) if found else (None, None))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equals_a_search_over_all_pairs(spark, seed):
    r = random.Random(seed)
    points = [(r.choice(["a", "b", None]), r.choice([None, *range(60)]), r.choice("xyz"), float(k)) for k in range(80)]
    asked = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(70)]), k) for k in range(60)]
    p = spark.createDataFrame([(k, day(d), n, v) for k, d, n, v in points], "key string, at string, name string, v double")
    q = spark.createDataFrame([(k, day(d), n) for k, d, n in asked], "key string, day string, label long")
    got = nearest(q, p, ["key"], F.to_date("day"), F.to_date("at"), 4, 9, [F.col("name"), F.col("v")], ["v"])
    assert sorted((x["label"], x["v"], x["delta"]) for x in got.collect()) == _near(asked, points, 4, 9)


def test_nearest_of_a_company_with_very_many_points_sorts_and_does_not_pair(spark):
    n = 100_000
    points = spark.range(n).select(F.lit("a").alias("key"), F.date_add(F.lit(DAY0), (F.col("id") * 2).cast("int")).alias("at"), F.col("id").cast("double").alias("v"))
    asked = spark.range(n).select(F.lit("a").alias("key"), F.date_add(F.lit(DAY0), (F.col("id") * 2 + 1).cast("int")).alias("day"), "id")
    got = nearest(asked, points, ["key"], F.col("day"), F.col("at"), 45, 180, [F.col("v")], ["v"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("v = id").count() == n  # of two days equally near the one with the smaller value


def test_nearest_without_rows(spark):
    p = spark.createDataFrame([], "key string, at date, v double")
    q = spark.createDataFrame([("a", DAY0)], "key string, day date")
    assert nearest(q, p, ["key"], F.col("day"), F.col("at"), 1, 1, [F.col("v")], ["v"]).collect()[0]["v"] is None
    assert nearest(q.limit(0), p, ["key"], F.col("day"), F.col("at"), 1, 1, [F.col("v")], ["v"]).count() == 0


ROWS = [(g, v, k) for k, (g, v) in enumerate([("a", 3.0), ("a", 3.0), ("a", 1.0), ("a", None), ("b", 2.0), (None, 5.0), (None, 4.0), ("a", 3.0), ("c", None)] + [("big", float(k % 7)) for k in range(400)])]


def test_percentile_of_ties_in_groups_of_any_size(spark):
    df = spark.createDataFrame(ROWS, "g string, v double, k long")
    got = {x["k"]: x["pct"] for x in ordering.percentile(df, "v", ["g"]).collect()}
    for g, v, k in ROWS:
        all_ = sorted(x for h, x, _ in ROWS if h == g and x is not None)
        want = None if v is None else (bisect.bisect_left(all_, v) + 1 + bisect.bisect_right(all_, v)) / 2 / len(all_)
        assert got[k] == pytest.approx(want) if want is not None else got[k] is None
    assert len(got) == len(ROWS)


def test_rank_and_size_within_groups(spark):
    df = spark.createDataFrame(ROWS, "g string, v double, k long")
    got = ordering.group_sizes(ordering.global_rank(df, ["g"], [F.desc_nulls_last("v"), F.asc("k")]), ["g"], "n").collect()
    for x in got:
        mine = sorted((r for r in ROWS if r[0] == x["g"]), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert (x["rank"], x["n"]) == ([r[2] for r in mine].index(x["k"]) + 1, len(mine))
    assert len(got) == len(ROWS)


def test_no_window_holds_a_whole_group(spark):
    df = spark.createDataFrame(ROWS, "g string, v double, k long")
    plan = ordering.global_rank(df, ["g"], [F.asc("v"), F.asc("k")])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("_part" in w for w in windows)


WORDS = "the quick bid price minimum regain compliance Überflug naïve 7 x-y don't".split()


def test_search_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, r.randrange(3), r.choice(["8-K", "S-1", None]), r.choice([None, "2023-01-01", "2023-06-01"]), " ".join(r.choice(WORDS) + r.choice(["", ",", ".\n", "  "]) for _ in range(r.randrange(40)))) for k in range(150)]
    rows += [(200, 0, "8-K", "2023-01-01", None), (201, 0, "8-K", "2023-01-01", ""), (202, 0, "8-K", "2023-01-01", "-- !!"), (203, 1, "8-K", "2023-06-01", "the " * 5000 + "bid")]
    docs = spark.createDataFrame(rows, "doc_id long, cik long, form string, filing_date string, text string")
    asked = [search.Search("a", ("Minimum BID price",)), search.Search("b", ("the the", "x y", "über­flug"), ("8-K",)), search.Search("c", ("the",), ("8-K", "S-1"), 1, "2023-02-01", "2023-12-31"), search.Search("d", ("nowhere here", "", "?!")), search.Search("e", ("don t",), (), None, None, "2023-03-01")]
    path = f"file://{tmp_path}/index"
    search.write_index(docs, path, parts=4)
    got = sorted((x["search"], x["doc_id"]) for x in search.search(search.open_index(spark, path), docs.drop("text"), asked, parts=4).collect())
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    holds = lambda have, p: bool(p) and any(have[i : i + len(p)] == p for i in range(len(have)))
    want = sorted(
        (s.name, k) for s in asked for k, cik, form, date, text in rows
        if any(holds(cut(text), cut(p)) for p in s.phrases) and (not s.forms or form in s.forms) and s.cik in (None, cik) and (s.since is None or (date or "") >= s.since) and (s.until is None or (date is not None and date <= s.until))
    )
    assert got == want and len(want) > 50


def test_a_phrase_does_not_run_from_one_text_of_an_id_to_the_next(spark, tmp_path):
    docs = spark.createDataFrame([(1, "minimum bid"), (1, "price up"), (None, "minimum bid price")], "doc_id long, text string")
    search.write_index(docs, f"file://{tmp_path}/i")
    index = search.open_index(spark, f"file://{tmp_path}/i")
    assert search.phrase_rows(index, [search.Search("a", ("bid price",))]).count() == 0
    assert [tuple(x) for x in search.phrase_rows(index, [search.Search("a", ("minimum bid",)), search.Search("b", ("up",))]).orderBy("search").collect()] == [("a", 1), ("b", 1)]


def test_a_search_opens_only_the_parts_of_its_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(50)], "doc_id long, text string")
    search.write_index(docs, f"file://{tmp_path}/i")
    plan = search.phrase_rows(search.open_index(spark, f"file://{tmp_path}/i"), [search.Search("a", ("w3 w4",))])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or re.search(r"PartitionFilters: \[[^\]]*part", plan)
    assert re.search(r"PushedFilters: \[[^\]]*token", plan)


def test_archives_are_read_back_and_bad_members_are_told(spark, tmp_path):
    folder = tmp_path / "archives"
    rows = [(f"CIK{k:010d}.json", '{"cik":"%d","facts":{"us-gaap":{"Assets":{"units":{"USD":[{"end":"2020-12-31","val":%d}]}}}}}' % (k, k)) for k in range(40)]
    archive.write_archives(spark.createDataFrame([*rows, (None, "x"), ("none", None)], "member string, value string").repartition(3), str(folder))
    assert len(list(folder.glob("part-*.zip"))) == 3 and not list(folder.glob("_pending*"))
    got = archive.read_archives(spark, f"file://{folder}", partition_bytes=200)
    assert got.rdd.getNumPartitions() > 10
    assert sorted((x["member"], x["value"]) for x in got.collect()) == sorted(rows)
    with zipfile.ZipFile(folder / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("broken.json", "{" * 900)
        z.writestr("half.json", '{"cik":"1","fac')
        z.writestr("large.json", "x" * 5000)
        z.writestr("latin.json", b"\xff\xfe")
        z.writestr("folder/", "")
    data = bytearray((folder / "b.zip").read_bytes())
    data[45] ^= 255
    (folder / "b.zip").write_bytes(bytes(data))
    (folder / "c.zip").write_bytes(b"no archive")
    found, failed = archive.bulk_facts(archive.read_archives(spark, str(folder), member_bytes=4000))
    assert sorted((x["cik"], x["val"]) for x in found.collect()) == sorted((f"{k:010d}", float(k)) for k in range(40))
    told = {(x["archive"].rsplit("/", 1)[1], x["member"]): x["failure"] for x in failed.collect()}
    assert set(told) == {("b.zip", "broken.json"), ("b.zip", "half.json"), ("b.zip", "large.json"), ("b.zip", "latin.json"), ("c.zip", None)}
    assert "4000" in told["b.zip", "large.json"] and told["b.zip", "half.json"] == "unreadable payload" and "archive" in told["c.zip", None]


def test_an_archive_that_is_not_committed_is_not_read(spark, tmp_path):
    writer = archive.ArchiveWriter(str(tmp_path))
    message = writer.write(iter([{"member": "a.json", "value": "{}"}]))
    assert archive.read_archives(spark, str(tmp_path)).count() == 0
    writer.abort([message, None])
    assert list(tmp_path.iterdir()) == []
    writer.commit([writer.write(iter([{"member": "a.json", "value": "{}"}])), None])
    assert [x["value"] for x in archive.read_archives(spark, str(tmp_path)).collect()] == ["{}"]


def kept(spark):
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_what_a_scope_shares_is_let_go(spark):
    before = kept(spark)
    with scope():
        df = share(spark.range(10))
        out = settled(df.join(df.withColumnRenamed("id", "b"), F.col("id") == F.col("b")))
        assert kept(spark) == before + 1
    with pytest.raises(ValueError), scope():
        share(spark.range(3)).count()
        raise ValueError
    assert kept(spark) == before and out.count() == 10
    assert share(df) is df and kept(spark) == before


def test_the_scan_reads_each_table_once(spark, sf, monkeypatch):
    plans = []
    monkeypatch.setattr(scan, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    before = kept(spark)
    scan.signals(spark, sf)
    assert kept(spark) == before
    assert plans[0].count("Relation [l_") <= 1  # the others are read from what is kept
    reads = []
    real = derived.table
    monkeypatch.setattr(derived, "table", lambda s, f, name: reads.append(name) or real(s, f, name))
    scan.signals(spark, sf)
    assert sorted(reads) == ["documents", "events", "lineitem", "nation", "orders", "region", "supplier"]


def test_summed_transactions_give_the_same_profiles(spark, sf):
    from cindersift.operators import insider

    one = insider.profile(derived.transactions(spark, sf))
    two = insider.profile(derived.summed_transactions(derived.activity(spark, sf)), times="times")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
