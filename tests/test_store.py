"""The snapshot store: runs written twice, out of order or broken off."""

from __future__ import annotations

from cindersift.sources import store


def frame(spark, *rows):
    return spark.createDataFrame(rows, store.SNAPSHOT)


def rows_of(spark, path, **days):
    return sorted((r["ticker"], r["scanned_at"], r["score"], tuple(r["flags"] or ())) for r in store.read_store(spark, path, **days).collect())


def test_a_run_written_twice_gives_each_row_once_and_a_later_one_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one = frame(spark, ("A", "2024-01-01", 1.0, ["x"]), ("B", "2024-01-01", 2.0, []), ("B", "2024-01-02", 3.0, None), (None, "2024-01-02", 1.0, []), ("C", None, 1.0, []))
    store.add_run(one, path, "2024-01-02T10:00")
    store.add_run(one, path, "2024-01-02T10:00")
    want = [("A", "2024-01-01", 1.0, ("x",)), ("B", "2024-01-01", 2.0, ()), ("B", "2024-01-02", 3.0, ())]
    assert rows_of(spark, path) == want
    store.add_run(frame(spark, ("A", "2024-01-01", 9.0, ["y"])), path, "2024-01-03T10:00")
    store.add_run(frame(spark, ("A", "2024-01-01", 5.0, ["z"])), path, "2024-01-01T10:00")  # late, but of an earlier run
    want[0] = ("A", "2024-01-01", 9.0, ("y",))
    assert rows_of(spark, path) == want
    assert rows_of(spark, path, since="2024-01-02") == want[2:]
    plan = store.read_store(spark, path, since="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_compacting_a_day_keeps_the_answer_and_the_other_days(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for run in ("1", "2", "3"):
        store.add_run(frame(spark, ("A", "2024-01-01", float(run), []), ("A", "2024-01-02", float(run), [run])), path, run)
    before = rows_of(spark, path)
    other = sorted((tmp_path / "store" / "day=2024-01-02").glob("*.parquet"))
    store.compact(spark, path, ["2024-01-01"])
    assert rows_of(spark, path) == before
    assert spark.read.parquet(path).where("day = '2024-01-01'").count() == 1
    assert sorted((tmp_path / "store" / "day=2024-01-02").glob("*.parquet")) == other


def test_files_of_a_run_that_broke_off_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.add_run(frame(spark, ("A", "2024-01-01", 1.0, [])), path, "1")
    left = tmp_path / "store" / "_temporary" / "0" / "task" / "day=2024-01-01"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"broken off")
    assert rows_of(spark, path) == [("A", "2024-01-01", 1.0, ())]


def test_an_empty_run(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.add_run(frame(spark, ("A", "2024-01-01", None, None)), path, "1")
    store.add_run(frame(spark, ("A", "2024-01-01", 1.0, [])).limit(0), path, "2")
    assert rows_of(spark, path) == [("A", "2024-01-01", None, ())]
