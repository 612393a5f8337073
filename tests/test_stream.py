"""Streams: snapshots in any order, late rows, windows of item codes."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from cindersift.operators import watch
from cindersift.streaming import tape


def run(df, path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def told(df):
    return sorted((r.ticker, r.scanned_at, r.score, None if r.delta is None else round(r.delta, 9), tuple(r.new_flags), tuple(r.cleared_flags)) for r in df.collect())


def test_shuffled_rows_of_one_trigger_equal_the_batch(spark):
    rnd = random.Random(7)
    day = lambda i: (datetime.date(2023, 1, 1) + datetime.timedelta(days=i)).isoformat()
    rows = [(t, day(i), None if rnd.random() < 0.1 else float(rnd.randrange(100)), rnd.sample("vwxyz", rnd.randrange(4))) for t in ("A", "B", "C") for i in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, tape.SNAPSHOT).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # a ticker's rows come in several batches
    try:
        got = told(tape.replayed(df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == told(watch.diff(df)) and len(got) == 180


def test_order_over_triggers_ties_nulls_and_late_rows(spark, tmp_path):
    triggers = [
        [("A", "2024-01-05", 5.0, ["x"]), ("A", "2024-01-01", 1.0, None), ("A", "2024-01-05", 4.0, ["y"]), (None, "2024-01-01", 1.0, []), ("A", "no time", 1.0, [])],
        [("A", "2024-01-03", 3.0, ["x"]), ("B", "2024-01-20", 9.0, ["z"]), ("A", "2024-01-05", None, ["q"])],
        [("A", "2024-01-02", 2.0, ["in time"]), ("A", "2024-01-25", 8.0, []), ("B", "2024-03-01", 1.0, [])],  # nothing of A was told yet
        [("A", "2024-01-04", 2.0, ["late"])],
    ]
    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, tape.SNAPSHOT).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    src = spark.readStream.schema(tape.SNAPSHOT).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    with tape.ordered_state(spark):
        got = told(run(tape.ordered_diffs(src, "10 days"), tmp_path, "ordered"))
    assert got == [
        ("A", "2024-01-01", 1.0, None, (), ()), ("A", "2024-01-02", 2.0, 1.0, ("in time",), ()), ("A", "2024-01-03", 3.0, 1.0, ("x",), ("in time",)), ("A", "2024-01-05", 5.0, 2.0, (), ()),
        ("A", "2024-01-25", 8.0, 3.0, (), ("x",)), ("B", "2024-01-20", 9.0, None, (), ()),
    ]
    assert spark.conf.get(tape.STORE[0]) != tape.STORE[1]


class Store:
    """A state variable or a timer service in memory that counts its calls."""

    def __init__(self):
        self.calls, self.rows, self.kept = 0, [], {}

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "appendList":
                self.rows += args[0]
            elif name == "put":
                self.rows = list(args[0])
            elif name == "get":
                return iter(self.rows)
            elif name == "updateValue":
                self.kept[args[0]] = args[1]
            elif name == "containsKey":
                return args[0] in self.kept
            return False

        return call


def test_calls_of_the_state_store_do_not_grow_with_the_rows_of_a_ticker():
    waiting, other = Store(), Store()
    other.getMapState = other.getListState = lambda *a: waiting
    other.getValueState = lambda *a: other
    diff = tape.OrderedDiff()
    diff.init(other)
    rows = [Row(at=i, scanned_at=str(i), score=1.0, flags=["x"]) for i in range(500)]
    assert list(diff.handleInputRows(("A",), iter(rows), None)) == []
    assert waiting.calls + other.calls < 10


def test_an_empty_stream_tells_nothing(spark):
    assert tape.replayed(spark.createDataFrame([], tape.SNAPSHOT)).count() == 0


def test_windowed_counts_equal_the_batch_but_for_late_filings(spark, tmp_path):
    kind = "cik long, ts timestamp, items string"
    at = lambda *d: datetime.datetime(2024, *d)
    first = [(1, at(1, 5), "1.01, 3.02"), (1, at(1, 7), "1.01"), (2, at(2, 1), None), (2, at(6, 1), "4.02")]
    second = [(1, at(5, 20), "2.02")]
    late = [(1, at(1, 6), "5.02")]  # its window is closed by then
    closing = [(9, at(12, 31), "8.01")]
    for rows in (first, second, late, closing):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    sizes = ("30 days", "30 days", "30 days")
    cells = lambda df: sorted((str(r.start), r.cik, r.code, r["count"]) for r in df.collect())
    got = cells(run(tape.windowed_counts(src, *sizes), tmp_path, "windows"))
    want = cells(tape.windowed_counts(spark.createDataFrame(first + second, kind), *sizes))
    assert got == want and sum(n for *_, n in got) == 5
    assert tape.windowed_counts(spark.createDataFrame(first, kind).where(F.lit(False)), *sizes).count() == 0
