"""The event tape and the snapshot diff over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.events import codes
from ..operators.shared import new_folder

DIFF = "ticker string, scanned_at string, score double, delta double, new_flags array<string>, cleared_flags array<string>"


def windowed_counts(filings: DataFrame, window: str = "180 days", slide: str = "30 days", late: str = "30 days") -> DataFrame:
    """Item codes by company in sliding windows of filing time ``ts``; filings later than ``late`` are dropped."""
    items = filings.withWatermark("ts", late).select("cik", "ts", F.explode(codes(F.col("items"))).alias("code"))
    return items.groupBy(F.window("ts", window, slide), "cik", "code").count().select(F.col("window.start").alias("start"), "cik", "code", "count")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    score, flags, known = (*state.get, True) if state.exists else (None, [], False)
    for batch in batches:
        out = []
        for r in batch.sort_values("scanned_at").itertuples():
            now = list(r.flags)
            new = [f for f in now if f not in flags] if known else []
            gone = [f for f in flags if f not in now] if known else []
            delta = float(r.score) - score if known and score is not None and not pd.isna(r.score) else None
            out.append((key[0], r.scanned_at, r.score, delta, new, gone))
            score, flags, known = (None if pd.isna(r.score) else float(r.score)), now, True
        yield pd.DataFrame(out, columns=["ticker", "scanned_at", "score", "delta", "new_flags", "cleared_flags"])
    if known:
        state.update((score, flags))


def snapshot_diffs(snapshots: DataFrame) -> DataFrame:
    """Each snapshot against the last one of its ticker, which is the state that is kept; rows arrive in order of time per ticker."""
    return snapshots.groupBy("ticker").applyInPandasWithState(_step, DIFF, "score double, flags array<string>", "append", GroupStateTimeout.NoTimeout)


#: The state store that keeps state variables and timers on disk.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SNAPSHOT = "ticker string, scanned_at string, score double, flags array<string>"
#: The ticker of the row that closes a bounded stream, and its time, beyond all others.
CLOSING, LAST = "", "9999-01-01"


class OrderedDiff(StatefulProcessor):
    """Snapshots of a ticker wait in a list; a timer at the earliest of them tells all that the watermark has come to.

    The state holds what lies between the watermark and the newest row, and the last snapshot told. A row costs no call of
    the state store of its own: a ticker's rows of a trigger are added at once, and put in order when they are told.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, scanned_at string, score double, flags array<string>")
        self.last = handle.getValueState("last", "score double, flags array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        came = [(r.at, r.scanned_at, r.score, list(r.flags or [])) for r in rows]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(r[0] for r in came))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        # All that is due is told by the first timer, in order, whatever the order in which timers fire.
        until = max(timerValues.getCurrentWatermarkInMs(), due)
        held = [(r[0], r[1], r[2], list(r[3])) for r in self.waiting.get()]
        later = [r for r in held if r[0] > until]
        rank = lambda r: (r[2] is not None, r[2] or 0.0, r[3])
        best: dict[int, tuple] = {}
        for r in held:
            if r[0] <= until and (r[0] not in best or rank(r) > rank(best[r[0]])):
                best[r[0]] = r
        if not best:
            return
        known = self.last.get() if self.last.exists() else None
        for _, scanned_at, score, now in sorted(best.values(), key=lambda r: r[0]):
            was = list(known[1]) if known else []
            delta = score - known[0] if known and score is not None and known[0] is not None else None
            yield Row(ticker=key[0], scanned_at=scanned_at, score=score, delta=delta, new_flags=[f for f in now if f not in was] if known else [], cleared_flags=[f for f in was if f not in now] if known else [])
            known = (score, now)
        self.last.update(known)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()


def ordered_diffs(snapshots: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Each snapshot of a stream against the one before it in time, in whatever order they arrive.

    A snapshot is told once the watermark, ``late`` behind the newest time seen, has come to it; one that comes after
    that is dropped, as are rows without a ticker or a time that can be read. Times count to the millisecond; of rows
    with one ticker and time the largest by score, then flags, counts. Null flags are none. A query over it runs
    within ``ordered_state``.
    """
    timed = snapshots.select("ticker", "scanned_at", "score", "flags", F.try_to_timestamp("scanned_at").alias("ts")).where("ticker IS NOT NULL AND ts IS NOT NULL")
    rows = timed.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("ticker").transformWithState(OrderedDiff(), DIFF, "Append", "EventTime")


@contextmanager
def ordered_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within it use the state store that ``ordered_diffs`` needs; the setting is put back."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def replayed(snapshots: DataFrame) -> DataFrame:
    """A bounded table of snapshots through the stream, to its end: written to the shared folder, read as a stream by
    one trigger in no order, closed by a row beyond all times, and the diffs read back from the sink's files."""
    spark, folder = snapshots.sparkSession, new_folder(snapshots.sparkSession, "stream")
    rows = snapshots.select("ticker", "scanned_at", "score", "flags").where(F.col("ticker") != CLOSING)
    closing = spark.range(1).select(F.lit(CLOSING).alias("ticker"), F.lit(LAST).alias("scanned_at"), F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("flags"))
    rows.unionByName(closing).write.parquet(f"{folder}/in")
    told = ordered_diffs(spark.readStream.schema(SNAPSHOT).parquet(f"{folder}/in"))
    with ordered_state(spark):
        q = told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(DIFF).parquet(f"{folder}/out").where(F.col("ticker") != CLOSING)
