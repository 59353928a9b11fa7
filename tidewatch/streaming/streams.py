"""Structured Streaming versions of ingest, window features and rolling alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.io import append_bronze


def stream_bronze(spark: SparkSession, path: str, schema: str, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("user_id", "event_type", "ts")) -> DataFrame:
    """A stream of the Parquet files that appear under path (or match it), repeated keys removed within the watermark.

    Times without a zone count as UTC instants, since a watermark needs an instant.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    if dict(rows.dtypes)[time] != "timestamp":
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def stream_features(df: DataFrame, size: str = "60 seconds", slide: str | None = "1 second", keys: tuple[str, ...] = ("user_id", "event_type"), time: str = "ts") -> DataFrame:
    """(window_start, keys, n, mean, std, min, max) of sliding windows, or tumbling ones without slide.

    df has a watermark; a window is emitted in append mode once the watermark has passed it, and later data is dropped.
    """
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "std", "min", "max")


class _Alerts(StatefulProcessor):
    """A user's rows wait in state until the watermark has passed them, then go through the alert in order of time."""

    def __init__(self, k: int, threshold: float) -> None:
        self.k, self.threshold = k, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at_us long, tie long, p double")
        self.alert = handle.getValueState("alert", "run int, is_on boolean")
        self.timer = handle.getValueState("timer", "due_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(t), int(i), float(p)) for pdf in rows for t, i, p in zip(pdf["at_us"], pdf["tie"], pdf["p"], strict=True) if t > passed]
        if new:
            self.held.appendList(new)
            self._wait(min(new)[0])
        return iter(())

    def _wait(self, at_us: int) -> None:
        """A timer for the first row that waits, one for each user."""
        due = -(-at_us // 1000)
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is None or due < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = sorted(tuple(r) for r in self.held.get())
        ready = [r for r in held if r[0] <= passed]
        rest = held[len(ready) :]
        run, on = self.alert.get() if self.alert.exists() else (0, False)
        out = []
        for at, _, p in ready:
            run = min(run + 1, self.k) if p >= self.threshold else 0
            if run >= self.k and not on:
                on = True
                out.append((key[0], at, True))
            elif on and not run:
                on = False
                out.append((key[0], at, False))
        self.alert.update((run, on))
        if rest:
            self.held.put(rest)
            self._wait(rest[0][0])
        else:
            self.held.clear()
        # plain objects: newer pandas would hold strings in chunks, which the worker can't pass on
        yield pd.DataFrame(out, columns=["user_id", "at_us", "raised"]).astype({"user_id": object})

    def close(self) -> None:
        pass


def stream_alerts(df: DataFrame, k: int = 3, threshold: float = 0.5, tie: str | None = None, time: str = "ts") -> DataFrame:
    """(user_id, ts, state): raised after k risky windows in a row, cleared by the next one that isn't.

    df: user_id, ts with a watermark, p, and a whole number `tie` by which rows of one time are ordered. Rows are taken in
    order of event time, however they come: each waits in its user's state until the watermark has passed it, so an alert
    comes out at most the watermark's delay late, and rows that come later than that are dropped. State for each user: the
    waiting rows, the length of the risky run, whether the alert is on, one timer. Needs the RocksDB state store, which is
    set for the session.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = df.filter(F.col(time).isNotNull() & F.col("p").isNotNull()).select("user_id", time, F.unix_micros(time).alias("at_us"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("tie"), F.col("p").cast("double").alias("p"))
    out = rows.groupBy("user_id").transformWithStateInPandas(_Alerts(k, threshold), f"user_id {dict(df.dtypes)['user_id']}, at_us long, raised boolean", "Append", "EventTime")
    return out.select("user_id", F.timestamp_micros("at_us").alias("ts"), F.when(F.col("raised"), "raised").otherwise("cleared").alias("state"))


def stream_gold(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the table at path by its key, so that a replayed batch adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        append_bronze(batch, path)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
