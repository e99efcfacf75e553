"""The batch definitions on live input: windowed features, running metrics, repeats within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epochlake.operators.metrics import confusion


def windowed(events: DataFrame, length: str, stride: str, late: str = "10 minutes") -> DataFrame:
    """Count, mean, spread and range of each user's values in hopping windows; later rows than the watermark go."""
    w = F.window("ts", length, stride)
    g = events.withWatermark("ts", late).groupBy(w, "user_id")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range")).select("user_id", F.col("window.start").alias("start"), "n", "mean", "std", "range")


def running_confusion(scores: DataFrame) -> DataFrame:
    """tp, fn, tn, fp of each task so far; for outputMode('update' or 'complete')."""
    return confusion(scores, "task")


def first_fingerprints(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows whose fingerprint is new within the watermark of ts."""
    return docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fp"])


def drained(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over what is there now into Parquet below path and read all of it; `complete` results keep the last batch.

    A batch has a folder of its own, which a batch that is run again after a failure overwrites, so that its rows stand
    there once. The state lies below path, too: a later call with the same path goes on where this one ended.
    """
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data" if mode == "complete" else f"{path}/data/batch={number}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(keep).start()
    q.awaitTermination()
    if mode != "complete":
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/data/batch=-1")  # a table even without a batch
    return spark.read.schema(schema).parquet(f"{path}/data")


#: What a sample window holds: its number, first and last time (microseconds), and features of its values.
SAMPLE_WINDOW = "user_id long, win int, start long, end long, n long, mean double, variance double, std double, rms double, range double"
#: A sample as it is kept in state, samples in one value of a list, and values that windows are made of at once.
SAMPLE = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("value", "<f8")])
PACKED = 1 << 16
TOGETHER = 1 << 20


class SampleWindows(StatefulProcessor):
    """Windows of `width` samples every `stride` over one user's values in the order of (us, event_id).

    Rows wait until the watermark has passed them, for then nothing can come before them any more; a timer at the
    earliest of them brings the user back. Released values follow the fewer than `width` values that were kept of those
    before; windows are given out as soon as their last sample is there. State: what waits, those last values and the
    number of samples so far, each packed, for a call to the state store costs as much as many samples.
    """

    def __init__(self, width: int, stride: int):
        self.width, self.stride = width, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "samples binary")
        self.past = handle.getValueState("past", "seen long, samples binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  Spark's names
        yield from self.released(key, timerValues.getCurrentWatermarkInMs(), [packed(part) for part in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self.released(key, timerValues.getCurrentWatermarkInMs(), [])

    def close(self) -> None:
        pass

    def released(self, key: tuple, watermark: int, new: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """Windows that the rows before the watermark complete."""
        waited = [np.frombuffer(r[0], SAMPLE) for r in self.waiting.get()]
        rows = np.concatenate([np.zeros(0, SAMPLE), *waited, *new])
        rows = rows[np.lexsort((rows["event_id"], rows["us"]))]
        cut = int(np.searchsorted(rows["us"], watermark * 1000, side="left"))
        ready, later = rows[:cut], rows[cut:]
        if waited and new:  # a timer stands only where rows wait, and one that has expired is gone
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if len(later):
            self.handle.registerTimer(int(later["us"][0]) // 1000 + 1)
        if len(ready) or new:
            if waited:
                self.waiting.clear()
            for k in range(0, len(later), PACKED):
                self.waiting.appendValue((later[k : k + PACKED].tobytes(),))
        if len(ready):
            seen, had = self.past.get() if self.past.exists() else (0, b"")
            line = np.concatenate((np.frombuffer(had, SAMPLE), ready))
            total = seen + len(ready)
            self.past.update((total, line[max(0, len(line) - self.width + 1) :].tobytes()))
            first, end = max(0, -(-(seen + 1 - self.width) // self.stride)), (total - self.width) // self.stride + 1
            step = max(1, TOGETHER // self.width)
            for k in range(first, end, step):
                yield self.windows(key[0], np.arange(k, min(k + step, end)), line, total - len(line))

    def windows(self, user: int, win: np.ndarray, line: np.ndarray, before: int) -> pd.DataFrame:
        """Windows by their numbers from a line of samples, before which so many others came."""
        at = win * self.stride - before
        v = np.lib.stride_tricks.sliding_window_view(line["value"], self.width)[at]
        there = ~np.isnan(v)
        n = there.sum(axis=1)
        some = n > 0
        over = lambda x: np.divide(np.where(there, x, 0.0).sum(axis=1), n, out=np.full(len(n), np.nan), where=some)
        mean = over(v)
        variance, square = over((v - mean[:, None]) ** 2), over(v * v)
        most = np.where(there, v, -np.inf).max(axis=1) - np.where(there, v, np.inf).min(axis=1)
        return pd.DataFrame({"user_id": user, "win": win.astype(np.int32), "start": line["us"][at], "end": line["us"][at + self.width - 1], "n": n, "mean": mean, "variance": variance, "std": np.sqrt(variance), "rms": np.sqrt(square), "range": np.where(some, most, np.nan)})


def packed(part: pd.DataFrame) -> np.ndarray:
    """Samples of a portion of rows; a value that isn't there is not a number."""
    out = np.empty(len(part), SAMPLE)
    for c in SAMPLE.names:
        out[c] = part[c].to_numpy()
    return out


def sample_windows(events: DataFrame, width: int, stride: int, late: str = "10 minutes") -> DataFrame:
    """Live windows over the sample index of each user (ts, event_id, user_id, value); rows later than the watermark go.

    The state of a user is what came within `late` and fewer than `width` values. Null values count as samples without a
    value, null ids come last at their time; null users are left out. Needs the state store that is kept in files.
    """
    last = F.coalesce(F.col("event_id").cast("long"), F.lit(2**63 - 1)).alias("event_id")
    rows = events.select("user_id", "ts", F.unix_micros("ts").alias("us"), last, F.col("value").cast("double").alias("value")).where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    out = rows.groupBy("user_id").transformWithStateInPandas(SampleWindows(width, stride), SAMPLE_WINDOW, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})


def with_state_files(spark: SparkSession) -> None:
    """Choose the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/{table}.parquet*")
