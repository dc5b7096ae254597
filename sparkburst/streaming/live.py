"""The same operators on streams: binned counts with a watermark, sessions of event lists, bad times with state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


def counts(events: DataFrame, frame: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts per pixel key and frame; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy("pixel", F.window("ts", frame).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Spans of events no further apart than ``gap``."""
    return events.withWatermark("ts", late).groupBy("pixel", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def bad_times(frames: DataFrame, threshold: float) -> DataFrame:
    """(obsid, start, stop) of bad times as they end; frames (obsid, it, rate) come in order.

    The state of an observation is its last frame and the open interval's start.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last_bad, last = state.get if state.exists else (None, None, None)
        out = []
        for pdf in batches:
            for it, rate in pdf.sort_values("it")[["it", "rate"]].itertuples(index=False):
                if rate > threshold:
                    start = start if start is not None else (last if last is not None else int(it))
                    last_bad = int(it)
                elif start is not None:
                    out.append((key[0], start, last_bad))
                    start = None
                last = int(it)
        state.update((start, last_bad, last))
        yield pd.DataFrame(out, columns=["obsid", "start", "stop"])

    return frames.groupBy("obsid").applyInPandasWithState(
        step, "obsid string, start long, stop long", "start long, last_bad long, last long", "append", GroupStateTimeout.NoTimeout
    )


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class BadTimes(StatefulProcessor):
    """Bad times of each observation from its events, in whatever order they come within the watermark's delay.

    Hard events are counted by frame.  A timer at a frame's end closes all frames that
    the watermark has passed, in their order, the empty ones among them; an interval
    comes out when a good frame follows it.  When nothing has come for ``idle``
    frames, the last one, still open, comes out too and the state goes.
    """

    def __init__(self, frame_us: int, least: float, idle: int = 4):
        self.frame_us, self.least, self.idle = frame_us, least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", _longs("it"), _longs("n"))
        # the next frame to close, the last that is known, the open interval and the last closed frame
        self.place = handle.getValueState("place", _longs("next", "last", "start", "last_bad", "closed"))

    def _end_ms(self, it: int) -> int:
        return -(-((it + 1) * self.frame_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counts: dict[int, int] = {}
        for r in rows:
            counts[r["it"]] = counts.get(r["it"], 0) + r["hard"]
        place = self.place.get()
        first = min(counts)
        upto, last, start, bad, closed = place if place is not None else (first, first, None, None, None)
        if closed is None:
            upto = min(upto, first)  # nothing is closed yet, so an earlier frame may still come first
        for it, n in counts.items():
            if it < upto:
                continue  # its frame is closed: later than the watermark allows
            held = self.pending.getValue((it,)) if self.pending.containsKey((it,)) else None
            self.pending.updateValue((it,), ((held[0] if held is not None else 0) + n,))
            self.handle.registerTimer(self._end_ms(it))
            last = max(last, it)
        self.handle.registerTimer(self._end_ms(last + self.idle))
        self.place.update((upto, last, start, bad, closed))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        place = self.place.get()
        if place is None:
            return
        upto, last, start, bad, closed = place
        mark = timerValues.getCurrentWatermarkInMs()
        while upto <= last and self._end_ms(upto) <= mark:
            held = self.pending.getValue((upto,)) if self.pending.containsKey((upto,)) else None
            if held is not None:
                self.pending.removeKey((upto,))
            if (held[0] if held is not None else 0) > self.least:
                start = start if start is not None else (closed if closed is not None else upto)
                bad = upto
            elif start is not None:
                yield Row(obsid=key[0], start=start, stop=bad)
                start = None
            closed, upto = upto, upto + 1
        if upto > last and self._end_ms(last + self.idle) <= mark:
            if start is not None:
                yield Row(obsid=key[0], start=start, stop=bad)
            self.place.clear()
        else:
            self.place.update((upto, last, start, bad, closed))

    def close(self) -> None:
        pass


def bad_times_of_events(events: DataFrame, frame_us: int, threshold: float, late: str, lo: int = 10_000, hi: int = 12_000) -> DataFrame:
    """(obsid, start, stop) frames of bad times of a stream of events (obsid, ts, t_us, pi); ``threshold`` is a rate per second."""
    hard = ((F.col("pi") > lo) & (F.col("pi") < hi)).cast("long")
    rows = events.withWatermark("ts", late).select("obsid", "ts", F.expr(f"t_us div {frame_us}").alias("it"), hard.alias("hard"))
    out = StructType([StructField("obsid", StringType()), StructField("start", LongType()), StructField("stop", LongType())])
    return rows.groupBy("obsid").transformWithState(BadTimes(frame_us, threshold * frame_us / 1e6), out, "append", "eventTime")


def drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """What a stream gives when all its present input is read, written to ``path`` and read again.

    In complete mode every batch replaces the table, else it adds to it.  The
    stream's own progress is kept beside it, so a stopped one goes on.
    """
    how = "overwrite" if mode == "complete" else "append"
    sink = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{path}/table"))
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state with timers needs it
    try:
        sink.option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return read.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("pixel"), "value")
