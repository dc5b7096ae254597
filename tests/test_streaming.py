"""Bad times of a stream of events, in any order, against those of the batch."""

import random

import pytest
from pyspark.sql import functions as F

from sparkburst.operators import intervals
from sparkburst.streaming import live

FRAME = 60_000_000
SCHEMA = "obsid string, t_us long, pi int"


def events_of(seed):
    r = random.Random(seed)
    rows = []
    for obs in ("a", "b", "c"):
        bad = [r.random() < 0.4 for _ in range(r.randrange(3, 40))]
        for k, is_bad in enumerate(bad):
            if is_bad or r.random() < 0.6:
                rows += [(obs, k * FRAME + r.randrange(FRAME), 11_000 if is_bad else 500) for _ in range(r.randrange(1, 4))]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_batch_in_any_order(spark, tmp_path, seed):
    rows = events_of(seed)
    batch = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(x) for x in intervals.bad_times(intervals.high_energy_curve(batch, FRAME), 0.0).select("obsid", "start", "stop").collect()}
    random.Random(seed).shuffle(rows)
    parts = [rows[k::5] for k in range(5)] + [[("end", 10**12, 0)]]
    for part in parts:
        if part:
            spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = live.drained(live.bad_times_of_events(stream, FRAME, 0.0, "2 hours"), str(tmp_path / "out"), "append").where("obsid <> 'end'").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_intervals_come_out_as_they_end(spark, tmp_path):
    """In order, with a short delay: a closed interval does not wait for the stream's end; what is too late is left out."""
    hot = lambda k: ("a", k * FRAME + 1, 11_000)
    cold = lambda k: ("a", k * FRAME + 1, 500)
    for part in ([cold(0), hot(1), hot(2)], [cold(3), cold(4), cold(20)], [hot(2), cold(21)]):
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drained(live.bad_times_of_events(stream, FRAME, 0.0, "1 minute"), str(tmp_path / "out"), "append").collect()
    assert [tuple(x) for x in got] == [("a", 0, 2)]
