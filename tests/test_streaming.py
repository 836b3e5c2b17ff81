"""Streams over several files equal the batch run; repeats and late rows are handled."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vigilflow.operators import steps
from vigilflow.operators.folds import fold_by_key
from vigilflow.params import DecisionParams
from vigilflow.streaming import alerts, state

S = 1_000_000
SCHEMA = "event_id long, ts_us long, source string, tenant string, score double"


def write(spark, folder, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def drain(spark, sdf, out):
    q = sdf.writeStream.format("parquet").option("checkpointLocation", f"{out}/c").option("path", f"{out}/r").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.schema(sdf.schema).parquet(f"{out}/r")


@pytest.fixture(scope="module")
def files():
    rng, ts, out = random.Random(11), 0, []
    for i in range(3):
        rows = []
        for j in range(60):
            ts += rng.choice([1, 3, 20]) * S
            rows.append((i * 60 + j, ts, rng.choice(["a", "a", "b"]), "t", round(rng.random(), 3)))
        out.append(rows)
    return out


def test_decisions_equal_batch(spark, files, tmp_path):
    write(spark, tmp_path / "in", files)
    step = steps.DecisionStep(DecisionParams())
    judge = lambda df: df.select(
        "event_id", "ts_us", "source", F.col("score").alias("confidence"), F.lit(0.0).alias("history"), F.lit(0.0).alias("drift"),
        F.lit(False).alias("false_positive"), F.when(F.col("score") < .5, "Alert").otherwise("Block").alias("decision"))
    sdf = state.fold_stream(judge(read(spark, tmp_path / "in")), ["source"], step, "event_id long, final string", ["event_id", "final"])
    streamed = sorted((r.event_id, r.final) for r in drain(spark, sdf, tmp_path / "out").collect())
    batch = judge(spark.createDataFrame([r for f in files for r in f], SCHEMA))
    whole = sorted((r.event_id, r.final) for r in fold_by_key(batch, ["source"], step, "event_id long, final string").collect())
    assert streamed == whole


def test_repeated_events_are_dropped(spark, files, tmp_path):
    write(spark, tmp_path / "in", [files[0], files[0][-5:] + files[1]])
    sdf = alerts.deduplicate(read(spark, tmp_path / "in"), "10 minutes").select("event_id")
    ids = [r.event_id for r in drain(spark, sdf, tmp_path / "out").collect()]
    assert len(ids) == len(set(ids)) == 120


def test_late_rows_miss_closed_windows(spark, tmp_path):
    row = lambda i, s: (i, s * S, "a", "t", 0.9)
    # a batch drops what was late for the batch before it
    write(spark, tmp_path / "in", [[row(1, 10), row(2, 20)], [row(3, 1000)], [row(4, 2000)], [row(5, 15), row(6, 2500)], [row(7, 4000)]])
    sdf = alerts.alert_counts(read(spark, tmp_path / "in"), "1 minute", "1 minute")
    got = {r.start_us // S: r.alerts for r in drain(spark, sdf, tmp_path / "out").collect()}
    assert got[0] == 2 and got[960] == 1


def test_liveness_across_batches(spark, tmp_path):
    row = lambda i, s: (i, s * S, "a", "t", 0.9)
    write(spark, tmp_path / "in", [[row(1, 10), row(2, 400)], [row(3, 450)], [row(4, 5000)], [row(5, 9000)]])
    sdf = read(spark, tmp_path / "in").withColumn("at", F.timestamp_micros("ts_us"))
    got = sorted(r.offline_us // S for r in drain(spark, state.device_liveness(sdf, "tenant", 120.0, "10 seconds"), tmp_path / "out").collect())
    assert got == [130, 570, 5120]


def test_batch_is_replaced_not_repeated(spark, files, tmp_path):
    write(spark, tmp_path / "in", files[:1])
    once = lambda c: alerts.process_once(read(spark, tmp_path / "in"), lambda b: b, str(tmp_path / "o"), str(tmp_path / c))
    for c in ("c1", "c2"):  # the same batch again, as after a lost checkpoint
        once(c).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 60


def test_metrics_sink_hears_every_batch(spark, tmp_path):
    write(spark, tmp_path / "in", [[(i, i * S, "a", "t", 0.5)] * (i + 1) for i in range(3)])
    heard = []
    sink = alerts.MetricsSink(lambda name, batch, rows, rate: heard.append((batch, rows)))
    spark.streams.addListener(sink)
    try:
        drain(spark, read(spark, tmp_path / "in"), tmp_path / "out")
        for _ in range(100):
            if sum(rows for _, rows in heard) >= 6:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(sink)
    assert sorted(rows for _, rows in heard if rows) == [1, 2, 3]
