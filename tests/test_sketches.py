"""Sketches against exact quantiles, their merging in any order, and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from vigilflow.operators import sketches
from vigilflow.streaming import telemetry

WANTED = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def values(n=4000, seed=3):
    rng = random.Random(seed)
    rows = [(i, "busy" if rng.random() < 0.8 else f"s{i % 3}", rng.choice([rng.expovariate(0.01), 10 ** rng.uniform(-6, 9), 5.0, 0.0])) for i in range(n)]
    return rows + [(n, "busy", None), (n + 1, "busy", float("nan")), (n + 2, "odd", float("inf")), (n + 3, "odd", -3.0), (n + 4, None, 2.0)]


KINDS = "event_id long, stage string, us double"


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_quantiles_lie_within_the_error(spark, error):
    rows = values()
    got = {r.stage: r for r in sketches.quantiles(sketches.sketch(spark.createDataFrame(rows, KINDS), ["stage"], "us", error), ["stage"], WANTED, error).collect()}
    assert set(got) == {"busy", "s0", "s1", "s2", "odd", None}
    for stage, row in got.items():
        known = sorted(v for _, s, v in rows if s == stage and v is not None and v == v and abs(v) != float("inf"))
        assert row.samples == len(known) and row.peak == known[-1]
        for name, q in WANTED.items():
            exact = max(0.0, known[max(0, -int(-(len(known) * q) // 1) - 1)])
            assert abs(row[name] - exact) <= error * exact * (1 + 1e-9), (stage, name)


def test_parts_add_up_in_any_order(spark):
    df = spark.createDataFrame(values(), KINDS)
    whole = sketches.sketch(df, ["stage"], "us")
    parts = [sketches.sketch(df.filter(F.pmod("event_id", F.lit(3)) == i), ["stage"], "us") for i in (2, 0, 1)]
    count = lambda s: {(r.stage, r.bucket): (r.n, r.peak) for r in s.collect()}
    assert count(sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["stage"])) == count(whole)
    assert sketches.quantiles(sketches.sketch(df.limit(0), ["stage"], "us"), ["stage"], WANTED).count() == 0


def test_repeated_batches_and_compaction(spark, tmp_path):
    df, folder = spark.createDataFrame(values(600), KINDS), str(tmp_path)
    add = telemetry.sketch_batch(folder, ["stage"], "us")
    batch = lambda i: df.filter(F.pmod("event_id", F.lit(4)) == i)
    count = lambda s: {(r.stage, r.bucket): r.n for r in s.collect()}
    read = lambda: count(telemetry.read_sketch(spark, folder, ["stage"]))
    for i in (0, 1, 1):
        add(batch(i), i)
    want = count(sketches.sketch(batch(0).unionByName(batch(1)), ["stage"], "us"))
    assert read() == want
    assert telemetry.compact(spark, folder, ["stage"]) == 1 and read() == want
    add(batch(2), 2)
    add(batch(3), 3)
    assert read() == count(sketches.sketch(df, ["stage"], "us"))
    telemetry.compact(spark, folder, ["stage"])
    add(batch(3), 3)  # a repeat after the compaction takes its place away, the counts stay
    assert read() == count(sketches.sketch(df, ["stage"], "us"))


def test_series_and_logs_keep_the_newest(spark):
    df = spark.createDataFrame([(i, i * 1_000_000, "a" if i % 3 else None, float(i)) for i in range(30)], "event_id long, ts_us long, kind string, drift double")
    got = {(r.kind, r.step_us): (r.samples, r.drift_last, r.drift_mean) for r in sketches.series(df, "kind", 10.0, ["drift"], 2).collect()}
    assert got[("a", 20_000_000)] == (7, 29.0, sum(i for i in range(20, 30) if i % 3) / 7) and len(got) == 4
    log = sorted((r.kind or "", r.event_id, r.seen) for r in sketches.newest_by_kind(df, 2).collect())
    assert log == [("", 24, 10), ("", 27, 10), ("a", 28, 20), ("a", 29, 20)]
