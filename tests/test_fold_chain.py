"""Folds that follow each other over one key."""

import random

from vigilflow.operators import folds, scoring, windows
from vigilflow.operators.folds import plan_keys
from vigilflow.params import FlushParams


def test_a_fold_that_follows_another_is_not_shuffled(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(9000) * 10**6, rng.choice("abcde"), rng.choice(["net", "proc"]), rng.random(), [rng.gauss(0, 1) for _ in range(32)]) for i in range(400)]
    ev = spark.createDataFrame(rows, "event_id long, ts_us long, source string, type string, score double, embedding array<double>").repartition(3)
    for max_rows in (10**6, 20):  # without and with hot keys
        plan = plan_keys(ev, ["source"], max_rows)
        scanned = scoring.ssm_scan(ev, ["source"], "embedding", ["ts_us", "event_id"], plan=plan).drop("embedding")
        again = scoring.segment_flush(scanned, ["source"], plan=plan)
        chained = scoring.segment_flush(scanned, ["source"], plan=plan, follows=True)
        shown = lambda df: sorted((r.event_id, r.segment_id, r.flushed, tuple(r.y)) for r in df.collect())
        assert shown(again) == shown(chained)
        if plan.later is None:
            exchanges = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
            assert exchanges(chained) == exchanges(again) - 1


def test_hot_keys_are_sorted_and_written_once(spark, monkeypatch):
    """However many rounds the chunks take; states are as long as many rows and don't travel with rows."""
    rng = random.Random(6)
    rows = [(i, i * 10**6, rng.choice(["a", "a", "a", "b", None]), [rng.gauss(0, 1) for _ in range(32)], rng.random(), rng.random()) for i in range(300)]
    seg = spark.createDataFrame(rows, "event_id long, ts_us long, tenant string, state array<double>, trend double, last_score double").repartition(5).cache()
    want = sorted((r.event_id, r.route, r.drift, r.history) for r in scoring.hierarchy_drift(seg, ["tenant"]).collect())
    laid, real = [], folds._sorted
    monkeypatch.setattr(folds, "_sorted", lambda df, *a: laid.append(df.columns) or real(df, *a))
    got = scoring.hierarchy_drift(seg, ["tenant"], plan=plan_keys(seg, ["tenant"], 20, 5.0))
    assert sorted((r.event_id, r.route, r.drift, r.history) for r in got.collect()) == want
    assert folds.settle_rounds > 1 and [sorted(names) for names in laid] == [sorted([*seg.columns, "_chunk"])]


def test_segments_are_summed_up_where_they_lie(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(9000) * 10**6, rng.choice(["a", "b", "c", None]), rng.choice(["net", "net", "proc", "odd", "unk", "auth"]), rng.choice([None, 0.2, 0.6, 0.7]), rng.choice([None, 1.0, 3.0]), [float(i)])
            for i in range(500)]
    ev = spark.createDataFrame(rows, "event_id long, ts_us long, source string, type string, score double, rate_hz double, state array<double>").repartition(3)
    plan = plan_keys(ev, ["source"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # segments go on over batches
    try:
        for p in (FlushParams(max_events=5), FlushParams(max_events=30, on_type_change=False, max_age_s=1e9, anomaly=9.0)):
            marked = scoring.segment_flush(ev, ["source"], p, plan)
            there = scoring.segment_summary(marked, ["source"], ["state"], plan, follows=True)
            shown = lambda df: sorted((str(r.source), r.segment_id, r.events, r.dominant_type if r.dominant_type != "odd" else "unk", r.ts_us, r.event_id, r.last_score or 0.0, tuple(r.state), *(
                None if v is None else round(v, 9) for v in (r.trend, r.rate_mean, r.error_freq))) for r in df.select(*there.columns).collect())
            apart = scoring.segment_summary(marked, ["source"], ["state"])
            assert shown(there) == shown(apart) and len(shown(there)) > 10 and there.columns == apart.columns
            plans = there._jdf.queryExecution().optimizedPlan().toString(), marked._jdf.queryExecution().optimizedPlan().toString()
            assert plans[0].count("Repartition") == plans[1].count("Repartition") and "Aggregate" not in plans[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_statistics_follow_the_window(spark):
    """Rows that a window has sorted are not shuffled again for the fold after it, unless a key is cut there."""
    rng = random.Random(8)
    values = "bytes_in long, bytes_out long, rate_hz double, packets_total long, packet_size_mean double, iat_mean double, syn_count long"
    rows = [(i, rng.randrange(9000) * 10**6, rng.choice("abcde"), rng.randrange(3), *(rng.randrange(9) if "long" in v else rng.random() for v in values.split(", "))) for i in range(300)]
    ev = spark.createDataFrame(rows, f"event_id long, ts_us long, source string, protocol long, {values}").repartition(3)
    plan = plan_keys(ev, ["source"])
    assert plan.whole and not plan._replace(largest=folds.HOT_ROWS + 1).whole and not plan_keys(ev, ["source"], 20).whole
    shaped = windows.local_shape(ev, ["source"], 60.0)
    apart, there = (scoring.rolling_stats(shaped, ["source"], plan, follows) for follows in (False, True))
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(apart) == shown(there)
    assert "Repartition" not in there._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
