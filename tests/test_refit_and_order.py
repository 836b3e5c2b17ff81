"""A model refitted on a stream equals the batch fit; late and shuffled rows give the batch result."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import StructType

from vigilflow.operators import reconstruction, scoring, steps
from vigilflow.operators.folds import fold_by_key
from vigilflow.params import DecisionParams, FlushParams, RoutingParams
from vigilflow.streaming import ordered, refit

S = 1_000_000


# ---------------------------------------------------------------- reconstruction


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 48)) + 0.1 * rng.normal(size=(n, 48)) + 3
    return [(i, "quiet" if i % 3 else "loud", x.tolist(), 0.25) for i, x in enumerate(base)]


COLUMNS = "event_id long, kind string, embedding array<double>, score double"


def test_axes_span_the_main_directions(spark):
    rows = vectors(300)
    model = reconstruction.fit(spark.createDataFrame(rows, COLUMNS))
    x = np.array([r[2][:40] for r in rows])
    centred = x - x.mean(axis=0)
    top = np.linalg.svd(centred, full_matrices=False)[2][:5]
    axes = np.array(model.axes)
    assert np.allclose(axes @ axes.T, np.eye(8), atol=1e-9)
    assert np.allclose(np.linalg.norm(top @ axes.T, axis=1), 1, atol=1e-6)
    left = (centred**2).sum(axis=1) - ((centred @ axes.T) ** 2).sum(axis=1)
    assert np.isclose(model.error_mean, left.mean() / 40) and np.allclose(model.mean, x.mean(axis=0))


def test_moments_of_awkward_vectors(spark):
    rows = [*vectors(20), (100, "quiet", None, 0.0), (101, "quiet", [], 0.0), (102, "quiet", [1.0] * 39, 0.0), (103, "quiet", [None] * 48, 0.0),
            (104, "quiet", [float("nan")] * 48, 0.0), (105, "quiet", [float("inf")] * 48, 0.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    row = reconstruction.moments(df.repartition(6)).first()
    assert row.n == 20 and np.allclose(row.sums, np.sum([r[2][:40] for r in rows[:20]], axis=0))
    nothing = reconstruction.moments(df.limit(0)).first()
    assert nothing.n == 0 and not any(nothing.sums) and reconstruction.of_moments(nothing).error_mean == 0
    one = reconstruction.fit(df.filter("event_id = 3"))
    assert one.score(F.lit(0.25)) is not None and one.error_mean < 1e-9
    assert reconstruction.merged(reconstruction.moments(df).limit(0)).first().n == 0


def test_refit_after_each_batch_equals_batch(spark, tmp_path):
    rows = vectors(240)
    parts = [rows[:50], rows[50:60], rows[60:200], rows[200:]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, COLUMNS).coalesce(2).write.parquet(f"{tmp_path}/in/{i}")
    seen = {}
    quiet = lambda b: b.filter(F.col("kind") == "quiet")
    step = refit.refit(quiet, f"{tmp_path}/model", scored=lambda df, n: seen.update({n: df.count()}))
    sdf = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    sdf.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen.values()) == len(rows) and len(seen) == 4
    whole = reconstruction.fit(quiet(spark.createDataFrame(rows, COLUMNS)))
    last = refit.model_before(spark, f"{tmp_path}/model")
    assert np.allclose(last.axes, whole.axes, atol=1e-8) and np.isclose(last.error_mean, whole.error_mean) and np.allclose(last.mean, whole.mean)
    count = lambda v: refit.versions(spark, f"{tmp_path}/model").filter(F.col("version") == v).first().n
    before, batch = count(3), spark.createDataFrame(rows[:9], COLUMNS)
    for _ in range(2):  # a batch that is run again replaces its own version
        step(batch, 3)
        assert count(3) == count(2) + 6
    assert before == 160
    assert refit.model_before(spark, f"{tmp_path}/model", 0) is None and refit.model_before(spark, f"{tmp_path}/nothing") is None


# ---------------------------------------------------------------- late rows


EVENTS = "event_id long, ts_us long, source string, tenant string, type string, score double, rate_hz double, embedding array<double>"


def events(n=240, seed=2):
    rng, ts, out = random.Random(seed), 10**9 * S, []  # the watermark starts at 0
    for i in range(n):
        ts += rng.choice([0, 1, 3, 20]) * S
        out.append((i, ts, rng.choice(["a", "a", "a", "b", "c"]), "t", rng.choice(["net", "net", "net", "auth"]),
                    round(rng.random() * 0.9, 3), float(rng.randrange(9)), [round(rng.gauss(0, 1), 3) for _ in range(32)]))
    return out


def arrive(spark, folder, rows, files, late_share, seed=3):
    """Rows in `files` files, shuffled, some of them a file late; a last file whose beat moves the watermark on."""
    rng = random.Random(seed)
    parts = [[] for _ in range(files)]
    size = -(-len(rows) // files)
    for i, r in enumerate(rows):
        parts[min(files - 1, i // size + (i % size > 0.7 * size and rng.random() < late_share))].append(r)
    parts.append([(-1, rows[-1][1] + 10**6 * S, "~", "~", "net", 0.0, 0.0, [0.0] * 32)])
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drained(spark, sdf, folder):
    q = sdf.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/r").trigger(availableNow=True).start()
    q.awaitTermination(200)
    return spark.read.schema(sdf.schema).parquet(f"{folder}/r"), q


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.with_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_late_rows_give_the_batch_decisions(spark, tmp_path):
    rows = events()
    step = steps.DecisionStep(DecisionParams())
    judge = lambda df: df.select(
        "event_id", "ts_us", "source", F.col("score").alias("confidence"), F.lit(0.0).alias("history"), F.lit(0.0).alias("drift"),
        F.lit(False).alias("false_positive"), F.when(F.col("score") < .5, "Alert").otherwise("Block").alias("decision"))
    sdf = ordered.fold_in_order(judge(arrive(spark, tmp_path / "in", rows, 4, 0.3)), ["source"], step, "event_id long, ts_us long, final string",
                                ["event_id", "ts_us", "final"], "10 minutes")
    got, _ = drained(spark, sdf, tmp_path / "out")
    batch = fold_by_key(judge(spark.createDataFrame(rows, EVENTS)), ["source"], step, "event_id long, final string")
    assert sorted(map(tuple, got.select("event_id", "final").collect())) == sorted(map(tuple, batch.collect()))
    assert got.agg(F.sum("late_rows")).first()[0] == 0


def test_segments_then_hierarchy_on_a_stream(spark, tmp_path):
    """Two stateful steps in a row, both in order of event time, equal the batch chain."""
    rows = events(160)
    flush, routing = FlushParams(max_events=7), RoutingParams()
    segments = ordered.segment_stream(arrive(spark, tmp_path / "in", rows, 3, 0.4), "10 minutes", flush, "embedding")
    got, _ = drained(spark, ordered.hierarchy_stream(segments, routing), tmp_path / "out")
    ev = spark.createDataFrame(rows, EVENTS)
    scanned = scoring.ssm_scan(ev, ["source"], "embedding", ["ts_us", "event_id"]).drop("embedding").withColumnRenamed("y", "state")
    whole = scoring.hierarchy_drift(scoring.segment_summary(scoring.segment_flush(scanned, ["source"], flush), ["source"], ["tenant", "state"]), ["tenant"], routing)
    shape = lambda df: sorted((r.source, r.segment_id, r.route, round(r.drift, 9), round(r.history, 9)) for r in df.collect())
    assert shape(got) == shape(whole) and got.count() > 10


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    """Rows may be a batch late whatever the watermark; those of the third file come two batches after newer ones."""
    rows = events(60)
    for i, part in enumerate([rows[40:], rows[30:40], rows[:30], [(-1, rows[-1][1] + 10**6 * S, "~", "~", "net", 0.0, 0.0, [0.0] * 32)]]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sdf = ordered.fold_in_order(arriving, ["source"], steps.CooldownStep(0), "event_id long, ts_us long", ["event_id", "ts_us"], "1 second")
    got, q = drained(spark, sdf, tmp_path / "out")
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    late = got.agg(F.coalesce(F.sum("late_rows"), F.lit(0))).first()[0]
    assert got.count() + dropped + late == len(rows) and dropped + late > 0


class _Store:
    """State of one group as a processor sees it, with the calls made to it."""

    def __init__(self):
        self.blocks, self.due, self.states, self.timers, self.calls = [], None, {}, set(), 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "getListState": lambda *_: self, "getValueState": lambda *_: self, "getMapState": lambda *_: self,
            "appendValue": self.blocks.append, "clear": lambda: None, "update": lambda v: setattr(self, "due", v),
            "registerTimer": self.timers.add, "deleteTimer": self.timers.remove, "getValue": self.states.get, "updateValue": self.states.__setitem__,
        }[name]


def test_a_micro_batch_calls_the_state_per_group_and_key_not_per_row():
    """5,000 rows of 50 sources in one group, out of order, one without a time."""
    rng, store = np.random.default_rng(5), _Store()
    schema = StructType.fromDDL("event_id bigint, ts_us bigint, source string")
    n = 5000
    rows = pd.DataFrame({"event_id": range(n), "ts_us": [float(i) * S for i in range(n)], "source": [f"s{i % 50}" for i in range(n)]})
    rows.loc[7, "ts_us"] = None
    shuffled = rows.iloc[rng.permutation(n)]
    one = ordered._InOrder(steps.CooldownStep(0), schema, ["source"], ["event_id", "ts_us", "source"], ["ts_us", "event_id"])
    one.handle, one.kept, one.timer, one.blocks = store, store, _Store(), _Store()
    one.timer.get, one.blocks.get = lambda: one.timer.due, lambda: list(one.blocks.blocks)
    one.blocks.clear = one.blocks.blocks.clear
    got = []
    for part, passed in ((shuffled[:2500], 3000), (shuffled[2500:], 10**6)):
        assert not list(one.handleInputRows((1,), iter([part]), None))
        assert len(store.timers) == 1
        store.timers.clear()
        got += list(one.handleExpiredTimer((1,), TimerValues(0, passed * 1000), None))
    out = pd.concat(got)
    seen, late = set(shuffled[:2500].event_id), int(out.late_rows.sum())
    for source, mine in out.groupby("source"):
        assert mine.ts_us.is_monotonic_increasing
        newest = max((i for i in seen if f"s{i % 50}" == source and i < 3000), default=-1)
        assert sorted(mine.event_id) == [i for i in range(n) if i != 7 and f"s{i % 50}" == source and (i in seen or i > newest)]
    assert len(out) + late == n and late > 1
    assert store.calls + one.timer.calls + one.blocks.calls < 2 * 2 * 50 + 40
