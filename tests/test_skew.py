"""Operators against brute force when one key holds a third of the rows or more."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilflow.operators import campaigns, joins, memory, ranks, scoring, similarity, sliced, steps, windows
from vigilflow.operators.folds import plan_keys
from vigilflow.params import CorrelationParams, DecisionParams, FlushParams, RoutingParams

S = 1_000_000


@pytest.fixture(autouse=True)
def few_rows_are_hot(monkeypatch):
    """Slice the hot key of these small inputs, and leave the others whole."""
    monkeypatch.setattr(sliced, "HOT_ROWS", 60)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, ts = [], 0
    for i in range(400):
        ts += rng.choice([0, 1, 2, 5, 40]) * S // 2
        source = "hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}"
        out.append((i, ts, source, f"d{rng.randrange(3)}", round(rng.random(), 3), rng.choice(["net", "auth", "proc"])))
    return out


@pytest.fixture(scope="module")
def ev(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts_us long, source string, destination string, score double, type string").cache()


@pytest.mark.parametrize("slice_s", [3.0, 50.0, 1e6])
def test_trailing_counts(ev, rows, slice_s):
    got = sliced.trailing_counts(ev, ["source"], {"n": (20.0, F.lit(True)), "m": (60.0, F.col("score") >= 0.5)}, slice_s).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [x for x in rows if x[2] == r.source and x[1] <= r.ts_us]
        assert r.n == sum(r.ts_us - x[1] <= 20 * S for x in near)
        assert r.m == sum(r.ts_us - x[1] <= 60 * S and x[4] >= 0.5 for x in near)


@pytest.mark.parametrize("slice_s", [3.0, 50.0])
def test_distinct_in_window(ev, rows, slice_s):
    for r in sliced.distinct_in_window(ev, ["destination"], "source", 30.0, slice_s, "n").collect():
        assert r.n == len({x[2] for x in rows if x[3] == r.destination and 0 <= r.ts_us - x[1] <= 30 * S})


@pytest.mark.parametrize("slice_s,n", [(2.0, 1), (2.0, 7), (30.0, 7), (1e6, 7)])
def test_row_halo(ev, rows, slice_s, n):
    w = sliced.sliced_window(["source"]).rowsBetween(-n, 0)
    got = sliced.drop_halo(sliced.with_row_halo(ev, ["source"], n, slice_s).withColumn("ids", F.collect_list("event_id").over(w))).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x[0] for x in sorted(rows, key=lambda x: (x[1], x[0])) if x[2] == r.source]
        at = mine.index(r.event_id)
        assert r.ids == mine[max(0, at - n): at + 1]


def test_running_sums_over_all(ev, rows):
    got = {r.event_id: r.no for r in sliced.running_sums(ev, [], {"no": F.lit(1)}).collect()}
    order = [x[0] for x in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert got == {e: i + 1 for i, e in enumerate(order)}


def test_bursts_and_empty_keys_split_by_rows(spark):
    """Rows of one instant, with and without a key, null keys too, fall into even slices and sum as one sequence."""
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.lit(S).alias("ts_us"), F.when(F.col("id") % 2 == 0, "a").alias("source"))
    sliced.HOT_ROWS = 100
    got = {r.event_id: r.no for r in sliced.running_sums(df, [], {"no": F.lit(1)}).collect()}
    assert got == {i: i + 1 for i in range(4000)}
    got = {r.event_id: r.no for r in sliced.running_sums(df, ["source"], {"no": F.lit(1)}).collect()}
    assert got == {i: i // 2 + 1 for i in range(4000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions of a worthwhile size
    sizes = [r.n for r in sliced._by_rows(df, [], sliced.ORDER).groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.5 * 4000


def test_near_miss_sequence(spark):
    values = [.10, .15, .30, .35, .40, .70]
    df = spark.createDataFrame([(i, i * S, "a", v) for i, v in enumerate(values)], "event_id long, ts_us long, source string, score double")
    from vigilflow.params import SuspicionParams

    got = windows.near_miss(df, 2.0, SuspicionParams(near_n=3)).orderBy("event_id").collect()
    assert [r.near_miss for r in got] == [False, False, False, False, True, False]


STEPS = {
    "decide": (steps.DecisionStep(DecisionParams(hold_s=4, alert_cooldown_s=6, block_cooldown_s=9, repeat_window_s=40)), "event_id long, final string"),
    "cool": (steps.CooldownStep(7.0), "event_id long"),
    "rate": (steps.RateLimitStep(3, 15.0), "event_id long, admitted boolean"),
    "segment": (steps.SegmentStep(FlushParams(max_events=9, max_age_s=30)), "event_id long, segment_id long, flushed boolean"),
    "ewma": (steps.EwmaStep("score", 0.2, 0.9), "event_id long, mean double, var double"),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_chunked_fold_equals_sequential(ev, name):
    step, schema = STEPS[name]
    judged = ev.withColumns({"confidence": F.col("score"), "history": F.col("score"), "drift": F.col("score") * 5, "false_positive": F.lit(False),
                             "decision": F.when(F.col("score") < .3, "Log").when(F.col("score") < .6, "Alert").when(F.col("score") < .9, "Block").otherwise("Escalate")})
    from vigilflow.operators.folds import fold_by_key

    whole = fold_by_key(judged, ["source"], step, schema)
    plan = plan_keys(judged, ["source"], max_rows=25, fine_s=2.0)
    assert plan.later is not None
    parts = fold_by_key(judged, ["source"], step, schema, plan=plan)
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    a, b = rounded(whole), rounded(parts)
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b):
        assert all((math.isclose(p, q, abs_tol=1e-9) if isinstance(p, float) else p == q) for p, q in zip(x, y))


def test_hot_keys_settle_in_few_rounds(spark):
    """One source in fifty chunks: segments and decisions settle at once and equal the sequential run."""
    from vigilflow.operators import folds

    rng = np.random.default_rng(8)
    n, types = 5000, ("net", "log", "auth")
    at = np.cumsum(rng.integers(1, 9, n))
    data = [(i, int(at[i]) * S, "a", types[int(rng.integers(0, 3)) if rng.random() < 0.1 else 0], float(rng.random())) for i in range(n)]
    df = spark.createDataFrame(data, "event_id long, ts_us long, source string, type string, score double").withColumns({
        "confidence": F.col("score"), "history": F.col("score"), "drift": F.col("score") * 3, "false_positive": F.lit(False),
        "decision": F.when(F.col("score") < .3, "Log").when(F.col("score") < .6, "Alert").when(F.col("score") < .9, "Block").otherwise("Escalate")})
    plan = plan_keys(df, ["source"], max_rows=100, fine_s=5.0)
    assert plan.later.agg(F.max("_chunk")).first()[0] >= 45
    for step, schema in ((steps.SegmentStep(FlushParams(max_events=9, max_age_s=30)), "event_id long, segment_id long, flushed boolean"),
                         (steps.DecisionStep(DecisionParams(repeat_window_s=60)), "event_id long, final string")):
        whole = sorted(map(tuple, folds.fold_by_key(df, ["source"], step, schema).collect()))
        parts = sorted(map(tuple, folds.fold_by_key(df, ["source"], step, schema, plan=plan).collect()))
        assert len(whole) == len(parts) == n
        for x, y in zip(whole, parts):
            assert all(math.isclose(p, q, abs_tol=1e-9) if isinstance(p, float) else p == q for p, q in zip(x, y)), (step, x, y)
        assert folds.settle_rounds <= 3


def test_rolling_stats_follow_the_recurrence():
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, 500.0, size=(700, len(steps.FEATURES)))
    rows = {f: x[:, i] for i, f in enumerate(steps.FEATURES)}
    out, end = steps.rolling_step(rows, None)
    mean, var = np.zeros(6), np.zeros(6)
    for t in range(len(x)):
        n = min(t + 1, 64)
        delta = x[t] - mean
        mean = mean + delta / (n + 1)
        var = var + (delta * (x[t] - mean) - var) / (n + 1)
        assert np.allclose([out[f"m_{f}"][t] for f in steps.FEATURES], mean, rtol=1e-9)
        assert np.allclose([out[f"v_{f}"][t] for f in steps.FEATURES], var, rtol=1e-9)
    head, state = steps.rolling_step({f: v[:300] for f, v in rows.items()}, None)
    tail, again = steps.rolling_step({f: v[300:] for f, v in rows.items()}, state)
    assert np.allclose(end["mean"], again["mean"]) and np.allclose(end["var"], again["var"])


def test_ewma_weighted_equals_fold(ev, rows):
    got = {r.source: r for r in scoring.baseline_ewma(ev, ["source"], ["score"], 0.1, 10.0, freeze=0.8).collect()}
    for source, r in got.items():
        mean = var = 0.0
        for x in sorted((x for x in rows if x[2] == source and x[4] < 0.8), key=lambda x: (x[1], x[0])):
            d = x[4] - mean
            var = 0.9 * (var + 0.1 * d * d)
            mean += 0.1 * d
        assert math.isclose(r.score_mean, mean, abs_tol=1e-12) and math.isclose(r.score_var, var, abs_tol=1e-12)


def test_hierarchy_levels():
    p = RoutingParams(mid_tick=2, global_tick=3, top_tick=4)
    rng = np.random.default_rng(1)
    n = 40
    rows = {"state": list(rng.normal(0, 30, (n, 32))), "trend": rng.uniform(0, 1, n), "last_score": np.where(np.arange(n) % 7 == 0, 0.95, 0.1)}
    whole, _ = steps.HierarchyStep(p)(rows, None)
    cutpoint = {k: v[:13] for k, v in rows.items()}, {k: v[13:] for k, v in rows.items()}
    a, state = steps.HierarchyStep(p)(cutpoint[0], None)
    b, _ = steps.HierarchyStep(p)(cutpoint[1], state)
    for c in ("drift", "history", "route"):
        assert list(whole[c]) == list(a[c]) + list(b[c])
    assert whole["route"][0] == "force" and max(whole["drift"]) > 0
    hist = 0.0
    seen = 0
    for t, peak, route, h in zip(rows["trend"], rows["last_score"], whole["route"], whole["history"]):
        seen += 1
        skip = peak <= 0.9 and t < 0.2 and seen < 3
        assert route == ("force" if peak > 0.9 else "skip" if skip else "pass")
        hist += 0.0 if skip else 0.05 * (t - hist)
        assert math.isclose(h, hist, abs_tol=1e-12)


def test_values_at_ranks_with_many_equal_values(spark):
    rng = random.Random(2)
    data = [("a", 1.0 if rng.random() < 0.4 else round(rng.random(), 4)) for _ in range(500)] + [("b", 0.5)] * 40
    df = spark.createDataFrame(data, "g string, v double")
    wanted = spark.createDataFrame([("a", r) for r in (0, 17, 250, 499)] + [("b", 39)], "g string, rank long")
    for r in ranks.values_at_ranks(df, ["g"], "v", wanted).collect():
        values = sorted(v for g, v in data if g == r.g)
        assert r.value == values[r.rank] and r.below == sum(v < r.value for v in values)


def test_count_below(spark):
    rng = random.Random(4)
    data = [rng.choice([0.0, 0.25, 1.0, rng.random()]) for _ in range(300)]
    points = spark.createDataFrame([(p,) for p in (0.0, 0.25, 0.2501, 0.9, 1.0)], "p double")
    got = ranks.count_below(spark.createDataFrame([(v,) for v in data], "v double"), "v", points, "p").collect()
    assert {r.p: r.below for r in got} == {p: sum(v < p for v in data) for p in (0.0, 0.25, 0.2501, 0.9, 1.0)}


def test_nearest_in_small_parts(spark):
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(60, 8))
    data = [(i, i * S, vec[i].tolist(), float(i % 3) / 3, "g") for i in range(60)]
    records = spark.createDataFrame(data, "record_id long, ts_us long, vector array<double>, score double, g string")
    probes = records.select(F.col("record_id").alias("probe_id"), "ts_us", "vector", "g")
    got = memory.nearest(probes, records, ["g"], 4, (0.5, 0.3, 0.2), 10.0, 30.0, earlier_only=True, part_rows=7).collect()
    found = {}
    for r in got:
        found.setdefault(r.probe_id, []).append((-r.score, r.record_id))
    for i in range(60):
        best = []
        for j in range(max(0, i - 30), i):
            cos = vec[i] @ vec[j] / (np.sqrt(vec[i] @ vec[i] + 1e-9) * np.sqrt(vec[j] @ vec[j] + 1e-9))
            best.append((-(0.5 * cos + 0.3 * (j % 3) / 3 + 0.2 * math.exp(-(i - j) / 10)), j))
        assert [j for _, j in sorted(found.get(i, []))] == [j for _, j in sorted(best)[:4]]


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    got = {r.node: r.label for r in campaigns.component_labels(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["q"] == "q" and got["n040"] == "n000"


def test_weak_campaigns_stay_closed(spark):
    data = [(1, 0, "s1", "d", 0.1, "A"), (2, S, "s1", "d", 0.2, "B"), (3, 9000 * S, "s2", "d", 0.9, "C")]
    al = spark.createDataFrame(data, "event_id long, ts_us long, source string, destination string, score double, attack_class string")
    got = {r.event_id: r.campaign_id for r in campaigns.campaigns(al, 60.0, CorrelationParams()).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


def test_any_number_of_rules_and_signatures(spark, ev, monkeypatch):
    """Null thresholds match nothing, repeated events keep their own rules, and parts change nothing."""
    rules = spark.createDataFrame(
        [(1, "low", 0.2, "", True), (2, "hot", 0.99, "hot", True), (3, "off", 0.0, "", False), (4, "all", 0.0, "s", True),
         (5, "none", None, None, True), (6, "addr", None, "hot", True)],
        "id long, name string, threshold double, pattern string, enabled boolean")
    twice = ev.unionByName(ev.limit(3))
    whole = sorted((r.event_id, tuple(r.rules)) for r in joins.match_rules(twice, rules).collect())
    score = {r.event_id: (r.score, r.source) for r in ev.collect()}

    def expected(event):
        s, source = score[event]
        out = []
        for i, name, threshold, pattern, on in sorted(map(tuple, rules.collect())):
            out += [name] * bool(on and threshold is not None and threshold <= s)
            out += [f"{name}:ip"] * bool(on and pattern and pattern in source)
        return tuple(out)

    assert len(whole) == ev.count() + 3 and all(names == expected(event) for event, names in whole)
    monkeypatch.setattr(joins, "RULE_PART", 2)
    assert whole == sorted((r.event_id, tuple(r.rules)) for r in joins.match_rules(twice, rules).collect())

    hits = sorted(map(tuple, joins.rule_matches(joins.met_rules(twice, rules)).groupBy("rule_id").count().collect()))
    met = [i for event, _ in whole for i in {dict(low=1, hot=2, off=3, all=4, addr=6)[n.removesuffix(":ip")] for n in expected(event)}]
    assert hits == sorted({i: met.count(i) for i in met}.items())

    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(20)], "id long, embedding array<double>")
    signatures = vectors.select(F.col("id").alias("signature"), F.col("embedding").alias("vector"))
    best = sorted(map(tuple, similarity.match_signatures(vectors, signatures).select("id", "signature", "cosine").collect()))
    monkeypatch.setattr(similarity, "SIGNATURE_PART", 3)
    assert best == sorted(map(tuple, similarity.match_signatures(vectors, signatures).select("id", "signature", "cosine").collect()))


def test_hits_of_rules_with_awkward_names(spark):
    """Two rules of one name keep their own hits, and a name that ends like an address match is just a name."""
    rules = spark.createDataFrame(
        [(1, "same", 0.5, "", True), (2, "same", 0.99, "", True), (3, "x:ip", 0.5, "", True), (4, "x", None, "10.", True)],
        "id long, name string, threshold double, pattern string, enabled boolean")
    events = spark.createDataFrame([(1, 5, "10.0.0.1", 0.9), (2, 6, "h", 0.9), (3, 7, "h", None), (4, 8, "10.1", 0.1)], "event_id long, ts_us long, source string, score double")
    met = joins.met_rules(events, rules)
    assert sorted(map(tuple, joins.rule_matches(met).collect())) == [(1, 5), (1, 6), (3, 5), (3, 6), (4, 5), (4, 8)]
    named = {r.event_id: r.rules for r in joins.match_rules(events, rules).collect()}
    assert named == {1: ["same", "x:ip", "x:ip"], 2: ["same", "x:ip"], 3: [], 4: ["x:ip"]}
    assert joins.match_rules(events, rules.limit(0)).filter("size(rules) = 0").count() == 4


def test_evict_breaks_ties_by_id(spark):
    data = [("ip", "k", i, 0, 0.5 if i < 30 else 0.9) for i in range(40)] + [("ip", "small", 99, 0, 0.1)]
    mem = spark.createDataFrame(data, "scope string, scope_key string, record_id long, ts_us long, score double")
    left = {r.record_id for r in memory.evict(mem, S, {"ip": 20}).collect()}
    assert left == set(range(10, 40)) | {99}


def test_ip_window_counts_many_protocols(spark):
    """Twenty rows, all of different protocols: only then is the entropy above half of eight bits."""
    def run(kinds):
        sliced.HOT_ROWS = 5
        data = [(i, i * S, "a", 0, i % kinds, 4000, 0) for i in range(20)]
        df = spark.createDataFrame(data, "event_id long, ts_us long, source string, flags int, protocol int, bytes_in long, bytes_out long")
        return [r.ip_window for r in windows.ip_window(df, 3.0).orderBy("event_id").collect()]

    assert run(20)[-1] == 0.2 and run(3)[-1] == 0.0 and run(20)[:3] == [0.0, 0.0, 0.0]
