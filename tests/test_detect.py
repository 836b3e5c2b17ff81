"""Detection end to end: what an event sees of segments, hierarchy and memory, and the alerts that follow from each."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigilflow.operators import scoring
from vigilflow.params import FlushParams, MemoryParams, Profile
from vigilflow.plans import detect as plan

S = 1_000_000
SCORED = "event_id long, ts_us long, source string, destination string, tenant string, type string, score double, rate_hz double, embedding array<double>, rules array<string>"
P = Profile(flush=FlushParams(max_events=5))


@pytest.fixture(scope="module")
def data():
    rng, ts, out = random.Random(5), 10**9 * S, []
    for i in range(160):
        ts += rng.choice([0, 1, 2, 90]) * S
        out.append((i, ts, rng.choice("abc"), rng.choice("xy"), rng.choice(["t", "t", "u"]), rng.choice(["net", "net", "proc"]),
                    round(rng.random(), 3), float(rng.randrange(9)), [rng.gauss(0, 2) for _ in range(64)], ["r"] if i % 40 == 7 else []))
    return out


@pytest.fixture(scope="module")
def scored(spark, data):
    return spark.createDataFrame(data, SCORED).cache()


def test_events_see_the_last_flush_of_their_tenant(spark, data, scored):
    got = {r.event_id: r for r in plan.with_hierarchy(scored, P).collect()}
    scanned = scoring.ssm_scan(scored, ["source"], "embedding", ["ts_us", "event_id"]).withColumnRenamed("y", "state")
    segments = scoring.segment_summary(scoring.segment_flush(scanned, ["source"], P.flush), ["source"], ["tenant", "state"])
    reached = sorted(((r.ts_us, r.event_id, r) for r in scoring.hierarchy_drift(segments, ["tenant"], P.routing).collect()), key=lambda x: x[:2])
    assert len(got) == len(data) and len(reached) > 20
    for event, ts, source, _, tenant, *_ in data:
        before = [r for t, e, r in reached if (t, e) <= (ts, event)]
        own, shared = [r for r in before if r.source == source], [r for r in before if r.tenant == tenant]
        row = got[event]
        assert (row.drift, row.history) == ((shared[-1].drift, shared[-1].history) if shared else (0.0, 0.0))
        assert math.isclose(row.trend, own[-1].trend if own else 0.0) and row.dominant_type == (own[-1].dominant_type if own else "")


def test_events_find_what_was_remembered_before(data, scored):
    got = {r.event_id: r for r in plan.with_memory(scored.withColumn("drift", F.lit(0.0)), P).collect()}
    m = MemoryParams()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    last, found_any = {}, 0
    for event, ts, source, dest, _, _, score, _, vec, _ in data:
        best = {}
        if score >= P.gate.threshold * 0.5 and ts - last.get(source, -S) >= S:
            last[source] = ts
            for scope, k, weight in (("ip", 3, 1.0), ("host", 2, 0.7), ("global", 4, 0.5)):
                hits = []
                for e2, t2, s2, d2, _, _, sc2, _, v2, rules2 in data:
                    kept = sc2 >= m.write_gate or rules2
                    belongs = {"ip": s2 == source, "host": d2 == dest and sc2 >= m.write_gate, "global": sc2 >= m.force_gate}[scope]
                    if kept and belongs and (t2, e2) <= (ts, event) and ts - t2 <= m.max_age_s * S:
                        cos = dot(vec, v2) / math.sqrt((dot(vec, vec) + 1e-9) * (dot(v2, v2) + 1e-9))
                        hits.append((0.5 * cos + 0.3 * sc2 + 0.2 * math.exp(-(ts - t2) / S / m.recency_tau_s) + weight, -e2, cos))
                for total, e2, cos in sorted(hits, reverse=True)[:k]:
                    best[e2] = max(best.get(e2, (-9, 0)), (total, cos))
        kept = sorted(best.values(), reverse=True)[: m.top_k]
        row = got[event]
        assert [round(x, 9) for x in row.retrieved] == [round(t, 9) for t, _ in kept]
        assert math.isclose(row.similarity, max((c for _, c in kept), default=0.0), abs_tol=1e-9)
        found_any += bool(kept)
    assert found_any > 40 and len(got) == len(data)


CALM = dict(score=0.3, trend=0.1, history=0.0, drift=0.0, similarity=0.0, retrieved=[], rules=[], burst=0.0, rate_mean=0.0, entropy=0.1,
            error_freq=0.0, dominant_type="proc", source="a")
KINDS = ("score double, trend double, history double, drift double, similarity double, retrieved array<double>, rules array<string>, burst double,"
         " rate_mean double, entropy double, error_freq double, dominant_type string, source string")


@pytest.mark.parametrize(("change", "decision"), [
    ({}, "Ignore"), ({"drift": 9.0, "score": 0.5}, "Log"), ({"history": 0.9, "score": 0.4}, "Log"), ({"similarity": 0.95, "score": 0.5, "history": 0.4}, "Log"),
    ({"score": 0.5, "history": 0.4}, "Ignore"), ({"score": 0.5}, "Ignore"), ({"score": 0.4}, "Ignore"),
    ({"score": 0.6, "trend": 0.6, "similarity": 0.9, "retrieved": [1.2]}, "Alert"), ({"score": 0.6, "trend": 0.6, "similarity": 0.9}, "Log"),
    ({"rules": ["r"]}, "Block"),
])
def test_drift_history_and_retrieval_raise_alerts(spark, change, decision):
    """Beside every raised alert stands the same event without the evidence."""
    row = {**CALM, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in KINDS.split(", "))], KINDS)
    assert plan.reasoned(df, Profile()).first().decision == decision


def test_lateral_movement_needs_drift(spark):
    rows_ = [tuple({**CALM, "score": 0.95, "trend": 0.5, "drift": d}[c.split()[0]] for c in KINDS.split(", ")) for d in (0.0, 9.0)]
    got = [r.attack_class for r in plan.reasoned(spark.createDataFrame(rows_, KINDS), Profile()).orderBy("drift").collect()]
    assert got[1] == "LateralMovement/Persistence" != got[0]


def test_reconstruction_without_a_model_learns_from_calm_events(scored):
    out = plan.with_reconstruction(scored).select("event_id", "score").collect()
    before = {r.event_id: r.score for r in scored.collect()}
    assert all(0.85 * before[r.event_id] - 1e-9 <= r.score <= 0.85 * before[r.event_id] + 0.15 + 1e-9 for r in out)


def test_numbering_moves_no_vectors(scored, monkeypatch):
    """Vectors and states are written once by source; a tenant's flushes are counted on narrow rows."""
    moved, real = [], plan.running_sums
    monkeypatch.setattr(plan, "running_sums", lambda df, *a: moved.append(df.columns) or real(df, *a))
    out = plan.with_hierarchy(scored, P)
    assert moved and not {"embedding", "state"} & {c for names in moved for c in names}
    assert {"embedding", "drift", "history", "trend"} <= set(out.columns)
