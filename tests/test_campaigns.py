"""Campaigns grown batch by batch equal those of all alerts at once; a class that never rests stays divided."""

import json
import random
from dataclasses import replace

import numpy as np
import pytest

from vigilflow.operators import campaigns, steps
from vigilflow.params import US, CorrelationParams
from vigilflow.streaming import campaigns as grown

P = CorrelationParams(campaign_idle_s=30.0)
KINDS = "event_id long, ts_us long, source string, destination string, score double, attack_class string, extra int"


def alerts(n=300, seed=5):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, 3, 9, 45]) * US
        out.append((i, t, f"s{rng.randint(0, 25)}", f"d{rng.randint(0, 3)}", rng.random() * 0.55, f"c{rng.randint(0, 5)}", i))
    return out


def by_loop(rows, p):
    """Union of class and source sessions, named by the smallest; idle and age end a session."""
    parent, last, strong, nodes = {}, {}, set(), []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, ts, source, _, score, kind, _ in rows:
        names = []
        for tag, key in (("class", kind), ("source", source)):
            no, start, seen = last.get((tag, key), (0, None, None))
            aged = p.campaign_max_s is not None and start is not None and ts - start > p.campaign_max_s * US
            if seen is None or ts - seen > p.campaign_idle_s * US or aged:
                no, start = no + 1, ts
            last[tag, key] = (no, start, ts)
            names.append(f"{tag}|{key}|{no:012d}")
        a, b = sorted(map(find, names))
        parent[b] = a
        nodes.append((i, names[0], score))
    for _, node, score in nodes:
        if score >= p.campaign_min_score:
            strong.add(find(node))
    return {i: find(node) if find(node) in strong else None for i, node, _ in nodes}


@pytest.mark.parametrize("p", [P, replace(P, campaign_max_s=60.0)])
def test_ten_batches_equal_one(spark, tmp_path, p):
    rows = alerts()
    want = by_loop(rows, p)
    assert len(set(want.values())) > 4 and None in want.values()
    df = spark.createDataFrame(rows, KINDS)
    assert {r.event_id: r.campaign_id for r in campaigns.campaigns(df, 60.0, p).collect()} == want
    add = grown.campaign_batch(str(tmp_path), p, max_rows=7 if p.campaign_max_s else 200_000)
    for i in range(5):
        batch = df.filter((df.event_id >= 60 * i) & (df.event_id < 60 * (i + 1)))
        add(batch.repartition(3), i)
        if i == 2:
            add(batch, i)  # a batch that is run again changes nothing
            add(batch.limit(0), 9)
    got = grown.current(spark, str(tmp_path))
    assert got.columns == [*df.columns, "campaign_id"]
    assert {r.event_id: r.campaign_id for r in got.collect()} == want


def test_a_class_in_every_hour_is_more_than_one_campaign(spark):
    rows = [(i, i * 600 * US, f"s{i // 12}", "d", 0.9, "scan", 0) for i in range(72)]
    df = spark.createDataFrame(rows, KINDS)
    count = lambda p: campaigns.campaigns(df, 3600.0, p).select("campaign_id").distinct().count()
    assert count(CorrelationParams()) == 1
    assert count(CorrelationParams(campaign_max_s=7199.0)) == 6


def test_a_resumed_step_goes_on():
    ts = np.array([0, 1, 50, 51, 200, 260, 261], dtype=np.int64) * US
    step = steps.Resumed(steps.FlowCutStep(40, 100))
    whole, end = step({"ts_us": ts, "_seed": [None] * 7}, None)
    first, state = step({"ts_us": ts[:4], "_seed": [None] * 4}, None)
    rest, last = step({"ts_us": ts[4:], "_seed": [json.dumps(state)] * 3}, None)
    assert [*first["flow"], *rest["flow"]] == whole["flow"].tolist() and last == end
    assert [*first["opened_us"], *rest["opened_us"]] == whole["opened_us"].tolist()
