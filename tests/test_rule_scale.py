"""Rules are matched per distinct set of rules met, not per event and rule; hits are counted without a row each."""

import random

import pytest
from pyspark.sql import functions as F

from vigilflow.operators import dashboards, joins

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    data = [(i, i, rng.choice(["10.0.0.1", "10.0.0.12", "h", "", None]), rng.choice([None, 0.0, 0.25, 0.5, 0.7, 1.0, float("nan")])) for i in range(300)]
    return spark.createDataFrame(data + data[:20], "event_id long, ts_us long, source string, score double").cache()


@pytest.fixture(scope="module")
def rules(spark):
    data = [(i, f"r{i}", [0.2, 0.5, 0.50001, 1.0][i % 4], ["", "10.", "0.12", None][i % 3], i % 6 != 5) for i in range(24)]
    # repeated ids with other tests, no threshold, no id
    data += [(1, "r1", 0.9, "0.0.1", True), (1, "again", None, "h", True), (40, "never", 2.0, "", True), (41, "addr", None, "0.1", True), (None, "lost", 0.1, "h", True)]
    return spark.createDataFrame(data, "id long, name string, threshold double, pattern string, enabled boolean").cache()


def expected(events, rules):
    """Per event (names, ids) by testing every rule."""
    at_least = lambda x, t: x is not None and t is not None and (x != x or x >= t)  # noqa: E731 - NaN is above all numbers
    live = sorted((r for r in rules.collect() if r.enabled), key=lambda r: (r.id is not None, r.id or 0))
    for e in events.collect():
        met = []
        for r in live:
            met += [(r.id is not None, r.id or 0, 0, r.name)] * at_least(e.score, r.threshold)
            met += [(r.id is not None, r.id or 0, 1, f"{r.name}:ip")] * bool(r.pattern and e.source and r.pattern in e.source)
        yield e, [m[3] for m in sorted(met)], {m[1] for m in met if m[0]}


def test_lists_are_made_once_for_events_that_meet_the_same(events, rules, monkeypatch):
    made = []
    real = joins._met
    monkeypatch.setattr(joins, "_met", lambda marks, live: made.append(marks.count()) or real(marks, live))
    want = sorted((e.event_id, len(names), ",".join(names)) for e, names, _ in expected(events, rules))
    columns = {"n": F.size, "text": lambda names: F.array_join(names, ",")}
    assert want == sorted(map(tuple, joins.match_rules(events, rules, made=columns).select("event_id", "n", "text").collect()))
    assert made[0] < 30  # 320 events
    monkeypatch.setattr(joins, "SPREAD_BYTES", 0)
    monkeypatch.setattr(joins, "RULE_PART", 3)
    assert want == sorted(map(tuple, joins.match_rules(events, rules, made=columns).select("event_id", "n", "text").collect()))


def test_hits_are_counted_without_a_row_each(events, rules):
    want = {}
    for e, _, ids in expected(events, rules):
        for i in ids:
            n, last = want.get(i, (0, 0))
            want[i] = (n + 1, max(last, e.ts_us))
    counted = joins.rule_matches(joins.met_rules(events, rules, marks=True), rules)
    assert {r.rule_id: (r.hits, r.ts_us) for r in counted.collect() if r.rule_id is not None} == want
    hits = dashboards.rule_hits(counted, rules)
    assert sorted((r.name, r.triggers, r.last_hit_us) for r in hits.collect()) == sorted((r.name, *want.get(r.id, (0, None))) for r in rules.collect())


def test_stats_of_counted_hits(events, rules):
    late = events.withColumn("ts_us", F.col("ts_us") + F.when(F.col("source") == "10.0.0.12", DAY).otherwise(0))
    counted = joins.rule_matches(joins.met_rules(late, rules, marks=True), rules)
    got = dashboards.rule_stats(dashboards.rule_hits(counted, rules), DAY + 500).first()
    today = {i for e, _, ids in expected(late, rules) if e.ts_us >= DAY for i in ids}
    all_rules = rules.collect()
    assert got.total == len(all_rules) and got.active == sum(r.enabled for r in all_rules)
    assert got.triggered_today == sum(r.id in today for r in all_rules if r.id is not None)


def test_few_values_are_one_part_whatever_the_partitions(spark, events, rules, monkeypatch):
    dealt = []
    real = joins._dealt
    monkeypatch.setattr(joins, "_dealt", lambda df, by: dealt.append(real(df, by).select("_part").distinct().count()) or real(df, by))
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        joins.met_rules(events, rules, marks=True)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert set(dealt) == {1}
    monkeypatch.setattr(joins, "RULE_PART", 3)
    assert joins._dealt(rules, F.col("name")).select("_part").distinct().count() > 3


def test_long_lists_are_made_in_tasks_of_their_own(events, rules, monkeypatch):
    """A writer that has met many short rows looks at its memory too late for long ones."""
    columns = {"n": F.size, "text": lambda names: F.array_join(names, ",")}
    want = sorted((e.event_id, len(names), ",".join(names)) for e, names, _ in expected(events, rules))
    monkeypatch.setattr(joins, "LONG_BYTES", 60)
    for spread in (0, 200):
        monkeypatch.setattr(joins, "SPREAD_BYTES", spread)
        got = joins.match_rules(events, rules, made=columns).select("event_id", "n", "text", F.spark_partition_id().alias("task")).collect()
        assert sorted((r.event_id, r.n, r.text) for r in got) == want
        tasks = [{r.task for r in got if (len(f'{{"n":{r.n},"text":"{r.text}"}}') > 60) == long} for long in (True, False)]
        assert all(tasks) and not tasks[0] & tasks[1]
