"""Detection matches all rules and carries the first name of each event's through its stages."""

import pytest
from pyspark.sql import functions as F

from vigilflow.operators import joins
from vigilflow.params import Profile
from vigilflow.plans import detect as plan

RULES = [(i, f"r{i}", i / 50, "10." if i % 7 == 0 else "", True) for i in range(50)]


class Reached(Exception):
    pass


def test_stages_carry_one_name(spark, monkeypatch):
    rules = spark.createDataFrame(RULES, "id long, name string, threshold double, pattern string, enabled boolean")
    ev = spark.createDataFrame([(i, i * 10**6, "10.0.0.1" if i % 2 else "h", "t", i / 20) for i in range(21)], "event_id long, ts_us long, source string, tenant string, score double")
    monkeypatch.setattr(plan, "plan_keys", lambda *a: None)
    monkeypatch.setattr(plan, "local_scores", lambda ev, p, plan: ev)
    monkeypatch.setattr(plan, "with_reconstruction", lambda df, model: df)

    def stop(df, *a):
        raise Reached(df)

    monkeypatch.setattr(plan, "with_hierarchy", stop)
    with pytest.raises(Reached) as at:
        plan.detect(ev, Profile(), rules)
    got = {r.event_id: r.rules for r in at.value.args[0].collect()}
    whole = {r.event_id: r.rules for r in joins.match_rules(ev, rules).collect()}
    assert got == {i: names[:1] for i, names in whole.items()} and max(map(len, whole.values())) > 50
    assert plan.with_rules(ev, rules).filter(F.size("rules") > 50).count() > 0
