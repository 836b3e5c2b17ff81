"""Windows, correlation and retention over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import dashboards, rows, windows
from ..params import sparse_profile
from ..sources import tables as t

P = sparse_profile()
SLICE = P.slice_s
DAY = 86_400_000_000


def r6(c):
    return F.round(c, 6)


def inter_arrival(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source")
    # a day of the sparse data stands for a second
    return windows.inter_arrival(ev.withColumn("ts_us", F.expr("ts_us div 7200")), ["source"], SLICE / 7200).select(
        "event_id", F.round(F.col("inter_arrival") * 1e7).cast("long").alias("inter_arrival_us")
    )


def protocol_entropy(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "protocol")
    return windows.local_shape(ev, ["source"], SLICE).select("event_id", r6("protocol_entropy").alias("protocol_entropy"))


def burst_metric(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "protocol")
    return windows.local_shape(ev, ["source"], SLICE).select("event_id", r6("burst").alias("burst"))


def near_miss(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "score")
    return windows.near_miss(ev, SLICE, P.suspicion).select("event_id", "near_miss")


IP_COLUMNS = ("event_id", "ts_us", "source", "flags", "protocol", "bytes_in", "bytes_out", "score")


def ip_window_score(spark, sf):
    return windows.ip_window(t.flows(spark, sf).select(*IP_COLUMNS), SLICE, P.suspicion).select(
        "event_id", r6("ip_window").alias("ip_window")
    )


def suspicion_boost(spark, sf):
    ev = t.flows(spark, sf).select(*IP_COLUMNS).withColumnsRenamed({"score": "confidence"})
    ev = ev.withColumn("decision", scores.decide(F.col("confidence")))
    return windows.suspicion_boost(ev, SLICE, P.suspicion).select(
        "event_id", r6("confidence").alias("confidence"), "decision"
    )


ALERT_COLUMNS = ("event_id", "ts_us", "source", "destination", "score", "decision", "attack_class")


def _alerts(spark, sf):
    return t.alerts(spark, sf).select(*ALERT_COLUMNS)


def repeat_alerts(spark, sf):
    out = windows.repeat_and_slow(_alerts(spark, sf), SLICE, P.correlation)
    return out.select("event_id", "repeat_count", (F.col("repeat_count") >= P.correlation.repeat_n).alias("repeat"))


def slow_attack(spark, sf):
    out = windows.repeat_and_slow(_alerts(spark, sf), SLICE, P.correlation)
    return out.select("event_id", "slow_count", (F.col("slow_count") >= P.correlation.slow_n).alias("slow_attack"))


def distributed_attack(spark, sf):
    out = windows.distributed(_alerts(spark, sf), SLICE, P.correlation)
    return out.select("event_id", "source_count", (F.col("source_count") >= P.correlation.dist_sources).alias("distributed"))


def multi_stage(spark, sf):
    return windows.multi_stage(_alerts(spark, sf), P.patterns).select("event_id", "multi_stage")


def stage_completions(spark, sf):
    return windows.stage_completions(_alerts(spark, sf), P.patterns).select(
        "source", "pattern", F.col("done.ts_us").alias("done_us"), F.col("done.event_id").alias("done_event")
    )


def correlate(spark, sf):
    out = windows.correlate(_alerts(spark, sf), SLICE, P.correlation, P.patterns)
    return out.select(
        "event_id", "repeat", "multi_stage", "distributed", "slow_attack",
        r6("corr_score").alias("corr_score"), "correlation_type", "upgraded_decision",
    )


def top_correlated_sources(spark, sf):
    """Flagship: validate, score, correlate, then rank sources by alert count."""
    ev = rows.validate(t.flows(spark, sf))
    al = ev.withColumn("decision", scores.decide(F.col("score"))).filter(F.col("decision") != "Ignore")
    al = al.withColumn("attack_class", F.expr(
        "case type when 'net' then 'PortScan' when 'auth' then 'BruteForce/CredentialStuffing'"
        " when 'proc' then 'LateralMovement/Persistence' when 'file' then 'FileSystemAnomaly/Ransomware'"
        " else 'EncryptedC2/Exfiltration' end"))
    out = windows.correlate(al.select(*ALERT_COLUMNS), SLICE, P.correlation, P.patterns)
    upgraded = out.filter(F.col("upgraded_decision") == "Escalate")
    return dashboards.top_talkers(upgraded, 10)


def retain_last_n(spark, sf):
    return windows.retain_last(_alerts(spark, sf), ["source"], 20).select("event_id", "source")


def alert_ring(spark, sf):
    return dashboards.newest(_alerts(spark, sf), 500).select("event_id", "ts_us", "source", "decision")


def alert_seq(spark, sf):
    return windows.alert_seq(_alerts(spark, sf)).select("event_id", "alert_seq")


def sample_one_in_n(spark, sf):
    return windows.sample_one_in(t.flows(spark, sf).select("event_id", "ts_us", "source"), 10).select("event_id", "source")


def repeat_escalate(spark, sf):
    out = windows.repeat_escalate(_alerts(spark, sf), SLICE, P.decision.repeat_n, P.decision.repeat_window_s)
    return out.select("event_id", "alerts_in_run", "repeat_escalate")


def source_sessions(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source")
    return windows.sessions(ev, ["source"], 43200.0, SLICE).select("event_id", "session_no")


def state_expiry(spark, sf):
    ev = t.flows(spark, sf).select("ts_us", "source")
    return windows.state_phase(ev, 1706659200000000, idle_s=3600.0, expire_s=43200.0).select("source", "events", "phase")


QUERIES = {
    "top_correlated_sources": top_correlated_sources,
    "inter_arrival": inter_arrival, "protocol_entropy": protocol_entropy, "burst_metric": burst_metric,
    "near_miss": near_miss, "ip_window_score": ip_window_score, "suspicion_boost": suspicion_boost,
    "repeat_alerts": repeat_alerts, "slow_attack": slow_attack, "distributed_attack": distributed_attack,
    "multi_stage": multi_stage, "stage_completions": stage_completions, "correlate": correlate,
    "retain_last_n": retain_last_n, "alert_ring": alert_ring, "alert_seq": alert_seq,
    "sample_one_in_n": sample_one_in_n, "repeat_escalate": repeat_escalate,
    "source_sessions": source_sessions, "state_expiry": state_expiry,
}

_F, _A = f"with {t.FLOWS_SQL} ", f"with {t.ALERTS_SQL} "
_BY = "partition by source order by ts_us, event_id"
_RANGE = lambda days: f"range between {int(days * DAY)} preceding and current row"

SHAPE_SQL = f"""with {t.FLOWS_SQL}, gaps as (
  select *, (ts_us - lag(ts_us) over ({_BY})) / 1000000.0::double as gap from flows)"""

IP_SQL = """{0}, framed as (
  select *, count(*) over w as n, count(*) filter (where (flags & 2) <> 0) over w as syn,
    count(*) filter (where (flags & 4) <> 0) over w as rst,
    count(*) filter (where (flags & 1) <> 0) over w as fin,
    sum(bytes_in + bytes_out) over w as total, entropy(protocol) over w / 8 as h
  from {1} window w as (partition by source order by ts_us, event_id rows between 19 preceding and current row)),
ipw as (
  select *, case when n < 4 then 0.0::double else greatest(
    case when syn / n > 0.8 and rst / n < 0.1 then 0.5::double else 0 end,
    case when rst / n > 0.3 then 0.4::double else 0 end,
    case when syn > 0 and fin > syn * 3 then 0.35::double else 0 end,
    case when total / n < 50 and n > 10 then 0.3::double else 0 end,
    case when h > 0.5 then 0.2::double else 0 end) end as ip_window from framed)"""

CORR_SQL = f"""with recursive {t.ALERTS_SQL}, counted as (
  select *, count(*) over (partition by source order by ts_us {_RANGE(1)}) as repeat_count,
    count(*) filter (where score >= 0.3) over (partition by source order by ts_us {_RANGE(30)}) as slow_count,
    count(distinct source) over (partition by destination order by ts_us {_RANGE(1)}) as source_count
  from alerts),
a1 as (select source, min(row(ts_us, event_id)) as d from alerts where attack_class = 'PortScan' group by source),
b1 as (select source, min(row(ts_us, event_id)) as d, any_value(p) as p from (select al.*, a1.d as p from alerts al join a1 using (source) where attack_class = 'BruteForce/CredentialStuffing' and row(al.ts_us, al.event_id) > a1.d) group by source),
b1ok as (select source, d from b1 where d[1] - p[1] <= {10 * DAY}),
c1 as (select source, min(row(ts_us, event_id)) as d, any_value(p) as p from (select al.*, x.d as p from alerts al join b1ok x using (source) where attack_class = 'LateralMovement/Persistence' and row(al.ts_us, al.event_id) > x.d) group by source),
a2 as (select source, min(row(ts_us, event_id)) as d from alerts where attack_class = 'BruteForce/CredentialStuffing' group by source),
b2 as (select source, min(row(ts_us, event_id)) as d, any_value(p) as p from (select al.*, a2.d as p from alerts al join a2 using (source) where attack_class = 'FileSystemAnomaly/Ransomware' and row(al.ts_us, al.event_id) > a2.d) group by source),
b2ok as (select source, d from b2 where d[1] - p[1] <= {30 * DAY}),
c2 as (select source, min(row(ts_us, event_id)) as d, any_value(p) as p from (select al.*, x.d as p from alerts al join b2ok x using (source) where attack_class = 'EncryptedC2/Exfiltration' and row(al.ts_us, al.event_id) > x.d) group by source),
done as (select source, 'LateralMovement' as pattern, d from c1 where d[1] - p[1] <= {10 * DAY}
  union all select source, 'APT-Exfiltration', d from c2 where d[1] - p[1] <= {30 * DAY}),
first_done as (select source, min(d) as d from done group by source),
staged as (select c.*, coalesce(row(c.ts_us, c.event_id) >= f.d, false) as multi_stage
  from counted c left join first_done f using (source)),
flagged as (select *, repeat_count >= 3 as repeat, slow_count >= 10 as slow_attack,
  source_count >= 5 as distributed from staged),
corr as (select *, case when repeat then 0.2::double else 0 end + case when multi_stage then 0.3::double else 0 end
    + case when distributed then 0.25::double else 0 end + case when slow_attack then 0.15::double else 0 end as corr_score,
  case when slow_attack then 'slow_attack' when distributed then 'distributed'
    when multi_stage then 'multi_stage' when repeat then 'repeat' else '' end as correlation_type from flagged),
upgraded as (select *, case when corr_score > 0.4 and decision = 'Alert' then 'Escalate' else decision end
  as upgraded_decision from corr)"""

_RUNS = f"""with {t.ALERTS_SQL}, marked as (
  select *, case when ts_us - lag(ts_us) over ({_BY}) <= {5 * DAY} then 0 else 1 end as fresh from alerts),
runs as (select *, sum(fresh) over ({_BY}) as run from marked),
numbered as (select *, row_number() over (partition by source, run order by ts_us, event_id) as alerts_in_run,
  min(ts_us) over (partition by source, run) as first_us from runs)"""

ORACLE = {
    "top_correlated_sources": f"{CORR_SQL} select source as ip, count(*) as alert_count, max(ts_us) as last_seen_us, cast(least(100, count(*) * 5) as bigint) as threat_score from upgraded where upgraded_decision = 'Escalate' group by source order by alert_count desc, ip limit 10",
    "inter_arrival": f"{_F} select event_id, cast(coalesce(least(10000000, greatest(0, z - lag(z) over (partition by source order by z, event_id))), 0) as bigint) as inter_arrival_us from (select *, ts_us // 7200 as z from flows)",
    "protocol_entropy": f"{_F} select event_id, round(entropy(protocol) over ({_BY} rows between 63 preceding and current row) / 8, 6) as protocol_entropy from flows",
    "burst_metric": f"{SHAPE_SQL} select event_id, round(case when count(*) over ({_BY} rows between 63 preceding and current row) < 3 then 0 when avg(gap) over g < 1e-9 then 1 else least(1, greatest(0, stddev_pop(gap) over g / avg(gap) over g)) end, 6) as burst from gaps window g as ({_BY} rows between 62 preceding and current row)",
    "near_miss": f"{_F} select event_id, score >= 0.25 and score < 0.6 and count(*) filter (where score >= 0.25 and score < 0.6) over (partition by source order by ts_us {_RANGE(1)}) >= 5 as near_miss from flows",
    "ip_window_score": f"with {IP_SQL.format(t.FLOWS_SQL, 'flows')} select event_id, round(ip_window, 6) as ip_window from ipw",
    "suspicion_boost": "with " + IP_SQL.format(t.FLOWS_SQL + ", low as (select * from flows where score < 0.6)", "low")
    + f", mixed as (select f.event_id, f.score, greatest(case when f.score >= 0.25 and count(*) filter (where f.score >= 0.25) over (partition by f.source order by f.ts_us {_RANGE(1)}) >= 5 then 0.4::double else 0 end, ip_window * 0.5) as extra from ipw f), out as (select event_id, case when extra > 0 then least(1, score + extra) else score end as confidence from mixed union all select event_id, score from flows where score >= 0.6) select event_id, round(confidence, 6) as confidence, case when confidence < 0.2 then 'Ignore' when confidence < 0.4 then 'Log' when confidence < 0.6 then 'Alert' when confidence < 0.85 then 'Block' when confidence >= 0.95 then 'Escalate' else 'Block' end as decision from out",
    "repeat_alerts": f"{_A} select event_id, count(*) over (partition by source order by ts_us {_RANGE(1)}) as repeat_count, count(*) over (partition by source order by ts_us {_RANGE(1)}) >= 3 as repeat from alerts",
    "slow_attack": f"{_A} select event_id, count(*) filter (where score >= 0.3) over (partition by source order by ts_us {_RANGE(30)}) as slow_count, count(*) filter (where score >= 0.3) over (partition by source order by ts_us {_RANGE(30)}) >= 10 as slow_attack from alerts",
    "distributed_attack": f"{_A} select event_id, n as source_count, n >= 5 as distributed from (select event_id, count(distinct source) over (partition by destination order by ts_us {_RANGE(1)}) as n from alerts)",
    "multi_stage": f"{CORR_SQL} select event_id, multi_stage from staged",
    "stage_completions": f"{CORR_SQL} select source, pattern, d[1] as done_us, d[2] as done_event from done",
    "correlate": f"{CORR_SQL} select event_id, repeat, multi_stage, distributed, slow_attack, round(corr_score, 6) as corr_score, correlation_type, upgraded_decision from upgraded",
    "retain_last_n": f"{_A} select event_id, source from alerts qualify row_number() over (partition by source order by ts_us desc, event_id desc) <= 20",
    "alert_ring": f"{_A} select event_id, ts_us, source, decision from alerts order by ts_us desc, event_id desc limit 500",
    "alert_seq": f"{_A} select event_id, row_number() over (order by ts_us, event_id) as alert_seq from alerts",
    "sample_one_in_n": f"{_F} select event_id, source from flows qualify (row_number() over (order by ts_us, event_id) - 1) % 10 = 0",
    "repeat_escalate": f"{_RUNS} select event_id, alerts_in_run, alerts_in_run >= 10 and ts_us - first_us <= {5 * DAY} as repeat_escalate from numbered",
    "source_sessions": f"{_F} select event_id, cast(sum(fresh) over ({_BY}) as bigint) as session_no from (select *, case when ts_us - lag(ts_us) over ({_BY}) <= {DAY // 2} then 0 else 1 end as fresh from flows)",
    "state_expiry": f"{_F} select source, count(*) as events, case when 1706659200000000 - max(ts_us) > 43200000000 then 'Expired' when 1706659200000000 - max(ts_us) > 3600000000 then 'Idle' else 'Active' end as phase from flows group by source",
}
