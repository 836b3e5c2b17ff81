"""Dashboards, calibration, evaluation, telemetry and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import dashboards as d
from ..operators import evaluation as ev_ops
from ..operators import joins, telemetry
from ..params import sparse_profile
from ..sources import tables as t

P = sparse_profile()
DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
FROM, TO, NOW = START + 15 * DAY, START + 29 * DAY, START + 29 * DAY + DAY // 2


def r6(c):
    return F.round(c, 6)


def _metrics(spark, sf):
    return t.metrics(spark, sf).withColumns({
        "events_per_sec": F.col("events") / 86400.0, "avg_latency_us": F.col("bytes") / F.col("events") / 1000.0})


def overview_stats(spark, sf):
    out = d.overview(
        t.alerts(spark, sf), t.traffic(spark, sf), t.devices(spark, sf), _metrics(spark, sf), FROM, TO, NOW)
    return out.withColumn("avg_latency_us", r6("avg_latency_us"))


def alert_categories(spark, sf):
    return d.categories(t.alerts(spark, sf))


def alert_timeline(spark, sf):
    return d.timeline(t.alerts(spark, sf), "hour")


def log_stats(spark, sf):
    return d.log_stats(t.logs(spark, sf))


def _rule_hits(spark, sf):
    rules = t.rules(spark, sf)
    met = joins.met_rules(t.flows(spark, sf).select("event_id", "ts_us", "source", "score"), rules, marks=True)
    return d.rule_hits(joins.rule_matches(met, rules), rules)


def rule_match(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "source", "score")
    made = {"n": F.size, "rules": lambda names: F.array_join(names, ",")}
    return joins.match_rules(ev, t.rules(spark, sf), made=made).select("event_id", "n", "rules")


def rule_hits(spark, sf):
    return _rule_hits(spark, sf).select("id", "name", "triggers", "last_hit_us")


def rule_stats(spark, sf):
    return d.rule_stats(_rule_hits(spark, sf), NOW)


def device_status(spark, sf):
    return d.device_status(t.devices(spark, sf), NOW, 43200).select("device", "tenant", "status")


def device_limit(spark, sf):
    return d.device_limit(t.devices(spark, sf), t.subscriptions(spark, sf))


def usage_meter(spark, sf):
    return d.usage(t.flows(spark, sf), t.alerts(spark, sf))


def usage_limit(spark, sf):
    subs = t.subscriptions(spark, sf).withColumn("events_per_month", F.expr("events_per_month div 1000"))
    return d.over_limit(d.usage(t.flows(spark, sf), t.alerts(spark, sf)), subs, "2024-01")


def retention_delete(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "tenant")
    return d.expired(ev, t.subscriptions(spark, sf), NOW, keep=False).select("event_id", "tenant")


def previous_period(spark, sf):
    return d.trend(t.alerts(spark, sf), FROM, TO, ("tenant",))


def metric_asof(spark, sf):
    return d.latest_metric(_metrics(spark, sf), ("tenant", "device")).select(
        "tenant", "device", "ts_us", "events", r6("events_per_sec").alias("events_per_sec"))


def time_window_args(spark, sf):
    now, before = d.periods(*d.default_period(NOW, minutes=7 * 24 * 60))
    al = t.alerts(spark, sf)
    return al.groupBy("tenant").agg(F.count_if(d.within(now)).alias("current"), F.count_if(d.within(before)).alias("previous"))


def top_talkers(spark, sf):
    return d.top_talkers(t.alerts(spark, sf), 10)


def alert_page(spark, sf):
    return d.page(t.alerts(spark, sf), 3, 50).select("event_id", "ts_us", "source", "severity", "total")


def recent_reports(spark, sf):
    per_day = telemetry.security_summary(t.alerts(spark, sf)).withColumnRenamed("day_us", "ts_us")
    return d.newest(per_day.select("ts_us", "alerts", "sources"), 10, ("ts_us",))


def last_n(spark, sf):
    seen = t.metrics(spark, sf).filter(F.col("alerts") > 3)
    return d.newest(seen, 25, ("ts_us", "device")).select("tenant", "device", "ts_us", "alerts")


def decision_counts(spark, sf):
    return d.decision_counts(t.alerts(spark, sf), ("tenant",))


def decision_counts_open(spark, sf):
    al = t.alerts(spark, sf).withColumn("suppressed", F.col("event_id") % 3 == 0)
    return d.decision_counts(al, ("tenant",), include_suppressed=False)


def shard_metrics(spark, sf):
    ev = t.flows(spark, sf).withColumn("decision", scores.decide(F.col("score")))
    return telemetry.by_shard(ev, 8).withColumn("skew", r6("skew"))


def latency_stats(spark, sf):
    ev = t.flows(spark, sf).select(F.col("type").alias("stage"), F.col("rate_hz").alias("us"))
    return telemetry.latency_stats(ev, "stage", "us").withColumns({c: r6(c) for c in ("avg_us", "peak_us", "p99_us")})


def latency_histogram(spark, sf):
    ev = t.flows(spark, sf).select(F.col("type").alias("stage"), F.col("rate_hz").alias("us"))
    return telemetry.latency_histogram(ev, "stage", "us").select("stage", "bucket", "n")


def rates(spark, sf):
    out = telemetry.rates(t.metrics(spark, sf), ["device"], ["events", "alerts", "blocks"], P.slice_s, ("ts_us", "day"))
    return out.select("device", "day", *[F.round(F.col(f"{n}_per_sec"), 9).alias(f"{n}_per_sec") for n in ("events", "alerts", "blocks")])


def flow_stats(spark, sf):
    pk = t.flows(spark, sf).select(
        "event_id", "ts_us", "source", "destination", "protocol", "flags", F.col("bytes_in").alias("size"))
    out = telemetry.flow_stats(pk, P.slice_s, ["source", "protocol"])
    return out.select("source", "protocol", *[
        r6(c).alias(c) if c not in ("packets_total", "bytes_total", "packet_size_max", "packet_size_min", "syn_count", "fin_count", "rst_count", "ack_count") else F.col(c)
        for c in out.columns[2:]])


def _scored(spark, sf):
    return t.labelled(spark, sf).select("event_id", "ts_us", "source", "tenant", "label", "score")


def dataset_stats(spark, sf):
    out = ev_ops.dataset_stats(_scored(spark, sf), ("tenant",))
    return out.withColumns({n: r6(n) for n in ("score_sum", "score_sum_sq", "max_score")})


def class_counts(spark, sf):
    return ev_ops.class_counts(_scored(spark, sf))


def benign_percentiles(spark, sf):
    return ev_ops.benign_percentiles(_scored(spark, sf), {"p95": 0.95, "p99": 0.99, "median": 0.5})


def suggest_thresholds(spark, sf):
    out = ev_ops.suggest_thresholds(_scored(spark, sf), 0.2)
    return out.select(*[r6(c).alias(c) for c in out.columns])


def calibrate_baseline(spark, sf):
    out = ev_ops.calibrate_thresholds(_scored(spark, sf), 0.3)
    return out.select(*[r6(c).alias(c) for c in out.columns])


def class_thresholds(spark, sf):
    return ev_ops.class_thresholds(_scored(spark, sf)).withColumn("threshold", r6("threshold"))


RATES = ("accuracy", "precision", "recall", "f1")


def confusion(spark, sf):
    out = ev_ops.confusion(_scored(spark, sf), ("tenant",), with_total=True)
    return out.withColumns({n: r6(n) for n in RATES}).withColumn("tenant", F.coalesce("tenant", F.lit("all")))


def confusion_smoothed(spark, sf):
    out = ev_ops.confusion(_scored(spark, sf), ("tenant",), smooth=1)
    return out.withColumns({n: r6(n) for n in RATES})


def train_eval(spark, sf):
    s = _scored(spark, sf)
    out = ev_ops.train_eval(s.filter(scores.is_benign(F.col("label"))), s.filter(~scores.is_benign(F.col("label"))), ("label",), 0.2)
    return out.withColumns({n: r6(n) for n in RATES})


def error_stats(spark, sf):
    from ..functions import vectors

    e = t.table(spark, sf, "embeddings").select("label", vectors.dot(F.col("embedding"), F.col("embedding")).alias("err"))
    out = ev_ops.error_stats(e, "err", ("label",))
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


def report_security_summary(spark, sf):
    return telemetry.security_summary(t.alerts(spark, sf))


def report_alert_analysis(spark, sf):
    return telemetry.alert_analysis(t.alerts(spark, sf)).withColumn("mean_score", r6("mean_score"))


def report_network_traffic(spark, sf):
    return telemetry.network_traffic(t.traffic(spark, sf)).withColumn("bytes_pct", r6("bytes_pct"))


def report_threat_intel(spark, sf):
    return telemetry.threat_intel(t.alerts(spark, sf))


# ---- lookups ---------------------------------------------------------------------------------

def device_enrich(spark, sf):
    known = t.devices(spark, sf).filter(F.col("device") != "dev_7")
    return joins.enrich_device(t.alerts(spark, sf).select("event_id", "device"), known)


def _batch(spark, sf):
    k = F.col("k")
    key = F.when(k % 5 == 0, F.lit("stolen")).otherwise(F.concat(F.lit("key-"), "device"))
    return t.flows(spark, sf).select(
        "event_id", F.when(k % 7 == 0, F.lit("dev_999")).otherwise(F.col("device")).alias("device"), key.alias("api_key"))


def device_auth_filter(spark, sf):
    return joins.authenticate(_batch(spark, sf), t.devices(spark, sf)).select("event_id", "device")


def device_auth_rejects(spark, sf):
    return joins.authenticate(_batch(spark, sf), t.devices(spark, sf), accepted=False).select("event_id", "device")


def tenant_scope(spark, sf):
    paying = t.subscriptions(spark, sf).filter(F.col("plan") != "free")
    return joins.of_tenants(t.alerts(spark, sf).select("event_id", "tenant"), paying)


def baseline_lookup(spark, sf):
    from .state import _baselines

    ev = t.flows(spark, sf).select("event_id", F.when(F.col("k") % 4 == 0, "10.9.9.9").otherwise(F.col("source")).alias("source"))
    return joins.with_baseline(ev, _baselines(spark, sf), "ip", "source").select(
        "event_id", "events", r6("score_mean").alias("score_mean"))


WEIGHTS = (("DoS", (0.5, 0.2, 0.1, 0.1, 0.05, 0.05)), ("Port", (0.2, 0.4, 0.2, 0.1, 0.05, 0.05)))


def class_weights(spark, sf):
    from ..params import FusionWeights

    w = joins.class_weights(F.col("label"), [(n, FusionWeights(*v)) for n, v in WEIGHTS])
    return t.labelled(spark, sf).select("event_id", w.alias("w")).select("event_id", "w.local", "w.segment", "w.history")


def attribute_alerts(spark, sf):
    al = t.alerts(spark, sf).select("event_id", "severity", "decision")
    return joins.attribute(t.flows(spark, sf).select("event_id", "source"), al)


def replay_compare(spark, sf):
    al = t.alerts(spark, sf).select("event_id", "decision")
    again = t.signals(spark, sf).select("event_id", "k", scores.decide(F.col("score") * F.when(F.col("k") % 6 == 0, 1.3).otherwise(1.0)).alias("decision"))
    again = again.filter((F.col("decision") != "Ignore") & (F.col("k") != 50)).drop("k")
    return joins.compare_alerts(again, al, ["event_id"], ["decision"])


def union_scores(spark, sf):
    a = t.flows(spark, sf).select(F.col("event_id").alias("id"), F.lit("flow").alias("origin"), "score")
    b = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit("vector").alias("origin"),
        F.least(F.lit(1.0), F.abs(F.get("embedding", F.lit(0)).cast("double")) * 4).alias("score"))
    both = a.unionByName(b)
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("total"), r6(F.max("score")).alias("top"))


QUERIES = {
    "overview_stats": overview_stats, "alert_categories": alert_categories, "alert_timeline": alert_timeline,
    "log_stats": log_stats, "rule_match": rule_match, "rule_hits": rule_hits, "rule_stats": rule_stats,
    "device_status": device_status, "device_limit": device_limit, "usage_meter": usage_meter,
    "usage_limit": usage_limit, "retention_delete": retention_delete, "previous_period": previous_period,
    "metric_asof": metric_asof, "time_window_args": time_window_args, "top_talkers": top_talkers,
    "alert_page": alert_page, "recent_reports": recent_reports, "last_n": last_n,
    "decision_counts": decision_counts, "decision_counts_open": decision_counts_open, "shard_metrics": shard_metrics, "latency_stats": latency_stats,
    "latency_histogram": latency_histogram, "rates": rates, "flow_stats": flow_stats,
    "dataset_stats": dataset_stats, "class_counts": class_counts, "benign_percentiles": benign_percentiles,
    "suggest_thresholds": suggest_thresholds, "calibrate_baseline": calibrate_baseline,
    "class_thresholds": class_thresholds, "confusion": confusion, "confusion_smoothed": confusion_smoothed,
    "train_eval": train_eval, "error_stats": error_stats, "report_security_summary": report_security_summary,
    "report_alert_analysis": report_alert_analysis, "report_network_traffic": report_network_traffic,
    "report_threat_intel": report_threat_intel, "device_enrich": device_enrich,
    "device_auth_filter": device_auth_filter, "device_auth_rejects": device_auth_rejects,
    "tenant_scope": tenant_scope, "baseline_lookup": baseline_lookup, "class_weights": class_weights,
    "attribute_alerts": attribute_alerts, "replay_compare": replay_compare, "union_scores": union_scores,
}

_F, _A = f"with {t.FLOWS_SQL} ", f"with {t.ALERTS_SQL} "
_NOWP, _PREV = f"ts_us >= {FROM} and ts_us < {TO}", f"ts_us >= {2 * FROM - TO} and ts_us < {FROM}"
_SEC = (TO - FROM) / 1e6
_HITS = f"""with {t.FLOWS_SQL}, {t.RULES_SQL}, hits as (
  select r.id, event_id, ts_us, r.name, score >= threshold as s, pattern <> '' and contains(source, pattern) as p
  from flows, rules r where enabled and (score >= threshold or (pattern <> '' and contains(source, pattern)))),
counted as (select r.*, coalesce(n, 0) as triggers, last_hit_us from rules r left join
  (select id, count(*) as n, max(ts_us) as last_hit_us from hits group by id) h using (id))"""
_LAB = f"with {t.LABELLED_SQL}, "
_BEN = "ben as (select score, row_number() over (order by score) - 1 as r, count(*) over () as n from labelled where label = 'BENIGN')"
_AT = lambda share: f"(select min(score) from ben where r = least(cast(floor(n * {share}::double) as bigint), n - 1))"
_CLAMP = lambda e, lo, hi: f"round(least({hi}, greatest({lo}, {e})), 6)"
_CONF = """judged as (select *, label <> 'BENIGN' as bad, score >= 0.1 as hit,
  score >= 0.25 and not (score >= 0.9) as blk, score >= 0.9 as esc from labelled)"""
_CONF_N = """count(*) filter (where bad and hit) as tp, count(*) filter (where not bad and not hit) as tn,
  count(*) filter (where not bad and hit) as fp, count(*) filter (where bad and not hit) as fn,
  count(*) filter (where hit) as alerts, count(*) filter (where blk) as blocks, count(*) filter (where esc) as escalations"""
_RATE_SQL = lambda s: f"""round(100.0::double * (tp + tn) / (tp + tn + fp + fn), 6) as accuracy,
  round(case when tp + fp + {s} > 0 then 100.0::double * tp / (tp + fp + {s}) else 0 end, 6) as precision,
  round(case when tp + fn + {s} > 0 then 100.0::double * tp / (tp + fn + {s}) else 0 end, 6) as recall,
  round(case when tp > 0 then 2 * (100.0::double * tp / (tp + fp + {s})) * (100.0::double * tp / (tp + fn + {s})) / ((100.0::double * tp / (tp + fp + {s})) + (100.0::double * tp / (tp + fn + {s}))) else 0 end, 6) as f1"""  # noqa: E731
from .state import BASE_SQL  # noqa: E402

ORACLE = {
    "overview_stats": f"""with {t.ALERTS_SQL}{t.DEVICES_SQL}{t.METRICS_SQL},
c as (select tenant, count(*) filter (where {_NOWP}) as total_alerts,
  count(*) filter (where {_NOWP} and severity = 'high') as high_severity,
  count(*) filter (where {_NOWP} and severity = 'medium') as medium_severity,
  count(*) filter (where {_NOWP} and severity = 'low') as low_severity,
  count(*) filter (where {_NOWP} and decision = 'Block') as blocked_events,
  count(*) filter (where {_PREV}) as b, count(*) filter (where {_PREV} and severity = 'high') as bh from alerts group by tenant),
v as (select tenant, count(*) as total_events, sum(bytes_in) as bytes from flows where {_NOWP} group by tenant),
f as (select tenant, count(*) as active_devices, count(*) filter (where ({NOW} - last_seen_us) / 1e6 < 120) as devices_online from devices group by tenant),
m as (select tenant, arg_max(bytes / events / 1000.0::double, row(ts_us, device)) as avg_latency_us from metrics group by tenant),
j as (select *, round(bytes * 8 / {_SEC}::double / 1e9, 4) as g from c join v using (tenant) join f using (tenant) join m using (tenant))
select tenant, total_alerts, high_severity, medium_severity, low_severity, blocked_events, active_devices, devices_online,
  case when b > 0 then round((total_alerts - b) / b * 100, 1) else 0 end as alerts_trend,
  case when bh > 0 then round((high_severity - bh) / bh * 100, 1) else 0 end as high_trend, total_events,
  round(total_events / {_SEC}::double, 2) as events_per_sec, g as traffic_gbps, round(g * 0.6, 4) as traffic_in_gbps,
  round(g * 0.4, 4) as traffic_out_gbps, round(avg_latency_us, 6) as avg_latency_us,
  round(total_alerts / greatest(total_events, total_alerts) * 100, 1) as alert_rate,
  round(100 - round(total_alerts / greatest(total_events, total_alerts) * 100, 1), 1) as benign_pct from j""",
    "alert_categories": f"{_A} select attack_class as name, count(*) as count, round(count(*) / sum(count(*)) over () * 100, 1) as percentage from alerts group by attack_class order by count desc, name",
    "alert_timeline": f"{_A} select ts_us - ts_us % 3600000000 as bucket_us, count(*) as value from alerts group by all",
    "log_stats": f"with {t.LOGS_SQL} select count(*) as total, count(*) filter (where type = 'Firewall') as firewall, count(*) filter (where type = 'DNS') as dns, count(*) filter (where type = 'HTTP') as http, count(*) filter (where type = 'System') as system from logs",
    "rule_match": f"{_HITS}, n as (select event_id, id, unnest(case when s and p then [name, name || ':ip'] when s then [name] else [name || ':ip'] end) as nm from hits) select f.event_id, cast(count(nm) as integer) as n, coalesce(string_agg(nm, ',' order by id, length(nm)), '') as rules from flows f left join n using (event_id) group by f.event_id",
    "rule_hits": f"{_HITS} select id, name, triggers, last_hit_us from counted",
    "rule_stats": f"{_HITS} select count(*) as total, count(*) filter (where enabled) as active, count(*) filter (where not enabled) as disabled, count(*) filter (where last_hit_us >= {NOW - NOW % DAY}) as triggered_today from counted",
    "device_status": f"with {t.FLOWS_SQL}{t.DEVICES_SQL} select device, tenant, case when ({NOW} - last_seen_us) / 1e6 < 43200 then 'online' else 'offline' end as status from devices",
    "device_limit": f"with {t.FLOWS_SQL}{t.DEVICES_SQL}{t.SUBSCRIPTIONS_SQL} select *, devices >= sensors as over_limit from (select s.tenant, s.sensors, count(d.device) as devices from subscriptions s left join devices d using (tenant) group by s.tenant, s.sensors)",
    "usage_meter": f"{_A}, e as (select tenant, strftime(ts, '%Y-%m') as month, count(*) as events_ingested from flows group by all), a as (select tenant, strftime(ts, '%Y-%m') as month, count(*) as alerts_stored from alerts group by all) select tenant, month, coalesce(events_ingested, 0) as events_ingested, coalesce(alerts_stored, 0) as alerts_stored from e full join a using (tenant, month)",
    "usage_limit": f"{_A}{t.SUBSCRIPTIONS_SQL}, e as (select tenant, strftime(ts, '%Y-%m') as month, count(*) as events_ingested from flows group by all), a as (select tenant, strftime(ts, '%Y-%m') as month, count(*) as alerts_stored from alerts group by all) select tenant, month, events_ingested, coalesce(alerts_stored, 0) as alerts_stored, events_per_month // 1000 as events_per_month from e left join a using (tenant, month) join subscriptions using (tenant) where month = '2024-01' and events_ingested >= events_per_month // 1000",
    "retention_delete": f"{_F}{t.SUBSCRIPTIONS_SQL} select event_id, tenant from flows join subscriptions using (tenant) where ts_us < {NOW} - retention_days * {DAY}",
    "previous_period": f"{_A}, g as (select tenant, count(*) filter (where {_NOWP}) as alerts, count(*) filter (where {_PREV}) as previous, count(*) filter (where {_NOWP} and severity = 'high') as high, count(*) filter (where {_PREV} and severity = 'high') as previous_high from alerts group by tenant) select *, case when previous > 0 then round((alerts - previous) / previous * 100, 1) else 0 end as alerts_trend, case when previous_high > 0 then round((high - previous_high) / previous_high * 100, 1) else 0 end as high_trend from g",
    "metric_asof": f"{_F}{t.METRICS_SQL} select tenant, device, ts_us, events, round(events / 86400.0::double, 6) as events_per_sec from metrics qualify row_number() over (partition by tenant, device order by ts_us desc) = 1",
    "time_window_args": f"{_A} select tenant, count(*) filter (where ts_us >= {NOW - 7 * DAY} and ts_us < {NOW}) as current, count(*) filter (where ts_us >= {NOW - 14 * DAY} and ts_us < {NOW - 7 * DAY}) as previous from alerts group by tenant",
    "top_talkers": f"{_A} select source as ip, count(*) as alert_count, max(ts_us) as last_seen_us, cast(least(100, count(*) * 5) as bigint) as threat_score from alerts group by source order by alert_count desc, ip limit 10",
    "alert_page": f"{_A} select event_id, ts_us, source, severity, (select count(*) from alerts) as total from alerts order by ts_us desc, event_id desc limit 50 offset 100",
    "recent_reports": f"{_A} select ts_us - ts_us % {DAY} as ts_us, count(*) as alerts, count(distinct source) as sources from alerts group by 1 order by 1 desc limit 10",
    "last_n": f"{_F}{t.METRICS_SQL} select tenant, device, ts_us, alerts from metrics where alerts > 3 order by ts_us desc, device desc limit 25",
    "decision_counts": f"{_A} select tenant, count(*) filter (where decision = 'Alert') as alerts, count(*) filter (where decision = 'Block') as blocks, count(*) filter (where decision = 'Escalate') as escalations from alerts group by tenant",
    "decision_counts_open": f"{_A} select tenant, count(*) filter (where decision = 'Alert') as alerts, count(*) filter (where decision = 'Block') as blocks, count(*) filter (where decision = 'Escalate') as escalations from alerts where event_id % 3 <> 0 group by tenant",
    "shard_metrics": f"{_F}, e as (select cast(('0x' || substr(md5(source), 1, 8))::bigint % 8 as integer) as shard, score >= 0.4 and score < 0.6 as al, score >= 0.6 and score < 0.95 as bl, score >= 0.95 as es from flows), g as (select shard, count(*) as events, count(*) filter (where al) as alerts, count(*) filter (where bl) as blocks, count(*) filter (where es) as escalations from e group by shard), m as (select avg(events) as mean, max(events) as mx from g) select shard, events, alerts, blocks, escalations, round(events / mean, 6) as skew from g, m union all select -1, cast(sum(events) as bigint), cast(sum(alerts) as bigint), cast(sum(blocks) as bigint), cast(sum(escalations) as bigint), round(any_value(mx / mean), 6) from g, m",
    "latency_stats": f"{_F}, h as (select type as stage, rate_hz as us, row_number() over (partition by type order by rate_hz) as r, count(*) over (partition by type) as n from flows) select stage, count(*) as samples, round(avg(us), 6) as avg_us, round(max(us), 6) as peak_us, round(max(case when r = ceil(n * 0.99::double) then us end), 6) as p99_us from h group by stage",
    "latency_histogram": f"{_F} select type as stage, cast(least(floor(rate_hz / 100), 255) as integer) as bucket, count(*) as n from flows group by all",
    "rates": f"{_F}{t.METRICS_SQL}, l as (select *, (ts_us - lag(ts_us) over w) / 1000000.0::double as dt, lag(events) over w as pe, lag(alerts) over w as pa, lag(blocks) over w as pb from metrics window w as (partition by device order by ts_us, day)) select device, day, " + ", ".join(f"round((case when {n} >= {p} then {n} - {p} else {n} end) / coalesce(dt, 1), 9) as {n}_per_sec" for n, p in (("events", "pe"), ("alerts", "pa"), ("blocks", "pb"))) + " from l",
    "flow_stats": f"{_F}, g as (select *, (ts_us - lag(ts_us) over (partition by source, protocol order by ts_us, event_id)) / 1000000.0::double as gap from flows) select source, protocol, count(*) as packets_total, cast(sum(bytes_in) as bigint) as bytes_total, round(avg(bytes_in), 6) as packet_size_mean, round(stddev_pop(bytes_in), 6) as packet_size_std, max(bytes_in) as packet_size_max, min(bytes_in) as packet_size_min, round(coalesce(avg(gap), 0), 6) as iat_mean, round(coalesce(stddev_pop(gap), 0), 6) as iat_std, round(coalesce(max(gap), 0), 6) as iat_max, round(coalesce(min(gap), 0), 6) as iat_min, count(*) filter (where (flags & 2) <> 0) as syn_count, count(*) filter (where (flags & 1) <> 0) as fin_count, count(*) filter (where (flags & 4) <> 0) as rst_count, count(*) filter (where (flags & 16) <> 0) as ack_count, round((max(ts_us) - min(ts_us)) / 1000000.0::double, 6) as duration from g group by source, protocol",
    "dataset_stats": f"with {t.LABELLED_SQL} select tenant, count(*) as total, count(*) filter (where label = 'BENIGN') as benign, count(*) filter (where label <> 'BENIGN') as attack, round(sum(score), 6) as score_sum, round(sum(score * score), 6) as score_sum_sq, round(max(score), 6) as max_score from labelled group by tenant",
    "class_counts": f"with {t.LABELLED_SQL} select label as attack_class, count(*) as events from labelled where label <> 'BENIGN' group by label",
    "benign_percentiles": f"{_LAB}{_BEN} select {_AT(0.95)} as p95, {_AT(0.99)} as p99, {_AT(0.5)} as median",
    "suggest_thresholds": f"{_LAB}{_BEN}, b as (select {_AT('(1 - 0.2::double)')} as base) select round(base, 6) as base, {_CLAMP('base * 1.2', 0.15, 0.5)} as gate_threshold, {_CLAMP('base * 1.5', 0.3, 0.7)} as alert_threshold, {_CLAMP('base * 2', 0.5, 0.92)} as block_threshold from b",
    "calibrate_baseline": f"{_LAB}{_BEN}, b as (select {_AT('(1 - 0.3::double)')} as base) select round(base, 6) as base, {_CLAMP('base * 0.7', 0.2, 0.6)} as gate_threshold, {_CLAMP('base', 0.3, 0.8)} as alert_threshold, {_CLAMP('base * 1.3', 0.5, 0.95)} as block_threshold, {_CLAMP('base * 0.9', 0.3, 0.85)} as flush_threshold from b",
    "class_thresholds": f"{_LAB} s as (select label, score, row_number() over (partition by label order by score) - 1 as r, count(*) over (partition by label) as n from labelled where label <> 'BENIGN'), c as (select distinct label, r, n, score as thr from s where r >= 1 and r + 1 < n and (r - 1) % greatest(1, n // 20) = 0), k as (select c.*, (select count(*) from s where s.label = c.label and s.score >= thr) as tp, (select count(*) from labelled where label = 'BENIGN' and score >= thr) as fp from c), f as (select *, 100.0::double * tp / (tp + fp) as p, 100.0::double * tp / n as q from k) select label as attack_class, any_value(n) as samples, round(arg_max(thr, row(2 * p * q / (p + q), -r)), 6) as threshold from f group by label",
    "confusion": f"{_LAB}{_CONF}, c as (select coalesce(tenant, 'all') as tenant, {_CONF_N} from judged group by rollup(tenant)) select *, {_RATE_SQL(0)} from c",
    "confusion_smoothed": f"{_LAB}{_CONF}, c as (select tenant, {_CONF_N} from judged group by tenant) select *, {_RATE_SQL(1)} from c",
    "train_eval": f"{_LAB}{_BEN}, b as (select {_AT('(1 - 0.2::double)')} as base), h as (select least(0.7, greatest(0.3, base * 1.5)) as a, least(0.92, greatest(0.5, base * 2)) as kk from b), c as (select label, count(*) filter (where score >= a) as tp, 0::bigint as tn, 0::bigint as fp, count(*) filter (where score < a) as fn, count(*) filter (where score >= kk) as blocks from labelled, h where label <> 'BENIGN' group by label) select *, {_RATE_SQL(1)} from c",
    "error_stats": "with e as (select label, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as err from embeddings) select label, count(*) as n, round(avg(err), 6) as mean, round(stddev_pop(err), 6) as std from e group by label",
    "report_security_summary": f"{_A} select ts_us - ts_us % {DAY} as day_us, count(*) as alerts, count(*) filter (where decision = 'Block') as blocks, count(*) filter (where decision = 'Escalate') as escalations, max(score) as max_score, count(distinct source) as sources from alerts group by 1",
    "report_alert_analysis": f"{_A} select case when grouping(attack_class) = 1 then 'all' else attack_class end as attack_class, case when grouping(severity) = 1 then 'all' else severity end as severity, count(*) as alerts, round(avg(score), 6) as mean_score from alerts group by cube(attack_class, severity)",
    "report_network_traffic": f"{_F}, p as (select 'protocol' as part, cast(protocol as varchar) as name, count(*) as events, cast(sum(bytes_in) as bigint) as bytes from flows group by protocol), w as (select 'talker' as part, source as name, count(*) as events, cast(sum(bytes_in) as bigint) as bytes from flows group by source order by 4 desc, 2 limit 20) select *, round(bytes / (select sum(bytes_in) from flows) * 100, 6) as bytes_pct from (select * from p union all select * from w)",
    "report_threat_intel": f"{_A} select source, count(*) as alerts, count(distinct attack_class) as classes, count(distinct destination) as targets, max(score) as max_score, min(ts_us) as first_us, max(ts_us) as last_us from alerts group by source order by alerts desc, source limit 20",
    "device_enrich": f"{_A} select event_id, device, case when device = 'dev_7' then 'unknown' else concat('sensor ', device) end as device_name from alerts",
    "device_auth_filter": f"{_F} select event_id, device from flows where k % 7 <> 0 and k % 5 <> 0",
    "device_auth_rejects": f"{_F} select event_id, case when k % 7 = 0 then 'dev_999' else device end as device from flows where k % 7 = 0 or k % 5 = 0",
    "tenant_scope": f"{_A} select event_id, tenant from alerts where tenant in ('tenant_3', 'tenant_4')",
    "baseline_lookup": f"{BASE_SQL} select f.event_id, case when k % 4 = 0 then g.events else coalesce(b.events, g.events) end as events, round(case when k % 4 = 0 then g.score_mean else coalesce(b.score_mean, g.score_mean) end, 6) as score_mean from flows f left join base b on b.scope = 'ip' and b.scope_key = f.source cross join (select * from base where scope = 'global') g",
    "class_weights": f"with {t.LABELLED_SQL} select event_id, case when contains(label, 'DoS') then 0.5::double when contains(label, 'Port') then 0.2::double else 0.35::double end as local, case when contains(label, 'DoS') then 0.2::double when contains(label, 'Port') then 0.4::double else 0.25::double end as segment, case when contains(label, 'DoS') then 0.1::double else 0.2::double end as history from labelled",
    "attribute_alerts": f"{_A} select f.event_id, f.source, a.severity as alert_severity, a.decision as alert_decision from flows f left join alerts a using (event_id)",
    "replay_compare": f"{_A}, x as (select event_id, score * case when k % 6 = 0 then 1.3::double else 1 end as s, k from flows), y as (select event_id, case when s < 0.2 then 'Ignore' when s < 0.4 then 'Log' when s < 0.6 then 'Alert' when s < 0.85 then 'Block' when s >= 0.95 then 'Escalate' else 'Block' end as d, k from x), z as (select event_id, d from y where d <> 'Ignore' and k <> 50), j as (select z.d, a.decision as e from z full join alerts a using (event_id)) select count(*) filter (where d = e) as matches, count(*) filter (where d <> e) as different, count(*) filter (where e is null) as only_replay, count(*) filter (where d is null) as only_reference, count(*) filter (where d is distinct from e) as mismatches from j",
    "union_scores": f"{_F}, u as (select 'flow' as origin, score from flows union all select 'vector', least(1, abs(embedding[1]::double) * 4) from embeddings) select origin, count(*) as n, round(sum(score), 6) as total, round(max(score), 6) as top from u group by origin",
}
