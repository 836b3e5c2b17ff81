"""Stateful operators: recurrences, state machines, baselines and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import scoring, windows
from ..operators.folds import plan_keys
from ..operators.steps import FEATURES
from ..params import sparse_profile
from ..sources import tables as t

P = sparse_profile()
SLICE = P.slice_s
DAY = 86_400_000_000


def r6(c):
    return F.round(c, 6)


FEATURE_COLUMNS = ("event_id", "ts_us", "source", "bytes_in", "bytes_out", *FEATURES[1:])


SHOWN = {"iat_mean": 1e6, "bytes": 1.0 / 65535}  # shown in microseconds and largest packets


def rolling_stats(spark, sf):
    out = scoring.rolling_stats(t.flows(spark, sf).select(*FEATURE_COLUMNS), ["source"])
    scale = lambda f: SHOWN.get(f, 1.0)
    return out.select("event_id", *[r6(F.col(f"m_{f}") * scale(f)).alias(f"mean_{f}") for f in FEATURES],
                      *[r6(F.sqrt(f"v_{f}") * scale(f)).alias(f"std_{f}") for f in FEATURES])


SHAPE_COLUMNS = ("ack_count", "fin_count", "iat_std", "down_up_ratio", "bytes_fwd", "bytes_bwd", "entropy", "burst")


def zscore_anomaly(spark, sf):
    ev = t.signals(spark, sf).select(*FEATURE_COLUMNS, *SHAPE_COLUMNS)
    scored = scoring.zscore_anomaly(scoring.rolling_stats(ev, ["source"]), F.col("entropy"), F.col("burst"))
    return scored.select("event_id", r6("anomaly").alias("anomaly"))


def _embedded(spark, sf, plan=None, drop=("ts", "k", "tenant", "device")):
    ev = t.flows(spark, sf).drop(*drop)
    plan = plan or plan_keys(ev, ["source"])
    shaped = windows.local_shape(ev, ["source"], SLICE)
    return scoring.local_embedding(scoring.rolling_stats(shaped, ["source"], plan, follows=plan.whole))


#: Scales under which six digits show dimensions of very large or very small values well.
EMB_SHOWN = {28: 1.0 / 65535, 34: 1.0 / 65535, 32: 314.159265358979}


def local_embedding(spark, sf):
    e = F.col("embedding")
    return _embedded(spark, sf).select(
        "event_id", *[r6(F.get(e, F.lit(i)) * EMB_SHOWN.get(i, 1.0)).alias(f"d{i}") for i in range(64)], F.size(e).alias("width")
    )


def baseline_ewma(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "score", "rate_hz", "entropy")
    out = scoring.baseline_ewma(ev, ["source"], ["score", "rate_hz", "entropy"], 0.05, SLICE)
    return out.select("source", "events", *[r6(f"{v}_{m}").alias(f"{v}_{m}") for v in ("score", "rate_hz", "entropy") for m in ("mean", "var")])


def embedding_baseline(spark, sf):
    e = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("event_id"), (F.col("vec_id") * 1_000_000).alias("ts_us"), "label", "embedding")
    return scoring.embedding_baseline(e, ["label"], "embedding", 0.02, 100.0).select(
        "label", "dim", r6("mean").alias("mean"), r6("variance").alias("variance")
    )


def _baselines(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", F.col("source").alias("ip"), F.col("destination").alias("host"),
                                   "score", "rate_hz", "entropy")
    return scoring.scope_baselines(ev, {"ip": "ip", "host": "host"}, ["score", "rate_hz", "entropy"], SLICE)


def scope_baselines(spark, sf):
    return _baselines(spark, sf).select("scope", "scope_key", "events", r6("score_mean").alias("score_mean"),
                                        r6("entropy_var").alias("entropy_var"))


def adaptive_thresholds(spark, sf):
    b = _baselines(spark, sf)
    out = scoring.adaptive_thresholds(F.col("score_mean"), F.col("score_var"))
    return b.select("scope", "scope_key", *[r6(c).alias(n) for n, c in out.items()])


def adaptive_scaling(spark, sf):
    from ..operators import joins

    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "destination", "score", "rate_hz", "entropy")
    base = _baselines(spark, sf)
    out = joins.with_baseline(ev, base, "ip", "source")
    return out.select(
        "event_id", r6(scoring.scale_anomaly(F.col("score"), F.col("score_mean"), F.col("score_var"))).alias("scaled"),
        scoring.adaptive_decay(F.col("rate_hz"), F.col("rate_hz_mean"), 0.99, 0.95).alias("decay"),
        r6(scoring.adaptive_promote(F.col("score_mean"), 0.5, 0.5)).alias("promote"),
        r6(scoring.adaptive_gate(F.col("score_mean"))).alias("gate"),
    )


def baseline_running(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "score")
    return scoring.running_baseline(ev, ["source"], "score", 0.05, 0.7).select(
        "event_id", r6(F.col("mean") / 0.7).alias("mean_share"), r6("var").alias("var"))  # share of the freeze level


def threshold_shifts(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "score")
    plan = plan_keys(ev, ["source"])
    running = scoring.running_baseline(ev, ["source"], "score", 0.05, 0.7, plan)
    cols = scoring.adaptive_thresholds(F.col("mean"), F.col("var"))
    shaped = running.select("event_id", "ts_us", "source", cols["alert"].alias("alert"),
                            scoring.adaptive_gate(F.col("mean")).alias("gate"))
    return scoring.threshold_shifts(shaped, ["source"], ["alert", "gate"], [0.6, 0.35], plan).select(
        "event_id", "alert_shift", "gate_shift")


def _segmented(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source", "tenant", "type", "score", "rate_hz",
                                   (F.col("k") == 77).alias("session_end"))
    return scoring.segment_flush(ev, ["source"], P.flush)


def segment_flush(spark, sf):
    return _segmented(spark, sf).select("event_id", "segment_id", "flushed")


def _segments(spark, sf):
    return scoring.segment_summary(_segmented(spark, sf), ["source"], ["tenant"])


def segment_summary(spark, sf):
    return _segments(spark, sf).select(
        "source", "segment_id", "events", r6("trend").alias("trend"), r6("rate_mean").alias("rate_mean"),
        r6("error_freq").alias("error_freq"), "dominant_type", "ts_us")


def routing_flag(spark, sf):
    from ..operators import rows

    seg = _segments(spark, sf).withColumns({"segment_no": F.col("segment_id") + 1, "score": F.col("last_score")})
    return seg.select("source", "segment_id", rows.routing_flag().alias("route"))


def anomaly_history(spark, sf):
    return scoring.anomaly_history(_segments(spark, sf), ["tenant"], SLICE).select(
        "tenant", "segments", r6("history").alias("history"))


def ssm_scan(spark, sf):
    e = t.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        (F.col("vec_id") * 1_000_000).alias("ts_us"))
    y = scoring.ssm_scan(e, ["label"], "embedding", ["ts_us", "vec_id"])
    return y.select("vec_id", r6(F.get("y", F.lit(0))).alias("y0"), r6(F.get("y", F.lit(31))).alias("y31"),
                    r6(vectors.norm(F.col("y"), 0.0)).alias("energy"))


def hierarchy_drift(spark, sf):
    """Events -> vectors -> recurrence -> segments -> four-level hierarchy per tenant."""
    base = t.flows(spark, sf)
    by_source = plan_keys(base, ["source"])
    unused = ("ts", "k", "device", "iat_std", "ack_count", "fin_count", "bytes_fwd", "bytes_bwd")
    ev = _embedded(spark, sf, by_source, drop=unused).select(
        "event_id", "ts_us", "source", "tenant", "type", "score", "rate_hz", "embedding")
    scanned = scoring.ssm_scan(ev, ["source"], "embedding", ["ts_us", "event_id"], plan=by_source, follows=True)
    seg = scoring.segment_flush(
        scanned.drop("embedding").withColumnRenamed("y", "state"), ["source"], P.flush, by_source, follows=True)
    seg = scoring.segment_summary(seg, ["source"], ["tenant", "state"], plan=by_source, follows=True).select(
        "source", "segment_id", "ts_us", "event_id", "trend", "last_score", "tenant", "state")
    # planned on the events: there are no more segments, and those would have to be made twice or written down
    return scoring.hierarchy_drift(seg, ["tenant"], P.routing, plan=plan_keys(base, ["tenant"])).select(
        "source", "segment_id", "tenant", "route", r6("drift").alias("drift"), r6("history").alias("history"))


def _judged(spark, sf):
    return t.signals(spark, sf).select(
        "event_id", "ts_us", "source", F.col("score").alias("confidence"),
        F.expr("case when score < 0.2 then 'Ignore' when score < 0.4 then 'Log' when score < 0.6 then 'Alert'"
               " when score < 0.85 then 'Block' when score >= 0.95 then 'Escalate' else 'Block' end").alias("decision"),
        "history", "drift", (F.col("k") % 10 == 3).alias("false_positive"))


def decision_fsm(spark, sf):
    from dataclasses import replace

    p = replace(P.decision, allow=("10.0.0.7",), block=("10.0.0.12",))
    return scoring.decide_stream(_judged(spark, sf), p).select("event_id", F.coalesce("final", F.lit("")).alias("final"))


def cooldown_filter(spark, sf):
    al = t.alerts(spark, sf).select("event_id", "ts_us", "source")
    return scoring.cooldown(al, ["source"], P.decision.block_cooldown_s).select("event_id", "source")


def rate_limit(spark, sf):
    ev = t.flows(spark, sf).select("event_id", "ts_us", "source")
    return scoring.rate_limit(ev, ["source"], 5, 5 * 86400.0).select("event_id", "admitted")


QUERIES = {
    "rolling_stats": rolling_stats, "zscore_anomaly": zscore_anomaly, "local_embedding": local_embedding,
    "baseline_ewma": baseline_ewma, "embedding_baseline": embedding_baseline, "scope_baselines": scope_baselines,
    "adaptive_thresholds": adaptive_thresholds, "adaptive_scaling": adaptive_scaling,
    "baseline_running": baseline_running, "threshold_shifts": threshold_shifts,
    "segment_flush": segment_flush, "segment_summary": segment_summary, "routing_flag": routing_flag,
    "anomaly_history": anomaly_history, "ssm_scan": ssm_scan, "hierarchy_drift": hierarchy_drift,
    "decision_fsm": decision_fsm, "cooldown_filter": cooldown_filter, "rate_limit": rate_limit,
}

_N = len(FEATURES)
_X = "[(bytes_in + bytes_out)::double, rate_hz, packets_total::double, packet_size_mean, iat_mean, syn_count::double]"
ROLL = f"""with recursive {t.SIGNALS_SQL}, rn as (
  select *, {_X} as x, row_number() over (partition by source order by ts_us, event_id) as n from signals),
roll as (
  select source, 0::bigint as n, [0.0::double for i in range({_N})] as m, [0.0::double for i in range({_N})] as v,
    [0.0::double for i in range({_N})] as pm, [0.0::double for i in range({_N})] as pv
  from (select distinct source from rn)
  union all
  select source, n, m2, [pv[i] + ((x[i] - pm[i]) * (x[i] - m2[i]) - pv[i]) * w for i in range(1, {_N + 1})], pm, pv
  from (select source, n, x, w, m as pm, v as pv, [m[i] + (x[i] - m[i]) * w for i in range(1, {_N + 1})] as m2
    from (select r.source, r.n, r.x, 1.0::double / (least(r.n, 64) + 1) as w, s.m, s.v
      from roll s join rn r on r.source = s.source and r.n = s.n + 1))),
stats as (select r.*, s.m, s.v, s.pm, s.pv from rn r join roll s on r.source = s.source and r.n = s.n)"""
_IND = """case when syn_count > 5 and ack_count < syn_count // 2 then 0.4::double else 0 end
  + case when packets_total > 100 and packet_size_mean < 100 then 0.3::double else 0 end
  + case when iat_mean < 0.001 and packets_total > 50 then 0.3::double else 0 end
  + case when down_up_ratio > 5 and bytes_bwd > bytes_fwd * 3 then 0.3::double else 0 end
  + case when iat_std > iat_mean * 3 and iat_mean > 0.001 then 0.25::double else 0 end
  + case when fin_count > syn_count * 2 and syn_count > 3 then 0.3::double else 0 end
  + case when entropy > 0.85 then 0.5::double else 0 end + case when burst > 0.7 then 0.3::double else 0 end"""
_G = "(partition by source order by ts_us, event_id rows between {0} preceding and current row)"
_DIG = lambda c, i: f"(('0x' || substr(md5({c}), {1 + 2 * i}, 2))::int % 32) / 31.0::double"
EMB_SQL = f"""{ROLL}, gaps as (
  select *, (ts_us - lag(ts_us) over (partition by source order by ts_us, event_id)) / 1000000.0::double as gap from stats),
shaped as (select *, case when count(*) over {_G.format(63)} < 3 then 0.0::double
    when avg(gap) over {_G.format(62)} < 1e-9 then 1 else least(1, stddev_pop(gap) over {_G.format(62)} / avg(gap) over {_G.format(62)}) end as bm,
  entropy(protocol) over {_G.format(63)} / 8 as pe, least(1, coalesce(gap, 0) / 10) as dt from gaps)"""
_EMB_DIMS = {
    0: "bytes_in / (65535 + 1e-9)", 1: "bytes_out / (65535 + 1e-9)", 2: "port_src / (65535 + 1e-9)",
    3: "port_dst / (65535 + 1e-9)", 4: "protocol / 255.0::double", 5: "flags / 255.0::double", 6: "entropy",
    7: "least(1, rate_hz / 1000)", 8: "(list_position(['net','log','proc','auth','file'], type) - 1) / 8.0::double",
    9: "bm", 10: "pe", 11: "packets_total / (1000 + 1e-9)", 12: "packet_size_mean / (1500 + 1e-9)",
    13: "iat_mean / (10 + 1e-9)", 14: "syn_count / (50 + 1e-9)", 16: "down_up_ratio / (10 + 1e-9)",
    15: "0.0::double", **{17 + i: _DIG("source", i) for i in range(5)}, **{22 + i: _DIG("destination", i) for i in range(5)}, 27: "dt",
    28: "pm[1] / 65535.0::double", **{27 + i: f"pm[{i}]" for i in range(2, 7)}, 32: f"pm[5] * {EMB_SHOWN[32]!r}::double",
    34: "sqrt(greatest(0, pv[1])) / 65535.0::double", **{33 + i: f"sqrt(greatest(0, pv[{i}]))" for i in range(2, 7)},
    **{i: "0.0::double" for i in range(40, 64)},
}


def _ewma_sql(key, alpha, values, part):
    over = f"partition by {key} order by ts_us desc, event_id desc" if key else "order by ts_us desc, event_id desc"
    sel = f"{key} as scope_key" if key else "'' as scope_key"
    aggs = ", ".join(f"sum(w * {v}) as {v}_mean, greatest(0, sum(w * {v} * {v}) - sum(w * {v}) * sum(w * {v})) as {v}_var" for v in values)
    return (f"select '{part}' as scope, {sel}, count(*) as events, {aggs} from (select *, {alpha}::double * pow(1 - {alpha}::double, "
            f"row_number() over ({over}) - 1) as w from flows where score < 0.7) group by all")


_V3 = ("score", "rate_hz", "entropy")
BASE_SQL = f"with {t.FLOWS_SQL}, base as (" + " union all ".join([
    _ewma_sql("source", 0.05, _V3, "ip"), _ewma_sql("destination", 0.005, _V3, "host"), _ewma_sql("", 0.001, _V3, "global")]) + ")"
_SD = "sqrt(greatest(1e-6, {v}))"
_ALERT = "least(0.9, greatest(0.3, {m} + 3 * sqrt(greatest(1e-6, {v}))))"
RUN_SQL = f"""with recursive {t.FLOWS_SQL}, rn as (
  select event_id, ts_us, source, score, row_number() over (partition by source order by ts_us, event_id) as n from flows),
ew as (
  select source, 0::bigint as n, 0.0::double as m, 0.0::double as v from (select distinct source from rn)
  union all
  select r.source, r.n, case when r.score >= 0.7 then e.m else e.m + 0.05::double * (r.score - e.m) end,
    case when r.score >= 0.7 then e.v else 0.95::double * (e.v + 0.05::double * (r.score - e.m) * (r.score - e.m)) end
  from ew e join rn r on r.source = e.source and r.n = e.n + 1),
running as (select r.event_id, r.source, r.n, e.m, e.v, {_ALERT.format(m='e.m', v='e.v')} as alert,
  least(0.8, greatest(0.2, 0.35 + 0.5 * e.m)) as gate from rn r join ew e on r.source = e.source and r.n = e.n)"""
SEG_SQL = f"""with recursive {t.FLOWS_SQL}, rn as (
  select *, k = 77 as session_end, row_number() over (partition by source order by ts_us, event_id) as n from flows),
seg as (
  select source, 0::bigint as n, 0::bigint as segment_id, false as flushed, 0::bigint as cnt, 0.0::double as acc,
    null::bigint as since, null::varchar as last from (select distinct source from rn)
  union all
  select source, n, sid, (cnt >= 100 or acc / cnt > 0.7 or coalesce(ts_us - since >= {DAY // 6}, false) or session_end
      or coalesce(type <> last, false)), cnt, acc,
    case when (cnt >= 100 or acc / cnt > 0.7 or coalesce(ts_us - since >= {DAY // 6}, false) or session_end
      or coalesce(type <> last, false)) then ts_us else coalesce(since, ts_us) end, type
  from (select r.source, r.n, r.ts_us, r.type, r.session_end, s.since, s.last,
      case when s.flushed then s.segment_id + 1 else s.segment_id end as sid,
      case when s.flushed then 1 else s.cnt + 1 end as cnt, case when s.flushed then r.score else s.acc + r.score end as acc
    from seg s join rn r on r.source = s.source and r.n = s.n + 1)),
segmented as (select r.*, s.segment_id, s.flushed from rn r join seg s on r.source = s.source and r.n = s.n),
typed as (select source, segment_id, type, count(*) as c, list_position(['net','log','proc','auth','file'], type) as o from segmented group by all),
dom as (select source, segment_id, arg_max(type, c * 100 - o) as dominant_type from typed group by all),
segs as (select source, segment_id, any_value(tenant) as tenant, count(*) as events, avg(score) as trend, avg(rate_hz) as rate_mean,
    count(*) filter (where score > 0.5) / count(*) as error_freq, max(ts_us) filter (where flushed) as ts_us,
    max(event_id) filter (where flushed) as event_id, max(score) filter (where flushed) as last_score
  from segmented group by source, segment_id having bool_or(flushed))"""
SSM_SQL = """with recursive e as (
  select vec_id, label, list_transform(embedding, lambda x: x::double)[1:32] as x,
    row_number() over (partition by label order by vec_id) as n from embeddings),
s as (
  select label, 0::bigint as n, [0.0::double for i in range(32)] as h from (select distinct label from e)
  union all
  select e.label, e.n, [exp(-ln(1 + exp(0.5 * e.x[i])) * exp(-0.5::double)) * s.h[i] + ln(1 + exp(0.5 * e.x[i])) * 0.1 * e.x[i]
    for i in range(1, 33)]
  from s join e on e.label = s.label and e.n = s.n + 1)"""
_FSM_P = {"hold": DAY // 6, "ac": DAY // 12, "bc": DAY // 2, "rw": 5 * DAY}
FSM_SQL = f"""with recursive {t.SIGNALS_SQL}, rn as (
  select event_id, ts_us, source, score as conf, history, drift, k % 10 = 3 as fp,
    case when score < 0.2 then 'Ignore' when score < 0.4 then 'Log' when score < 0.6 then 'Alert'
      when score < 0.85 then 'Block' when score >= 0.95 then 'Escalate' else 'Block' end as d,
    row_number() over (partition by source order by ts_us, event_id) as n from signals),
fsm as (
  select source, 0::bigint as n, null::varchar as last, null::bigint as since, 0::bigint as c, null::bigint as f, null::varchar as final
  from (select distinct source from rn)
  union all
  select source, n,
    case when final is null then last else final end, case when final is null then since else ts_us end,
    case when final is null then c when since is not null and ts_us - since > {_FSM_P['rw']} then 1 else c + 1 end,
    case when final is null then f when f is null or ts_us - since > {_FSM_P['rw']} then ts_us else f end, final
  from (select *, case when quiet then null
        when last = 'Block' and ts_us - since < {_FSM_P['bc']} and h <> 'Escalate' then null
        when last = 'Alert' and ts_us - since < {_FSM_P['ac']} and h not in ('Block', 'Escalate') then null else h end as final
    from (select *, case when last = 'Block' and ts_us - since < {_FSM_P['hold']} and conf >= 0.85 - 0.05 then 'Block' else o end as h
      from (select r.source, r.n, r.ts_us, r.conf, s.last, s.since, s.c, s.f, r.fp or r.conf < 0.1 as quiet,
          case when contains(r.source, '10.0.0.7') then 'Ignore' when contains(r.source, '10.0.0.12') then 'Block'
            when r.d in ('Ignore', 'Log') then r.d
            when (s.c >= 10 and r.ts_us - s.f <= {_FSM_P['rw']}) or (r.history >= 0.85 and r.drift >= 4) or r.drift >= 8 then 'Escalate'
            else r.d end as o
        from fsm s join rn r on r.source = s.source and r.n = s.n + 1))))"""
_COOL = f"""with recursive {t.ALERTS_SQL}, rn as (select event_id, ts_us, source, row_number() over (partition by source order by ts_us, event_id) as n from alerts),
c as (select source, 0::bigint as n, null::bigint as since, false as keep from (select distinct source from rn)
  union all select r.source, r.n, case when c.since is null or r.ts_us - c.since >= {DAY // 2} then r.ts_us else c.since end,
    c.since is null or r.ts_us - c.since >= {DAY // 2} from c join rn r on r.source = c.source and r.n = c.n + 1)"""
_RATE = f"""with recursive {t.FLOWS_SQL}, rn as (select event_id, ts_us, source, row_number() over (partition by source order by ts_us, event_id) as n from flows),
c as (select source, 0::bigint as n, []::bigint[] as recent, false as admitted from (select distinct source from rn)
  union all select source, n, case when len(r) < 5 then list_append(r, ts_us) else r end, len(r) < 5
  from (select x.source, x.n, x.ts_us, [u for u in c.recent if x.ts_us - u < {5 * DAY}] as r from c join rn x on x.source = c.source and x.n = c.n + 1))"""

ORACLE = {
    "rolling_stats": f"{ROLL} select event_id, " + ", ".join(f"round(m[{i + 1}] * {SHOWN.get(f, 1.0)!r}::double, 6) as mean_{f}, round(sqrt(v[{i + 1}]) * {SHOWN.get(f, 1.0)!r}::double, 6) as std_{f}" for i, f in enumerate(FEATURES)) + " from stats",
    "zscore_anomaly": f"{ROLL}, z as (select *, [abs(x[i] - m[i]) / sqrt(greatest(1e-6, v[i])) for i in range(1, 7)] as z from stats) select event_id, round(case when n < 4 then 0 else least(1, (greatest(sqrt(list_sum([q * q for q in z]) / 6), list_max(z) * 0.5) + {_IND}) / 5) end, 6) as anomaly from z",
    "local_embedding": f"{EMB_SQL} select event_id, " + ", ".join(f"round({e}, 6) as d{i}" for i, e in _EMB_DIMS.items()) + ", 64::int as width from shaped",
    "baseline_ewma": f"{BASE_SQL} select scope_key as source, events, " + ", ".join(f"round({v}_{m}, 6) as {v}_{m}" for v in _V3 for m in ("mean", "var")) + " from base where scope = 'ip'",
    "embedding_baseline": "with e as (select label, embedding, 0.02::double * pow(0.98::double, row_number() over (partition by label order by vec_id desc) - 1) as w from embeddings), d as (select label, w, unnest(embedding)::double as x, cast(generate_subscripts(embedding, 1) - 1 as integer) as dim from e) select label, dim, round(sum(w * x), 6) as mean, round(greatest(0, sum(w * x * x) - sum(w * x) * sum(w * x)), 6) as variance from d group by all",
    "scope_baselines": f"{BASE_SQL} select scope, scope_key, events, round(score_mean, 6) as score_mean, round(entropy_var, 6) as entropy_var from base",
    "adaptive_thresholds": f"{BASE_SQL}, a as (select *, {_SD.format(v='score_var')} as sd, {_ALERT.format(m='score_mean', v='score_var')} as alert from base), l as (select *, greatest(0.1, least(alert - 0.05, alert * 0.6)) as log from a) select scope, scope_key, round(greatest(0.1, least(log - 0.05, log * 0.5)), 6) as ignore, round(log, 6) as log, round(alert, 6) as alert, round(greatest(alert + 0.05, least(0.95, alert + 5 * sd)), 6) as block from l",
    "adaptive_scaling": f"{BASE_SQL}, w as (select f.*, coalesce(b.score_mean, g.score_mean) as sm, coalesce(b.score_var, g.score_var) as sv, coalesce(b.rate_hz_mean, g.rate_hz_mean) as rm from flows f left join base b on b.scope = 'ip' and b.scope_key = f.source cross join (select * from base where scope = 'global') g) select event_id, round(least(1, greatest(0, (score - sm) / sqrt(greatest(1e-6, sv)))), 6) as scaled, case when rate_hz > rm then 0.99::double else 0.95::double end as decay, round(least(0.9, greatest(0.2, 0.5 + 0.5 * sm)), 6) as promote, round(least(0.8, greatest(0.2, 0.35 + 0.5 * sm)), 6) as gate from w",
    "baseline_running": f"{RUN_SQL} select event_id, round(m / 0.7::double, 6) as mean_share, round(v, 6) as var from running",
    "threshold_shifts": f"{RUN_SQL}, sh as (select source, 0::bigint as n, 0.6::double as a, 0.35::double as g, false as af, false as gf from (select distinct source from rn) union all select r.source, r.n, case when abs(r.alert - s.a) > 0.005 then r.alert else s.a end, case when abs(r.gate - s.g) > 0.005 then r.gate else s.g end, abs(r.alert - s.a) > 0.005, abs(r.gate - s.g) > 0.005 from sh s join running r on r.source = s.source and r.n = s.n + 1) select r.event_id, s.af as alert_shift, s.gf as gate_shift from running r join sh s on r.source = s.source and r.n = s.n",
    "segment_flush": f"{SEG_SQL} select event_id, segment_id, flushed from segmented",
    "segment_summary": f"{SEG_SQL} select source, segment_id, events, round(trend, 6) as trend, round(rate_mean, 6) as rate_mean, round(error_freq, 6) as error_freq, dominant_type, ts_us from segs join dom using (source, segment_id)",
    "routing_flag": f"{SEG_SQL} select source, segment_id, case when last_score > 0.9 then 'force' when trend < 0.2 and segment_id + 1 < 3 then 'skip' else 'pass' end as route from segs",
    "anomaly_history": f"{SEG_SQL} select tenant, count(*) as segments, round(sum(w * trend), 6) as history from (select *, 0.05::double * pow(0.95::double, row_number() over (partition by tenant order by ts_us desc, event_id desc) - 1) as w from segs) group by tenant",
    "ssm_scan": f"{SSM_SQL} select e.vec_id, round(h[1], 6) as y0, round(h[32], 6) as y31, round(sqrt(list_sum([v * v for v in h])), 6) as energy from e join s on e.label = s.label and e.n = s.n",
    "decision_fsm": f"{FSM_SQL} select r.event_id, coalesce(f.final, '') as final from rn r join fsm f on r.source = f.source and r.n = f.n",
    "cooldown_filter": f"{_COOL} select r.event_id, r.source from rn r join c on r.source = c.source and r.n = c.n where keep",
    "rate_limit": f"{_RATE} select r.event_id, c.admitted from rn r join c on r.source = c.source and r.n = c.n",
}
