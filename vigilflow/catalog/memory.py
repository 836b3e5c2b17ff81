"""Similarity memory, campaigns and reconstruction over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import campaigns as camp
from ..operators import memory as mem
from ..params import sparse_profile
from ..sources import tables as t

P = sparse_profile()
HOUR = 3_600_000_000
IDLE = 3600.0


def r6(c):
    return F.round(c, 6)


def _vectors(spark, sf):
    """Embeddings as remembered events: one an hour, scoped by label and id."""
    e0 = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("record_id"), (F.col("vec_id") * HOUR).alias("ts_us"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        F.least(F.lit(1.0), e0 * 8).alias("score"),
        F.concat(F.lit("ip"), F.col("label").cast("string")).alias("ip"),
        F.concat(F.lit("h"), (F.col("vec_id") % 7).cast("string")).alias("host"),
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("u"), (F.col("vec_id") % 13).cast("string"))).otherwise("").alias("user"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("s"), (F.col("vec_id") % 11).cast("string"))).otherwise("").alias("session"),
        F.lit("").alias("process"),
    )


def _memory(spark, sf):
    from ..operators import rows

    return rows.memory_fanout(_vectors(spark, sf)).select("scope", "scope_key", "record_id", "ts_us", "vector", "score")


MEM_SQL = f"""vec as (
  select vec_id as record_id, vec_id * {HOUR} as ts_us, list_transform(embedding, lambda x: x::double) as v,
    least(1, abs(embedding[1]::double) * 8) as score, concat('ip', cast(label as varchar)) as ip,
    concat('h', cast(vec_id % 7 as varchar)) as host,
    case when vec_id % 2 = 0 then concat('u', cast(vec_id % 13 as varchar)) else '' end as usr,
    case when vec_id % 3 = 0 then concat('s', cast(vec_id % 11 as varchar)) else '' end as ses
  from embeddings),
memory as (
  select 'ip' as scope, ip as scope_key, record_id, ts_us, v, score from vec
  union all select 'user', usr, record_id, ts_us, v, score from vec where usr <> ''
  union all select 'session', ses, record_id, ts_us, v, score from vec where ses <> ''
  union all select 'host', host, record_id, ts_us, v, score from vec where score >= 0.5
  union all select 'global', '', record_id, ts_us, v, score from vec where score >= 0.85)"""

# a week of hours, with the matching recency
MEMORY = replace(P.memory, max_age_s=7 * 86400.0, recency_tau_s=86400.0)


def similar_context(spark, sf):
    probes = _vectors(spark, sf).withColumnRenamed("record_id", "probe_id")
    out = mem.retrieve(probes, _memory(spark, sf), MEMORY)
    return out.select("probe_id", "record_id", "rank", "scope", r6("score").alias("score"), r6("cosine").alias("cosine"))


def vector_topk(spark, sf):
    v = _vectors(spark, sf)
    probes = v.select(F.col("record_id").alias("probe_id"), "ts_us", "vector")
    out = mem.vector_topk(probes, v, 5, weights=(0.5, 0.3, 0.0))
    return out.select("probe_id", "record_id", r6("score").alias("score"), r6("cosine").alias("cosine"))


def merge_context(spark, sf):
    hits = _memory(spark, sf).select(
        F.lit(1).alias("probe_id"), "record_id", "score", F.col("score").alias("cosine"), "scope")
    per = hits.withColumn("probe_id", F.col("record_id") % 50)
    return mem.merge_context(per, 5).select("probe_id", "record_id", "rank", r6("score").alias("score"))


LIMITS = {"global": 30, "host": 20, "ip": 20, "user": 20, "session": 20, "process": 20}


def memory_evict(spark, sf):
    return mem.evict(_memory(spark, sf), 480 * HOUR, LIMITS, 300 * 3600.0).select("scope", "scope_key", "record_id")


def memory_sweep(spark, sf):
    return mem.sweep(_memory(spark, sf), 480 * HOUR, 300 * 3600.0).select("scope", "scope_key", "record_id")


def memory_cleanup(spark, sf):
    m = _memory(spark, sf)
    ended = m.filter((F.col("scope") == "session") & (F.col("score") > 0.9)).select("scope", "scope_key")
    return mem.cleanup(m, ended).select("scope", "scope_key", "record_id")


def _campaigns(spark, sf):
    al = t.alerts(spark, sf).select("event_id", "ts_us", "source", "destination", "score", "attack_class")
    return camp.campaigns(al, P.slice_s, replace(P.correlation, campaign_idle_s=IDLE))


def campaigns(spark, sf):
    return _campaigns(spark, sf).select("event_id", "campaign_id")


def campaign_summary(spark, sf):
    return camp.campaign_summary(_campaigns(spark, sf)).withColumn("max_score", r6("max_score"))


def campaign_sets(spark, sf):
    return camp.campaign_members(_campaigns(spark, sf))


QUERIES = {
    "similar_context": similar_context, "vector_topk": vector_topk, "merge_context": merge_context,
    "memory_evict": memory_evict, "memory_sweep": memory_sweep, "memory_cleanup": memory_cleanup,
    "campaigns": campaigns, "campaign_summary": campaign_summary, "campaign_sets": campaign_sets,
}

_COS = "list_sum([q[1] * q[2] for q in list_zip({0}.v, {1}.v)]) / (sqrt(list_sum([q * q for q in {0}.v]) + 1e-9) * sqrt(list_sum([q * q for q in {1}.v]) + 1e-9))"
_SCOPES = "(values ('ip', 3, 1.0::double), ('user', 2, 0.9::double), ('session', 2, 0.85::double), ('host', 2, 0.7::double), ('global', 4, 0.5::double)) as k(scope, lim, w)"
CAMP_SQL = f"""with recursive {t.ALERTS_SQL}, fresh as (
  select event_id, ts_us, source, destination, score, attack_class,
    case when ts_us - lag(ts_us) over (partition by attack_class order by ts_us, event_id) <= {int(IDLE * 1e6)} then 0 else 1 end as fc,
    case when ts_us - lag(ts_us) over (partition by source order by ts_us, event_id) <= {int(IDLE * 1e6)} then 0 else 1 end as fs from alerts),
nodes as (select *, concat('class|', attack_class, '|', printf('%012d', cast(sum(fc) over (partition by attack_class order by ts_us, event_id) as bigint))) as a,
    concat('source|', source, '|', printf('%012d', cast(sum(fs) over (partition by source order by ts_us, event_id) as bigint))) as b from fresh),
edges as (select distinct a, b from nodes union select distinct b, a from nodes),
reach as (select a as node, a as root from edges union select e.b, r.root from reach r join edges e on e.a = r.node),
label as (select node, min(root) as campaign from reach group by node),
tagged as (select n.*, case when max(score) over (partition by l.campaign) >= 0.4 then l.campaign end as campaign_id
  from nodes n join label l on l.node = n.a)"""

ORACLE = {
    "similar_context": f"with {MEM_SQL}, pr as (select 'ip' as scope, ip as scope_key, record_id, ts_us, v from vec union all select 'user', usr, record_id, ts_us, v from vec where usr <> '' union all select 'session', ses, record_id, ts_us, v from vec where ses <> '' union all select 'host', host, record_id, ts_us, v from vec union all select 'global', '', record_id, ts_us, v from vec), h as (select p.record_id as probe_id, m.record_id, p.scope, {_COS.format('p', 'm')} as cosine, m.score as rs, (p.ts_us - m.ts_us) / 1000000.0::double as age from pr p join memory m on p.scope = m.scope and p.scope_key = m.scope_key and m.ts_us < p.ts_us and p.ts_us - m.ts_us <= {7 * 86400 * 1000000}), s as (select *, 0.5 * cosine + 0.3 * rs + 0.2 * exp(-age / 86400) as base from h), r as (select *, row_number() over (partition by probe_id, scope order by base desc, record_id) as n from s), t as (select probe_id, record_id, r.scope, base + w as score, cosine from r join {_SCOPES} on k.scope = r.scope where n <= lim), u as (select probe_id, record_id, arg_max(scope, score) as scope, max(score) as score, any_value(cosine) as cosine from t group by all), z as (select *, row_number() over (partition by probe_id order by score desc, record_id) as rank from u) select probe_id, record_id, cast(rank as integer) as rank, scope, round(score, 6) as score, round(cosine, 6) as cosine from z where rank <= 8".replace("group by all), z", "group by probe_id, record_id), z"),
    "vector_topk": f"with {MEM_SQL}, s as (select p.record_id as probe_id, m.record_id, {_COS.format('p', 'm')} as cosine, m.score as rs from vec p join vec m on p.record_id <> m.record_id), z as (select *, 0.5 * cosine + 0.3 * rs as score from s qualify row_number() over (partition by probe_id order by 0.5 * cosine + 0.3 * rs desc, record_id) <= 5) select probe_id, record_id, round(score, 6) as score, round(cosine, 6) as cosine from z",
    "merge_context": f"with {MEM_SQL}, u as (select record_id % 50 as probe_id, record_id, max(score) as score from memory group by all), z as (select *, cast(row_number() over (partition by probe_id order by score desc, record_id) as integer) as rank from u) select probe_id, record_id, rank, round(score, 6) as score from z where rank <= 5",
    "memory_evict": f"with {MEM_SQL}, lim as (select *, case when scope = 'global' then 30 else 20 end as lim, count(*) over (partition by scope, scope_key) as n from memory), swept as (select * from lim where n <= lim or {480 * HOUR} - ts_us <= {300 * HOUR}), c as (select *, count(*) over (partition by scope, scope_key) as fresh, row_number() over (partition by scope, scope_key order by score, record_id) as r from swept) select scope, scope_key, record_id from c where n <= lim or fresh <= lim or r > fresh // 4",
    "memory_sweep": f"with {MEM_SQL} select scope, scope_key, record_id from memory where {480 * HOUR} - ts_us <= {300 * HOUR}",
    "memory_cleanup": f"with {MEM_SQL} select scope, scope_key, record_id from memory m where not exists (select 1 from memory e where e.scope = 'session' and e.score > 0.9 and e.scope = m.scope and e.scope_key = m.scope_key)",
    "campaigns": f"{CAMP_SQL} select event_id, campaign_id from tagged",
    "campaign_summary": f"{CAMP_SQL} select campaign_id, min(ts_us) as first_us, max(ts_us) as last_us, count(*) as events, round(max(score), 6) as max_score, count(distinct source) as sources, count(distinct destination) as hosts from tagged where campaign_id is not null group by campaign_id",
    "campaign_sets": f"{CAMP_SQL} select distinct campaign_id, 'source' as kind, source as member from tagged where campaign_id is not null union select distinct campaign_id, 'host', destination from tagged where campaign_id is not null",
}
