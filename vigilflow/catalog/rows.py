"""Predicates, projections, specialists and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..operators import rows, specialists
from ..params import FusionWeights
from ..sources import tables as t

ALLOW, BLOCK = ("10.0.0.7",), ("10.0.0.1",)


def r6(c):
    return F.round(c, 6)


def _dirty(spark, sf):
    k = F.col("k")
    return t.flows(spark, sf).select(
        "event_id",
        F.when(k == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(k == 1, "unk").otherwise(F.col("type")).alias("type"),
        F.when(k == 2, F.lit(float("nan"))).otherwise(F.col("entropy")).alias("entropy"),
        F.when(k == 3, F.lit(float("inf"))).otherwise(F.col("rate_hz")).alias("rate_hz"),
    )


DIRTY_SQL = t.FLOWS_SQL + """, dirty as (
  select event_id, case when k = 0 then '' else source end as source,
    case when k = 1 then 'unk' else type end as type,
    case when k = 2 then 'nan'::double else entropy end as entropy,
    case when k = 3 then 'inf'::double else rate_hz end as rate_hz from flows)"""


def validate_event(spark, sf):
    return rows.validate(_dirty(spark, sf)).select("event_id", "source", "type", r6("entropy").alias("entropy"))


def quarantine(spark, sf):
    return rows.quarantine(_dirty(spark, sf)).select("event_id", "source", "type")


LABEL_TEXT = (
    "case k % 10 when 0 then 'PortScan' when 1 then 'DoS_Hulk' when 2 then 'normal traffic' when 3 then '0'"
    " when 4 then '-' when 5 then '' when 6 then 'Benign' when 7 then 'Web-Attack' when 8 then 'NORMAL'"
    " else 'ddos' end"
)


def benign(spark, sf):
    lab = F.expr(LABEL_TEXT)
    return t.flows(spark, sf).select("event_id", lab.alias("label"), scores.is_benign(lab).alias("benign"))


def normalize_label(spark, sf):
    lab = F.expr(LABEL_TEXT)
    return t.flows(spark, sf).select("event_id", scores.normalize_label(lab).alias("label"))


BENIGN_SQL = "(lower(label) like '%benign%' or lower(label) like '%normal%' or lower(label) in ('0','-',''))"


def score_to_decision(spark, sf):
    return t.flows(spark, sf).select(
        "event_id", scores.decide(F.col("score")).alias("decision"),
        scores.strength(scores.decide(F.col("score"))).alias("strength"),
    )


DECIDE = """case when {0} < 0.2 then 'Ignore' when {0} < 0.4 then 'Log' when {0} < 0.6 then 'Alert'
  when {0} < 0.85 then 'Block' when {0} >= 0.95 then 'Escalate' else 'Block' end"""


def severity(spark, sf):
    s = F.col("score")
    return t.flows(spark, sf).select(
        "event_id", scores.severity(s).alias("severity"), scores.severity(s, low=False).alias("bridge_severity")
    )


def bridge_decision(spark, sf):
    return t.alerts(spark, sf).select("event_id", scores.bridge_decision(F.col("decision")).alias("reported"))


PROTO = "case k % 5 when 0 then 6 when 1 then 17 when 2 then 1 when 3 then 58 else 132 end"


def protocol_name(spark, sf):
    return t.flows(spark, sf).select(
        "event_id", scores.protocol_name(F.expr(PROTO)).alias("name"),
        scores.protocol_name(F.expr(PROTO), fold_icmp=True).alias("daemon_name"),
    )


def protocol_number(spark, sf):
    text = F.expr("case k % 5 when 0 then ' tcp ' when 1 then 'UDP' when 2 then 'icmp' when 3 then 'ICMPv6' else 'x' end")
    return t.flows(spark, sf).select("event_id", scores.protocol_number(text).alias("number"))


def event_type_name(spark, sf):
    short = scores.event_type_name(F.col("k") % 9)
    return t.flows(spark, sf).select(
        "event_id", short.alias("name"), scores.event_type_display(short).alias("display"),
        scores.event_type_ordinal(short).alias("ordinal"),
    )


def attack_indicators(spark, sf):
    flags = {n: cond for n, (cond, _) in scores.attack_indicators().items()}
    return t.signals(spark, sf).select(
        "event_id", *[c.alias(n) for n, c in flags.items()],
        r6(scores.indicator_boost(F.col("entropy"), F.col("burst"))).alias("boost"),
    )


INDICATORS = {
    "syn_flood": ("syn_count > 5 and ack_count < syn_count // 2", 0.4),
    "small_packet": ("packets_total > 100 and packet_size_mean < 100", 0.3),
    "burst_packets": ("iat_mean < 0.001 and packets_total > 50", 0.3),
    "asymmetric": ("down_up_ratio > 5 and bytes_bwd > bytes_fwd * 3", 0.3),
    "irregular": ("iat_std > iat_mean * 3 and iat_mean > 0.001", 0.25),
    "fin_scan": ("fin_count > syn_count * 2 and syn_count > 3", 0.3),
}
INDICATOR_SUM = " + ".join(f"case when {c} then {b}::double else 0 end" for c, b in INDICATORS.values())


def classify_attack(spark, sf):
    fused = scores.fuse_score()
    return t.signals(spark, sf).select("event_id", scores.classify_attack(fused).alias("attack_class"))


FUSE_SQL = """least(1, greatest(0, 0.35 * score + 0.25 * trend + 0.2 * history
  + 0.1 * least(1, greatest(0, drift / 10))
  + case when len(list_filter(retrieved, lambda s: s > 0.8)) > 0 then 0.05::double else 0 end
  + case when len(rules) > 0 then 0.05::double else 0 end))"""
GATE_SQL = """(0.35 * score + 0.25 * trend + 0.15 * history + 0.1 * least(1, greatest(0, drift / 10))
  + 0.1 * similarity + case when len(rules) > 0 then 0.05::double else 0 end)"""
CLASS_SQL = """case when {0} < 0.3 then 'none'
  when burst > 0.8 and rate_mean > 500 then 'DoS/DDoS'
  when entropy > 0.9 and error_freq > 0.5 then 'EncryptedC2/Exfiltration'
  when dominant_type = 'auth' and trend > 0.6 then 'BruteForce/CredentialStuffing'
  when dominant_type = 'file' and score > 0.7 then 'FileSystemAnomaly/Ransomware'
  when dominant_type = 'proc' and drift > 5 then 'LateralMovement/Persistence'
  when len(rules) > 0 then concat('RuleMatch:', rules[1])
  when {0} > 0.85 then 'UnknownHighSeverity' else 'UnknownLowSeverity' end"""


def large_traffic(spark, sf):
    big = t.traffic(spark, sf).withColumn("bytes", F.col("bytes") * 10)
    return rows.large_traffic(big).select(
        "event_id", "bytes", "decision", "severity", "confidence", "attack_class", "anomaly_score", "explanation"
    )


def alert_filter(spark, sf):
    return rows.filter_alerts(
        t.alerts(spark, sf), tenant="tenant_1", severity="medium", device=None,
        time_from_us=1704412800000000, time_to_us=1705708800000000,
    ).select("event_id", "ts_us", "tenant", "severity", "attack_class")


def log_search(spark, sf):
    return rows.search_logs(t.logs(spark, sf), search="BYTES=12", protocol="TCP").select("event_id", "src_ip", "message")


def rule_filter(spark, sf):
    return rows.filter_rules(t.rules(spark, sf), search="WEB", status="Enabled").select("sid", "name", "category", "enabled")


def list_override(spark, sf):
    return t.flows(spark, sf).select(
        "event_id",
        scores.list_override(F.col("source"), scores.decide(F.col("score")), ALLOW, BLOCK).alias("decision"),
    )


def gate_score(spark, sf):
    return t.signals(spark, sf).select("event_id", r6(scores.gate_score()).alias("gate_score"))


def fuse_score(spark, sf):
    return t.signals(spark, sf).select("event_id", r6(scores.fuse_score()).alias("fused"))


def gate_predicate(spark, sf):
    return t.signals(spark, sf).select("event_id", *[c.alias(n) for n, c in scores.gate(ALLOW).items()])


def reasoning_decision(spark, sf):
    out = scores.reason(scores.fuse_score())
    return t.signals(spark, sf).select(
        "event_id", r6(out["confidence"]).alias("confidence"),
        out["false_positive"].alias("false_positive"), out["decision"].alias("decision"),
    )


REASON_SQL = f"""reasoned as (
  select *, case when len(rules) > 0 then greatest(fused, 0.6) else fused end as confidence
  from (select *, {FUSE_SQL} as fused from signals))"""


def memory_gate(spark, sf):
    sig = t.signals(spark, sf).withColumn("decision", scores.decide(F.col("score")))
    return sig.filter(rows.should_write()).select("event_id", "source", r6("score").alias("score"))


def _with_metadata(spark, sf):
    k = F.col("k")
    pairs = F.array(
        F.when(k % 2 == 0, F.struct(F.lit("user").alias("key"), F.concat(F.lit("u"), (k % 13).cast("string")).alias("value"))),
        F.when(k % 3 == 0, F.struct(F.lit("session").alias("key"), F.concat(F.lit("s"), (k % 17).cast("string")).alias("value"))),
        F.when(k % 5 == 0, F.struct(F.lit("proc").alias("key"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("value"))),
    )
    return t.flows(spark, sf).withColumn(
        "metadata", F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))
    )


KEYS_SQL = t.FLOWS_SQL + """, keyed as (
  select *, source as ip, destination as host,
    case when k % 2 = 0 then concat('u', cast(k % 13 as varchar)) else '' end as user_key,
    case when k % 3 = 0 then concat('s', cast(k % 17 as varchar)) else '' end as session_key,
    case when k % 5 = 0 then concat('p', cast(k % 7 as varchar)) else '' end as process_key
  from flows)"""


def scope_keys(spark, sf):
    return rows.scope_keys(_with_metadata(spark, sf)).select(
        "event_id", "ip", "host", F.col("user").alias("user_key"),
        F.col("session").alias("session_key"), F.col("process").alias("process_key"),
    )


def memory_fanout(spark, sf):
    return rows.memory_fanout(rows.scope_keys(_with_metadata(spark, sf))).select("event_id", "scope", "scope_key")


def explain_alert(spark, sf):
    out = scores.reason(scores.fuse_score())
    cls = scores.classify_attack(out["confidence"])
    return t.signals(spark, sf).select(
        "event_id", scores.explain(out["decision"], cls, out["confidence"], out["false_positive"]).alias("explanation")
    )


def learning_mode(spark, sf):
    return t.alerts(spark, sf).select("event_id", scores.learning_mode(F.col("decision")).alias("decision"))


def default_fill(spark, sf):
    return rows.fill_log_defaults(t.logs(spark, sf)).select("event_id", "type", "severity", "message")


def last_seen_human(spark, sf):
    seconds = F.expr("(1706659200000000 - ts_us) / 1000000.0").cast("double")
    return t.flows(spark, sf).select("event_id", scores.human_ago(seconds / 600).alias("ago"))


def _drift_rows(spark, sf):
    """Baseline vectors with a drift and a history: one per embedding."""
    e = F.col("embedding")
    return t.table(spark, sf, "embeddings").select(
        "vec_id",
        vectors.norm(e, 0.0).alias("drift"),
        F.abs(F.get(e, F.lit(0)).cast("double")).alias("history"),
        F.transform(e, lambda x: x.cast("double") * 0.5).alias("baseline"),
    )


def drift_series(spark, sf):
    return _drift_rows(spark, sf).select(
        "vec_id", r6("drift").alias("drift"), r6("history").alias("history"),
        F.lit(0.6).alias("alert_threshold"), F.lit(0.35).alias("gate_threshold"),
        r6(vectors.dot(F.col("baseline"), F.col("baseline"))).alias("baseline_energy"),
    )


def priority_filter(spark, sf):
    return rows.priority_filter(t.flows(spark, sf)).select("event_id", r6("rate_hz").alias("rate_hz"))


def _spec(name):
    def query(spark, sf):
        return t.flows(spark, sf).select("event_id", specialists.SPECIALISTS[name]().alias("r")).select(
            "event_id", "r.attack_class", r6("r.confidence").alias("confidence"), "r.decision", "r.details", "r.validated"
        )
    query.__name__ = f"spec_{name}"
    return query


# name: (class, hit, confidence, decision, details, validated)
SPEC_SQL = {
    "portscan": ("PortScan", "(flags & 2) <> 0", "0.6", "'Log'", "''", "type = 'net' and (flags & 2) <> 0"),
    "bruteforce": ("BruteForce", "type = 'auth' and (flags & 1) <> 0", "0.8", "'Alert'", "''", "type = 'auth' or port_dst in (22, 21)"),
    "webexploit": ("WebExploit", "entropy > 0.8", "0.75", "'Block'", "'web request whose payload looks random'", "port_dst in (80, 443, 8080)"),
    "ransomware": ("Ransomware", "type = 'file' and entropy > 0.95", "0.9", "'Block'", "'file rewritten with random-looking content'", "type = 'file' or entropy > 0.9"),
    "insider": ("Insider", "bytes_out > 50000", "0.65", "'Escalate'", "'much data sent out'", "source <> ''"),
    "zeroday": ("ZeroDay", "entropy > 0.7 and rate_hz > 1000", "0.7", "'Alert'", "'fast and random traffic of no known kind'", "entropy > 0.7 and rate_hz > 1000"),
    "mitre": ("MITRE-T1059", "type = 'log' and entropy > 0.85", "0.8", "'Escalate'", "'log of a command run, T1059'", "true"),
    "ddos": (
        "DDoS", "rate_hz > 100",
        "case when rate_hz > 1000 then least(0.95, 0.3 + rate_hz / 10000) else 0.4 end",
        "case when rate_hz > 1000 and least(0.95, 0.3 + rate_hz / 10000) > 0.75 then 'Block' when rate_hz > 1000 then 'Alert' else 'Log' end",
        "case when rate_hz > 1000 then 'request rate of a flood' else 'raised request rate' end", "true",
    ),
}


def _spec_select(name):
    cls, hit, conf, dec, det, val = SPEC_SQL[name]
    return (
        f"select event_id, '{cls}' as attack_class, round(case when {hit} then ({conf})::double else 0 end, 6) as confidence, "
        f"case when {hit} then {dec} else 'Ignore' end as decision, case when {hit} then {det} else '' end as details, "
        f"{val} as validated, {list(SPEC_SQL).index(name)} as pos from flows"
    )


FOUND_SQL = t.FLOWS_SQL + ", found as (" + " union all ".join(_spec_select(n) for n in SPEC_SQL) + """),
best as (
  select event_id, arg_max(struct_pack(c := attack_class, f := confidence, d := decision), struct_pack(f := confidence, p := -pos)) as b
  from found where validated and confidence > 0 group by event_id),
summary as (
  select event_id, string_agg(concat('[', attack_class, ':', substr(printf('%.6f', confidence), 1, 4), '] '), '' order by pos) as s
  from found where validated and decision <> 'Ignore' group by event_id),
consensus as (
  select f.event_id, coalesce(b.b.c, '') as attack_class, coalesce(b.b.f, 0) as confidence,
    coalesce(b.b.d, 'Ignore') as decision, concat('agreed findings: ', coalesce(s.s, '')) as details
  from flows f left join best b using (event_id) left join summary s using (event_id)),
trigger as (
  select event_id, arg_min(struct_pack(c := attack_class, f := confidence, d := decision, t := details), pos) as g
  from found where validated and confidence > 0.6 and attack_class in ('ZeroDay', 'Ransomware') group by event_id)"""


def _fused(fuse):
    def query(spark, sf):
        return t.flows(spark, sf).select("event_id", fuse(specialists.results()).alias("r")).select(
            "event_id", "r.attack_class", r6("r.confidence").alias("confidence"), "r.decision", "r.details"
        )
    return query


def fuse_registered(spark, sf):
    """A detector and a strategy added to the registries, for this query only."""
    def bulk():
        return specialists.result("BulkTransfer", F.col("bytes_out") > 20000, 0.77, "Alert", F.lit(True), "many bytes out")

    def surest(found):
        sure = F.filter(found, lambda r: r["validated"] & (r["confidence"] > 0.7))
        return F.struct(F.size(sure).alias("n"), F.array_join(F.array_sort(F.transform(sure, lambda r: r["attack_class"])), "+").alias("classes"))

    specialists.register("bulk", bulk)
    specialists.register_fusion("surest", surest)
    try:
        return t.flows(spark, sf).select("event_id", specialists.fuse("surest").alias("r")).select("event_id", "r.*")
    finally:
        del specialists.SPECIALISTS["bulk"], specialists.FUSIONS["surest"]


def specialist_boost(spark, sf):
    out = scores.reason(scores.fuse_score())
    sig = t.signals(spark, sf).withColumn("attack_class", scores.classify_attack(out["confidence"]))
    sig = sig.withColumns({"confidence": out["confidence"], "decision": out["decision"]})
    return specialists.specialist_boost(sig).select(
        "event_id", "attack_class", r6("confidence").alias("confidence"), "decision"
    )


# ---- scalar functions ------------------------------------------------------------------------

def scalar_math(spark, sf):
    x = F.col("entropy") * 30 - 5
    return t.flows(spark, sf).select(
        "event_id",
        r6(scores.clamp(x, 0.0, 10.0)).alias("clamped"),
        r6(F.col("bytes_in") / (65535 + 1e-9)).alias("normalized"),
        r6(F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))).alias("softplus"),
        r6(F.exp(-F.col("rate_hz") / 600)).alias("decay"),
    )


def scalar_text(spark, sf):
    return t.table(spark, sf, "documents").select(
        "doc_id", F.upper(F.trim("source")).alias("upper_source"),
        F.replace("text", F.lit('"'), F.lit('""')).alias("quoted"),
        F.col("text").ilike("%the%").alias("has_the"),
        F.sha2("text", 256).alias("sha"),
    )


def scalar_time(spark, sf):
    from ..functions import times

    text = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(F.col("k") % 3 == 0, "Z").when(F.col("k") % 3 == 1, "+02:00").otherwise(""))
    text = F.when(F.col("k") == 99, "not a time").otherwise(text)
    us = times.parse_iso_us(text, F.lit(0))
    return t.flows(spark, sf).select(
        "event_id", us.alias("parsed_us"), times.bucket_us(F.col("ts_us"), "hour").alias("hour_us"),
        times.month(F.col("ts_us")).alias("month"),
    )


def sql_functions(spark, sf):
    """The registered SQL functions called from `spark.sql`."""
    from ..functions.register import register_functions, register_views

    register_functions(spark)
    register_views(spark, sf)
    return spark.sql(
        "select event_id, score_to_decision(score) as decision, alert_severity(score) as severity,"
        " round(gate_score(score, trend, history, drift, similarity, size(rules) > 0), 6) as gate,"
        " round(fuse_score(score, trend, history, drift, exists(retrieved, x -> x > 0.8), size(rules) > 0), 6) as fused,"
        " protocol_name(protocol) as protocol from signals")


def similarity_to_label(spark, sf):
    from ..operators import similarity

    return similarity.match_signatures(
        t.table(spark, sf, "embeddings"), similarity.label_signatures(t.table(spark, sf, "embeddings"))
    ).select("vec_id", F.col("signature"), r6("cosine").alias("cosine"))


def attention_score(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double") * 4)
    tokens = F.array(e, F.reverse(e), F.transform(e, lambda x: x * x), F.transform(e, lambda x: -x))
    sim = vectors.attention_similarity(tokens, 64)
    return t.table(spark, sf, "embeddings").select(
        "vec_id", r6(sim).alias("similarity"), r6(vectors.attention_boost(sim)).alias("boost")
    )


QUERIES = {
    "validate_event": validate_event, "quarantine_event": quarantine, "is_benign": benign,
    "normalize_label": normalize_label, "score_to_decision": score_to_decision, "severity": severity,
    "bridge_decision": bridge_decision, "protocol_name": protocol_name, "protocol_number": protocol_number,
    "event_type_name": event_type_name, "attack_indicators": attack_indicators, "classify_attack": classify_attack,
    "large_traffic": large_traffic, "alert_filter": alert_filter, "log_search": log_search,
    "rule_filter": rule_filter, "list_override": list_override, "gate_score": gate_score,
    "fuse_score": fuse_score, "gate_predicate": gate_predicate, "reasoning_decision": reasoning_decision,
    "memory_gate": memory_gate, "scope_keys": scope_keys, "memory_fanout": memory_fanout,
    "explain_alert": explain_alert, "learning_mode": learning_mode, "default_fill": default_fill,
    "last_seen_human": last_seen_human, "drift_series": drift_series, "priority_filter": priority_filter,
    **{f"spec_{n}": _spec(n) for n in SPEC_SQL},
    "fuse_consensus": _fused(specialists.fuse_consensus), "fuse_priority": _fused(specialists.fuse_priority),
    "fuse_registered": fuse_registered, "specialist_boost": specialist_boost, "scalar_math": scalar_math, "scalar_text": scalar_text,
    "scalar_time": scalar_time, "sql_functions": sql_functions, "signature_match": similarity_to_label, "attention_score": attention_score,
}

_F, _A, _S = f"with {t.FLOWS_SQL} ", f"with {t.ALERTS_SQL} ", f"with {t.SIGNALS_SQL} "
_IN = lambda expr, parts: "(" + " or ".join(f"contains({expr}, '{p}')" for p in parts) + ")"
_VALID = "source <> '' and type <> 'unk' and isfinite(entropy) and isfinite(rate_hz)"
_FORCE = "(len(rules) > 0 or score > 0.9 or drift > 6 or history > 0.7)"
_SKIP = f"(not {_FORCE} and ({_IN('source', ALLOW)} or (score < 0.1 and len(rules) = 0)))"
_REASONED = f"with {t.SIGNALS_SQL}, {REASON_SQL}, judged as (select *, confidence < 0.2 as false_positive, " \
    f"case when confidence < 0.2 then 'Ignore' else {DECIDE.format('confidence')} end as decision, " \
    f"{CLASS_SQL.format('confidence')} as attack_class from reasoned) "
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_EMB = "select vec_id, list_transform(embedding, lambda x: x::double) as e, label from embeddings"

ORACLE = {
    "sql_functions": f"{_S} select event_id, {DECIDE.format('score')} as decision, case when score > 0.9 then 'critical' when score > 0.7 then 'high' when score > 0.5 then 'medium' else 'low' end as severity, round({GATE_SQL}, 6) as gate, round({FUSE_SQL}, 6) as fused, case protocol when 6 then 'TCP' when 17 then 'UDP' else 'ICMP' end as protocol from signals",
    "validate_event": f"with {DIRTY_SQL} select event_id, source, type, round(entropy, 6) as entropy from dirty where {_VALID}",
    "quarantine_event": f"with {DIRTY_SQL} select event_id, source, type from dirty where not ({_VALID})",
    "is_benign": f"{_F} select event_id, label, {BENIGN_SQL} as benign from (select *, {LABEL_TEXT} as label from flows)",
    "normalize_label": f"{_F} select event_id, case when {BENIGN_SQL} then 'Benign' else label end as label from (select *, {LABEL_TEXT} as label from flows)",
    "score_to_decision": f"{_F} select event_id, decision, cast(list_position(['Ignore','Log','Alert','Block','Escalate'], decision) - 1 as integer) as strength from (select event_id, {DECIDE.format('score')} as decision from flows)",
    "severity": f"{_F} select event_id, case when score > 0.9 then 'critical' when score > 0.7 then 'high' when score > 0.5 then 'medium' else 'low' end as severity, case when score > 0.9 then 'critical' when score > 0.7 then 'high' else 'medium' end as bridge_severity from flows",
    "bridge_decision": f"{_A} select event_id, case when decision = 'Alert' then 'alert' else 'block' end as reported from alerts",
    "protocol_name": f"{_F} select event_id, case k % 5 when 0 then 'TCP' when 1 then 'UDP' when 2 then 'ICMP' when 3 then 'ICMPv6' else '132' end as name, case k % 5 when 0 then 'TCP' when 1 then 'UDP' when 2 then 'ICMP' when 3 then 'ICMP' else '132' end as daemon_name from flows",
    "protocol_number": f"{_F} select event_id, case k % 5 when 0 then 6 when 1 then 17 when 2 then 1 when 3 then 58 else 0 end as number from flows",
    "event_type_name": f"{_F} select event_id, coalesce(['net','log','proc','auth','file','api','sig'][k % 9 + 1], 'unk') as name, coalesce(['Network','System','Process','Auth','File','API','Signal'][k % 9 + 1], 'System') as display, cast(least(k % 9, 7) as integer) as ordinal from flows",
    "attack_indicators": f"{_S} select event_id, " + ", ".join(f"{c} as {n}" for n, (c, _) in INDICATORS.items()) + f", round({INDICATOR_SUM} + case when entropy > 0.85 then 0.5::double else 0 end + case when burst > 0.7 then 0.3::double else 0 end, 6) as boost from signals",
    "classify_attack": f"{_S} select event_id, {CLASS_SQL.format('fused')} as attack_class from (select *, {FUSE_SQL} as fused from signals)",
    "large_traffic": f"{_F} select event_id, bytes_in * 10 as bytes, 'alert' as decision, 'high' as severity, 0.9::double as confidence, 'large_traffic' as attack_class, 1.0::double as anomaly_score, concat('Large traffic volume: ', bytes_in * 10, ' bytes') as explanation from flows where bytes_in * 10 > 1000000",
    "alert_filter": f"{_A} select event_id, ts_us, tenant, severity, attack_class from alerts where tenant = 'tenant_1' and severity = 'medium' and ts_us >= 1704412800000000 and ts_us <= 1705708800000000",
    "log_search": f"with {t.LOGS_SQL} select event_id, src_ip, message from logs where protocol = 'TCP' and (src_ip ilike '%BYTES=12%' or dst_ip ilike '%BYTES=12%' or message ilike '%BYTES=12%')",
    "rule_filter": f"with {t.RULES_SQL} select sid, name, category, enabled from rules where (name ilike '%WEB%' or category ilike '%WEB%') and enabled order by sid",
    "list_override": f"{_F} select event_id, case when {_IN('source', ALLOW)} then 'Ignore' when {_IN('source', BLOCK)} then 'Block' else {DECIDE.format('score')} end as decision from flows",
    "gate_score": f"{_S} select event_id, round({GATE_SQL}, 6) as gate_score from signals",
    "fuse_score": f"{_S} select event_id, round({FUSE_SQL}, 6) as fused from signals",
    "gate_predicate": f"{_S} select event_id, {_FORCE} as forced, {_SKIP} as skipped, {_FORCE} or (not {_SKIP} and {GATE_SQL} >= 0.35) as run from signals",
    "reasoning_decision": f"{_REASONED} select event_id, round(confidence, 6) as confidence, false_positive, decision from judged",
    "memory_gate": f"{_S} select event_id, source, round(score, 6) as score from signals where score >= 0.5 or len(rules) > 0 or {DECIDE.format('score')} in ('Block', 'Escalate')",
    "scope_keys": f"with {KEYS_SQL} select event_id, ip, host, user_key, session_key, process_key from keyed",
    "memory_fanout": f"with {KEYS_SQL} select event_id, 'ip' as scope, ip as scope_key from keyed union all select event_id, 'user', user_key from keyed where user_key <> '' union all select event_id, 'host', host from keyed where score >= 0.5 union all select event_id, 'global', '' from keyed where score >= 0.85 union all select event_id, 'session', session_key from keyed where session_key <> '' union all select event_id, 'process', process_key from keyed where process_key <> ''",
    "explain_alert": f"{_REASONED} select event_id, concat(decision, ' at confidence ', printf('%.6f', confidence), '; classified ', attack_class, '; local ', printf('%.6f', score), ', segment trend ', printf('%.6f', trend), ', past anomalies ', printf('%.6f', history), ', drift ', printf('%.6f', drift), case when len(rules) > 0 then concat('; met rules ', array_to_string(rules, ', ')) else '' end, case when false_positive then '; suppressed as a likely false positive' else '' end) as explanation from judged",
    "learning_mode": f"{_A} select event_id, case when decision in ('Block', 'Escalate') then 'Alert' else decision end as decision from alerts",
    "default_fill": f"with {t.LOGS_SQL} select event_id, type, coalesce(severity, 'info') as severity, coalesce(message, '') as message from logs",
    "last_seen_human": f"{_F} select event_id, case when m < 1 then 'just now' when m < 60 then concat(m, ' minutes ago') else concat(m // 60, 'h ', m % 60, 'm ago') end as ago from (select event_id, cast(floor((1706659200000000 - ts_us) / 1000000.0::double / 600 / 60) as bigint) as m from flows)",
    "drift_series": f"select vec_id, round(sqrt({_DOT.format('e', 'e')}), 6) as drift, round(abs(e[1]), 6) as history, 0.6::double as alert_threshold, 0.35::double as gate_threshold, round({_DOT.format('e', 'e')} * 0.25, 6) as baseline_energy from ({_EMB})",
    "priority_filter": f"{_F} select event_id, round(rate_hz, 6) as rate_hz from flows where rate_hz > 5000",
    **{f"spec_{n}": f"with {t.FLOWS_SQL} select * exclude (pos) from ({_spec_select(n)})" for n in SPEC_SQL},
    "fuse_consensus": f"with {FOUND_SQL} select event_id, attack_class, confidence, decision, details from consensus",
    "fuse_registered": f"with {FOUND_SQL}, sure as (select event_id, attack_class from found where validated and confidence > 0.7 union all select event_id, 'BulkTransfer' from flows where bytes_out > 20000) select f.event_id, cast(count(attack_class) as integer) as n, coalesce(string_agg(attack_class, '+' order by attack_class), '') as classes from flows f left join sure s using (event_id) group by f.event_id",
    "fuse_priority": f"with {FOUND_SQL} select c.event_id, coalesce(t.g.c, attack_class) as attack_class, coalesce(t.g.f, confidence) as confidence, coalesce(t.g.d, decision) as decision, case when t.g is not null then concat('critical finding ', t.g.c, ': ', t.g.t) else details end as details from consensus c left join trigger t using (event_id)",
    "specialist_boost": f"with {FOUND_SQL}, {t.SIGNALS_SQL.split('from b), ', 1)[1]}, {REASON_SQL}, judged as (select event_id, confidence, case when confidence < 0.2 then 'Ignore' else {DECIDE.format('confidence')} end as decision, {CLASS_SQL.format('confidence')} as attack_class from reasoned), raised as (select j.*, b.b.c as spec, coalesce(confidence > 0 and b.b.f > 0.3, false) as hit, least(1, confidence + coalesce(b.b.f, 0) * 0.5) as conf2 from judged j left join best b using (event_id)) select event_id, case when hit then spec else attack_class end as attack_class, round(case when hit then conf2 else confidence end, 6) as confidence, case when hit then {DECIDE.format('conf2')} else decision end as decision from raised",
    "scalar_math": f"{_F} select event_id, round(least(10, greatest(0, x)), 6) as clamped, round(bytes_in / (65535 + 1e-9), 6) as normalized, round(case when x > 20 then x else ln(1 + exp(x)) end, 6) as softplus, round(exp(-rate_hz / 600), 6) as decay from (select *, entropy * 30 - 5 as x from flows)",
    "scalar_text": "select doc_id, upper(trim(source)) as upper_source, replace(text, '\"', '\"\"') as quoted, text ilike '%the%' as has_the, sha256(text) as sha from documents",
    "scalar_time": f"{_F} select event_id, case when k = 99 then 0 else (ts_us // 1000000) * 1000000 - case when k % 3 = 1 then 7200000000 else 0 end end as parsed_us, ts_us - ts_us % 3600000000 as hour_us, strftime(ts, '%Y-%m') as month from flows",
    "signature_match": f"with e as ({_EMB}), dims as (select label, unnest(e) as v, generate_subscripts(e, 1) as i from e), means as (select label, i, avg(v) as m from dims group by all), sigs as (select label as signature, list(m order by i) as s from means group by label), pairs as (select vec_id, signature, {_DOT.format('e', 's')} / (sqrt({_DOT.format('e', 'e')} + 1e-9) * sqrt({_DOT.format('s', 's')} + 1e-9)) as cosine from e, sigs) select vec_id, arg_max(signature, cosine) as signature, round(max(cosine), 6) as cosine from pairs group by vec_id",
    "attention_score": "with a as (select vec_id, list_transform(embedding, lambda x: x::double * 4) as e from embeddings), p as (select vec_id, list_transform([" + ", ".join(_DOT.format("e", x) for x in ("e", "list_reverse(e)", "list_transform(e, lambda x: x * x)", "list_transform(e, lambda x: -x)")) + "], lambda d: d / 8) as d from a), w as (select vec_id, d, list_transform(d, lambda x: exp(x - list_max(d))) as ex from p), s as (select vec_id, list_sum(list_transform(list_zip(ex, d), lambda q: q[1] * q[2])) / (list_sum(ex) + 1e-9) as sim from w) select vec_id, round(greatest(-1, least(1, sim)), 6) as similarity, round(0.05 * greatest(0, least(1, sim)), 6) as boost from s",
}
