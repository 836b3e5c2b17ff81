"""The given tables seen as security data: flows, alerts, logs, devices, rules and so on.

Timestamps become microseconds since the epoch once, here, so no later step depends on the
session time zone and every window runs over a long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..params import PLANS, Thresholds

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow event per row of `events`."""
    return to_flows(table(spark, sf_dir, "events"))


def stream_events(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The events of a folder as a stream of files."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def to_flows(events: DataFrame) -> DataFrame:
    """The flow view of an event table or stream."""
    b = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("ts_us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    user, k, value = F.col("user_id"), F.col("k"), F.col("value")
    iat = (k % 10) * F.lit(0.0005)
    return b.select(
        "event_id", "ts", "ts_us", "k",
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."),
                 (user % 256).cast("string")).alias("source"),
        F.concat(F.lit("192.168.0."), (k % 25).cast("string")).alias("destination"),
        F.concat(F.lit("tenant_"), (user % 5).cast("string")).alias("tenant"),
        F.concat(F.lit("dev_"), (user % 20).cast("string")).alias("device"),
        F.expr(
            "case event_type when 'view' then 'net' when 'click' then 'log' when 'signup' then 'proc'"
            " when 'error' then 'auth' else 'file' end"
        ).alias("type"),
        F.floor(value * 1000).cast("long").alias("bytes_in"),
        F.floor(value * 300).cast("long").alias("bytes_out"),
        (k + 10000).alias("port_src"),
        F.expr(
            "case k % 6 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 8080"
            " when 4 then 445 else 21 end"
        ).alias("port_dst"),
        F.expr("case k % 4 when 0 then 6 when 1 then 6 when 2 then 17 else 1 end").alias("protocol"),
        F.expr(
            "case k % 5 when 0 then 2 when 1 then 16 when 2 then 4 when 3 then 1 else 18 end"
        ).alias("flags"),
        (k.cast("double") / 100).alias("entropy"),
        (value * 20).alias("rate_hz"),
        F.floor(value * 4).cast("long").alias("packets_total"),
        (k * 10 + 40).cast("double").alias("packet_size_mean"),
        iat.alias("iat_mean"),
        ((k % 7) * iat).alias("iat_std"),
        (k % 12).alias("syn_count"), (k % 5).alias("ack_count"), (k % 20).alias("fin_count"),
        (k % 9).cast("double").alias("down_up_ratio"),
        F.floor(value * 100).cast("long").alias("bytes_fwd"),
        (F.floor(value * 100).cast("long") * (k % 8)).alias("bytes_bwd"),
        F.least(value / 200, F.lit(1.0)).alias("score"),
    )


# The same adapter as SQL text, for checking results elsewhere.
FLOWS_SQL = """flows as (
  with b as (
    select event_id, ts, epoch_us(ts) as ts_us, user_id, event_type, value,
      cast(json_extract_string(props, '$.k') as bigint) as k
    from events)
  select event_id, ts, ts_us, k,
    concat('10.0.', cast(user_id // 256 as varchar), '.', cast(user_id % 256 as varchar)) as source,
    concat('192.168.0.', cast(k % 25 as varchar)) as destination,
    concat('tenant_', cast(user_id % 5 as varchar)) as tenant,
    concat('dev_', cast(user_id % 20 as varchar)) as device,
    case event_type when 'view' then 'net' when 'click' then 'log' when 'signup' then 'proc'
      when 'error' then 'auth' else 'file' end as type,
    cast(floor(value * 1000) as bigint) as bytes_in, cast(floor(value * 300) as bigint) as bytes_out,
    10000 + k as port_src,
    case k % 6 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 8080 when 4 then 445
      else 21 end as port_dst,
    case k % 4 when 0 then 6 when 1 then 6 when 2 then 17 else 1 end as protocol,
    case k % 5 when 0 then 2 when 1 then 16 when 2 then 4 when 3 then 1 else 18 end as flags,
    cast(k as double) / 100 as entropy, value * 20 as rate_hz,
    cast(floor(value * 4) as bigint) as packets_total,
    cast(40 + k * 10 as double) as packet_size_mean,
    (k % 10) * cast(0.0005 as double) as iat_mean,
    (k % 7) * ((k % 10) * cast(0.0005 as double)) as iat_std,
    k % 12 as syn_count, k % 5 as ack_count, k % 20 as fin_count,
    cast(k % 9 as double) as down_up_ratio,
    cast(floor(value * 100) as bigint) as bytes_fwd,
    cast(floor(value * 100) as bigint) * (k % 8) as bytes_bwd,
    least(value / 200, cast(1 as double)) as score
  from b)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows whose decision is not Ignore, with a severity and an attack class."""
    return (
        flows(spark, sf_dir)
        .withColumn("decision", scores.decide(F.col("score"), Thresholds()))
        .filter(F.col("decision") != "Ignore")
        .withColumn("severity", scores.severity(F.col("score")))
        .withColumn(
            "attack_class",
            F.expr(
                "case type when 'net' then 'PortScan' when 'auth' then 'BruteForce/CredentialStuffing'"
                " when 'proc' then 'LateralMovement/Persistence'"
                " when 'file' then 'FileSystemAnomaly/Ransomware' else 'EncryptedC2/Exfiltration' end"
            ),
        )
    )


ALERTS_SQL = FLOWS_SQL + """, alerts as (
  select *, case when score > 0.9 then 'critical' when score > 0.7 then 'high'
      when score > 0.5 then 'medium' else 'low' end as severity,
    case type when 'net' then 'PortScan' when 'auth' then 'BruteForce/CredentialStuffing'
      when 'proc' then 'LateralMovement/Persistence'
      when 'file' then 'FileSystemAnomaly/Ransomware' else 'EncryptedC2/Exfiltration' end as attack_class
  from (select *, case when score < 0.2 then 'Ignore' when score < 0.4 then 'Log'
      when score < 0.6 then 'Alert' when score < 0.85 then 'Block'
      when score >= 0.95 then 'Escalate' else 'Block' end as decision from flows)
  where decision <> 'Ignore')"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the segment, drift, retrieval and rule signals that scoring combines."""
    k = F.col("k")
    part = lambda m, n, d: ((k * m) % n + 1) / F.lit(d)
    return flows(spark, sf_dir).select(
        "*",
        part(7, 100, 101.0).alias("trend"),
        part(13, 100, 103.0).alias("history"),
        part(3, 150, 10.7).alias("drift"),
        part(11, 200, 107.0).alias("similarity"),
        part(17, 100, 101.0).alias("burst"),
        F.col("rate_hz").alias("rate_mean"),
        part(29, 100, 103.0).alias("error_freq"),
        F.col("type").alias("dominant_type"),
        F.when(k % 9 == 0, F.array(F.lit("odd-rate"))).otherwise(
            F.array().cast("array<string>")
        ).alias("rules"),
        F.array(part(11, 200, 107.0), part(5, 100, 109.0)).alias("retrieved"),
    )


SIGNALS_SQL = FLOWS_SQL + """, signals as (
  select *, ((k * 7) % 100 + 1) / 101.0::double as trend,
    ((k * 13) % 100 + 1) / 103.0::double as history,
    ((k * 3) % 150 + 1) / 10.7::double as drift, ((k * 11) % 200 + 1) / 107.0::double as similarity,
    ((k * 17) % 100 + 1) / 101.0::double as burst, rate_hz as rate_mean,
    ((k * 29) % 100 + 1) / 103.0::double as error_freq, type as dominant_type,
    case when k % 9 = 0 then ['odd-rate'] else []::varchar[] end as rules,
    [((k * 11) % 200 + 1) / 107.0::double, ((k * 5) % 100 + 1) / 109.0::double] as retrieved
  from flows)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the ground-truth label used for calibration and evaluation."""
    return flows(spark, sf_dir).withColumn(
        "label",
        F.expr("case when k % 10 = 0 then 'PortScan' when k % 10 = 1 then 'DoS_Hulk' else 'BENIGN' end"),
    )


LABELLED_SQL = FLOWS_SQL + """, labelled as (
  select *, case when k % 10 = 0 then 'PortScan' when k % 10 = 1 then 'DoS_Hulk'
    else 'BENIGN' end as label from flows)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(
        "event_id", "ts_us", "tenant", "device",
        F.expr("case type when 'net' then 'Firewall' when 'log' then 'DNS' when 'proc' then 'HTTP'"
               " when 'auth' then 'System' else 'Alert' end").alias("type"),
        F.expr("case protocol when 6 then 'TCP' when 17 then 'UDP' else 'ICMP' end").alias("protocol"),
        F.col("source").alias("src_ip"), F.col("port_src").alias("src_port"),
        F.col("destination").alias("dst_ip"), F.col("port_dst").alias("dst_port"),
        F.expr("case when k % 7 = 0 then null else 'info' end").alias("severity"),
        F.expr("case when k % 11 = 0 then null else concat('say \"', type, '\" bytes=', bytes_in) end").alias("message"),
    )


LOGS_SQL = FLOWS_SQL + """, logs as (
  select event_id, ts_us, tenant, device,
    case type when 'net' then 'Firewall' when 'log' then 'DNS' when 'proc' then 'HTTP'
      when 'auth' then 'System' else 'Alert' end as type,
    case protocol when 6 then 'TCP' when 17 then 'UDP' else 'ICMP' end as protocol,
    source as src_ip, port_src as src_port, destination as dst_ip, port_dst as dst_port,
    case when k % 7 = 0 then null else 'info' end as severity,
    case when k % 11 = 0 then null else concat('say "', type, '" bytes=', bytes_in) end as message
  from flows)"""


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(
        "event_id", "ts_us", "tenant", "device", F.col("source").alias("src_ip"),
        F.col("destination").alias("dst_ip"), "protocol", F.col("bytes_in").alias("bytes"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per device that ever sent a flow; its tenant, last sighting and key hash."""
    return flows(spark, sf_dir).groupBy("device").agg(
        F.min("tenant").alias("tenant"), F.max("ts_us").alias("last_seen_us")
    ).select(
        "device", "tenant", "last_seen_us",
        F.concat(F.lit("sensor "), "device").alias("name"),
        F.sha2(F.concat(F.lit("key-"), "device"), 256).alias("key_hash"),
    )


DEVICES_SQL = """, devices as (
  select device, min(tenant) as tenant, max(ts_us) as last_seen_us,
    concat('sensor ', device) as name, sha256(concat('key-', device)) as key_hash
  from flows group by device)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan per tenant: tenants 0-2 free, 3 pro, 4 enterprise."""
    plan = F.expr("case tenant when 'tenant_3' then 'pro' when 'tenant_4' then 'enterprise' else 'free' end")
    pick = lambda i: F.create_map(*[F.lit(x) for n, v in PLANS.items() for x in (n, v[i])])
    return (
        flows(spark, sf_dir).select("tenant").distinct().withColumn("plan", plan)
        .select("tenant", "plan",
                pick(0)[F.col("plan")].alias("sensors"),
                pick(1)[F.col("plan")].alias("retention_days"),
                pick(2)[F.col("plan")].cast("long").alias("events_per_month"))
    )


SUBSCRIPTIONS_SQL = """, subscriptions as (
  select tenant, plan,
    case plan when 'free' then 1 when 'pro' then 5 else 999 end as sensors,
    case plan when 'free' then 7 when 'pro' then 30 else 365 end as retention_days,
    cast(case plan when 'free' then 1000000 when 'pro' then 10000000 else 999999999 end as bigint)
      as events_per_month
  from (select distinct tenant, case tenant when 'tenant_3' then 'pro'
    when 'tenant_4' then 'enterprise' else 'free' end as plan from flows))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters per device, stamped with the last event of the day."""
    return flows(spark, sf_dir).groupBy(
        "tenant", "device", F.expr("ts_us div 86400000000").alias("day")
    ).agg(
        F.max("ts_us").alias("ts_us"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("score") >= 0.4).alias("alerts"),
        F.count_if(F.col("score") >= 0.6).alias("blocks"),
        F.sum("bytes_in").alias("bytes"),
    )


METRICS_SQL = """, metrics as (
  select tenant, device, ts_us // 86400000000 as day, max(ts_us) as ts_us, count(*) as events,
    count(*) filter (where score >= 0.4) as alerts, count(*) filter (where score >= 0.6) as blocks,
    cast(sum(bytes_in) as bigint) as bytes
  from flows group by all)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection rule per supplier: threshold, address pattern and state follow from its key."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        (key + 1_000_000).alias("sid"),
        F.concat(F.lit("rule-"), key.cast("string")).alias("name"),
        F.expr("case s_suppkey % 3 when 0 then 'Web Attack' when 1 then 'Scan' else 'Malware' end").alias("category"),
        F.expr("case s_suppkey % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high'"
               " else 'critical' end").alias("severity"),
        (key % 5 != 0).alias("enabled"),
        (F.lit(0.6) + (key % 40) / 100.0).alias("threshold"),
        F.when(key % 10 == 1, F.concat(F.lit("10.0.0."), (key % 150).cast("string")))
        .otherwise(F.lit("")).alias("pattern"),
    )


RULES_SQL = """rules as (
  select s_suppkey as id, s_suppkey + 1000000 as sid,
    concat('rule-', cast(s_suppkey as varchar)) as name,
    case s_suppkey % 3 when 0 then 'Web Attack' when 1 then 'Scan' else 'Malware' end as category,
    case s_suppkey % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high'
      else 'critical' end as severity,
    s_suppkey % 5 <> 0 as enabled, 0.6::double + (s_suppkey % 40) / 100.0::double as threshold,
    case when s_suppkey % 10 = 1 then concat('10.0.0.', cast(s_suppkey % 150 as varchar))
      else '' end as pattern
  from supplier)"""
