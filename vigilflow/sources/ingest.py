"""Batches pushed by sensors as JSON: alerts, logs, traffic events, metrics and heartbeats.

Each reader takes a DataFrame with one JSON text per row, keeps batches of known devices with the
right key, and returns one row per item. Unreadable times become `now`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators import joins
from ..operators.salted import salted_join

# Item fields of each batch kind.
ALERT = ("time string, decision string, severity string, confidence double, source_ip string, dest_ip string,"
         " source_port int, dest_port int, protocol string, attack_class string, anomaly_score double,"
         " ae_score double, explanation string")
LOG = ("time string, type string, protocol string, src_ip string, src_port int, dst_ip string, dst_port int,"
       " severity string, message string")
EVENT = ("time string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, bytes long,"
         " event_type string, metadata map<string,string>")
METRIC = ("time string, events_per_sec double, alerts_per_sec double, blocks_per_sec double, avg_latency_us double,"
          " p99_latency_us double, drift_score double, memory_usage_pct double, cpu_usage_pct double, online_updates long")


def _text(c: Column, default: Column | str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default) if isinstance(default, str) else default).otherwise(c)


def _batches(df: DataFrame, devices: DataFrame, body: str, json: str) -> DataFrame:
    """Parsed batches of authenticated devices, with the device's tenant and name."""
    parsed = df.withColumn("_b", F.from_json(json, f"device_id string, api_key string, {body}"))
    parsed = parsed.select("_b.*", F.xxhash64(json).alias("_row")).withColumnRenamed("device_id", "device")
    parsed = parsed.withColumn("api_key", F.coalesce("api_key", F.lit("")))
    known = joins.authenticate(parsed, devices, "_row")
    names = devices.select("device", "tenant", F.col("name").alias("device_name"))
    return salted_join(known, names, ["device"], "_row", "inner").drop("api_key", "_row")


def _items(df, devices, kind: str, fields: str, json: str, now_us: int) -> DataFrame:
    rows = _batches(df, devices, f"{kind} array<struct<{_struct(fields)}>>", json)
    each = rows.select("device", "tenant", "device_name", F.explode(kind).alias("i"))
    return each.select("device", "tenant", "device_name", "i.*").withColumn(
        "ts_us", times.parse_iso_us(F.col("time"), F.lit(now_us))).drop("time")


def _struct(fields: str) -> str:
    """Column list as the inside of a struct type."""
    return ",".join(re.sub(r"^(\w+) ", r"\1:", part.strip()) for part in re.split(r",(?![^<]*>)", fields))


def ingest_alerts(df: DataFrame, devices: DataFrame, now_us: int, json: str = "value") -> DataFrame:
    return _items(df, devices, "alerts", ALERT, json, now_us)


def alert_logs(alerts: DataFrame) -> DataFrame:
    """The log row that accompanies each stored alert."""
    message = _text(F.col("explanation"), _text(F.col("attack_class"), "IDS alert"))
    return alerts.select(
        "device", "tenant", "device_name", "ts_us", F.lit("Alert").alias("type"), "protocol",
        F.col("source_ip").alias("src_ip"), F.col("source_port").alias("src_port"),
        F.col("dest_ip").alias("dst_ip"), F.col("dest_port").alias("dst_port"), "severity", message.alias("message"))


def ingest_logs(df: DataFrame, devices: DataFrame, now_us: int, json: str = "value") -> DataFrame:
    rows = _items(df, devices, "logs", LOG, json, now_us)
    return rows.withColumns({"type": _text(F.col("type"), "System"), "severity": _text(F.col("severity"), "info")})


def ingest_events(df: DataFrame, devices: DataFrame, now_us: int, json: str = "value") -> DataFrame:
    rows = _items(df, devices, "events", EVENT, json, now_us)
    return rows.withColumns({
        "protocol": F.upper(F.coalesce("protocol", F.lit(""))),
        "bytes": F.greatest(F.lit(0).cast("long"), F.coalesce("bytes", F.lit(0))),
        "event_type": _text(F.col("event_type"), "network")})


def event_logs(events: DataFrame) -> DataFrame:
    message = F.concat(F.col("event_type"), F.lit(" bytes="), F.col("bytes").cast("string"))
    return events.select(
        "device", "tenant", "device_name", "ts_us", F.lit("Network").alias("type"), "protocol", "src_ip", "src_port",
        "dst_ip", "dst_port", F.lit("info").alias("severity"), message.alias("message"))


LOG_COLUMNS = ("device", "tenant", "device_name", "ts_us", "type", "protocol", "src_ip", "src_port",
               "dst_ip", "dst_port", "severity", "message")


def unified_log(alerts: DataFrame, events: DataFrame, logs: DataFrame) -> DataFrame:
    """Alert, network and system rows as one log."""
    return alert_logs(alerts).unionByName(event_logs(events)).unionByName(logs.select(*LOG_COLUMNS))


def ingest_metrics(df: DataFrame, devices: DataFrame, now_us: int, json: str = "value") -> DataFrame:
    rows = _batches(df, devices, METRIC, json)
    return rows.withColumn("ts_us", times.parse_iso_us(F.col("time"), F.lit(now_us))).drop("time")


def latest_heartbeat(beats: DataFrame) -> DataFrame:
    """Last sighting per device, with the newest version and address that were not empty."""
    newest = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ts_us")))
    return beats.groupBy("device").agg(
        F.max("ts_us").alias("last_seen_us"), newest("version").alias("version"), newest("ip").alias("ip"))
