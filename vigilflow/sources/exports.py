"""Files written for other tools: alert JSON lines, log CSV, rule sets and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboards
from ..operators.sliced import running_sums
from ..params import FIRST_RULE_SID

RULE_FIELDS = ("sid", "name", "category", "severity", "enabled")
LOG_HEADER = "time,type,protocol,src_ip,src_port,dst_ip,dst_port,severity,message,device"


def iso_time(ts_us: Column) -> Column:
    """UTC time as yyyy-mm-ddThh:mm:ssZ, whatever the session time zone."""
    wall = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(ts_us / 1_000_000))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def alert_json(al: DataFrame) -> DataFrame:
    """One JSON text per alert in column `value`."""
    return al.select(F.to_json(F.struct(
        iso_time(F.col("ts_us")).alias("timestamp"), F.col("event_id").alias("alert_id"),
        F.lower("decision").alias("severity"), F.col("source").alias("src"), F.col("destination").alias("dst"),
        F.col("attack_class").alias("class"), F.round("score", 6).alias("confidence"),
    )).alias("value"))


def write_alert_json(al: DataFrame, path: str) -> None:
    alert_json(al).write.mode("overwrite").text(path)


def log_lines(lg: DataFrame, limit: int = 10_000) -> DataFrame:
    """Newest logs as CSV lines, newest first; the message is quoted with doubled quotes."""
    top = dashboards.newest(lg, limit)
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    message = F.concat(F.lit('"'), F.replace(text("message"), F.lit('"'), F.lit('""')), F.lit('"'))
    return top.select(F.concat_ws(
        ",", iso_time(F.col("ts_us")), text("type"), text("protocol"), text("src_ip"), text("src_port", "0"),
        text("dst_ip"), text("dst_port", "0"), text("severity", "info"), message, text("device")).alias("value"))


def export_logs(lg: DataFrame, path: str, limit: int = 10_000) -> None:
    """Write the export with its header line; the newest rows are few enough for one file."""
    head = lg.sparkSession.createDataFrame([(LOG_HEADER,)], "value string")
    head.unionByName(log_lines(lg, limit)).coalesce(1).write.mode("overwrite").text(path)


def export_rules(rules: DataFrame, path: str) -> None:
    rules.select(*RULE_FIELDS).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sid long, name string, category string, severity string, enabled boolean").json(path)


def import_rules(new: DataFrame, existing: DataFrame, position: str = "position") -> DataFrame:
    """Number new rules after the highest sid in use, in the order they came."""
    top = existing.agg(F.coalesce(F.max("sid"), F.lit(FIRST_RULE_SID)).alias("_top"))
    numbered = running_sums(new, [], {"_no": F.lit(1)}, (position,))
    return numbered.join(F.broadcast(top), F.lit(True)).withColumn("sid", F.col("_top") + F.col("_no")).drop("_top", "_no")


def telemetry_json(ev: DataFrame, key: str) -> DataFrame:
    """Counters per shard or tenant as JSON texts; where events have them, also latency (`latency_us`: mean and
    peak), drift (`drift`: mean and peak) and faults (`fault`: how many).
    """
    of = lambda d: F.count_if(F.col("decision") == d)
    facts = [F.count(F.lit(1)).alias("events_total"), of("Alert").alias("alerts_total"), of("Block").alias("blocks_total")]
    for c in ("latency_us", "drift"):
        if c in ev.columns:
            facts += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_peak")]
    if "fault" in ev.columns:
        facts.append(F.count_if("fault").alias("faults_total"))
    totals = ev.groupBy(key).agg(*facts)
    return totals.select(key, F.to_json(F.struct(*[c for c in totals.columns if c != key])).alias("value"))


def export_telemetry(ev: DataFrame, key: str, path: str) -> None:
    telemetry_json(ev, key).write.mode("overwrite").json(path)
