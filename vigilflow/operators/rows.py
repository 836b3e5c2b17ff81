"""Row-level operators that filter, annotate or fan out events without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..params import EVENT_TYPES, LARGE_TRAFFIC_BYTES, MemoryParams, RoutingParams


def is_valid() -> Column:
    """A known type, a source, and finite entropy and rate."""
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != float("inf"))
    return (
        F.coalesce(F.col("source") != "", F.lit(False))
        & F.coalesce(F.col("type").isin(*EVENT_TYPES[:-1]), F.lit(False))
        & finite("entropy") & finite("rate_hz")
    )


def validate(ev: DataFrame) -> DataFrame:
    return ev.filter(is_valid())


def quarantine(ev: DataFrame) -> DataFrame:
    """The rows `validate` rejects."""
    return ev.filter(~is_valid())


def large_traffic(ev: DataFrame, limit: int = LARGE_TRAFFIC_BYTES) -> DataFrame:
    """Fallback alert for events that move more than `limit` bytes."""
    big = ev.filter(F.col("bytes") > limit)
    return big.select(
        "*", F.lit("alert").alias("decision"), F.lit("high").alias("severity"),
        F.lit(0.9).alias("confidence"), F.lit("large_traffic").alias("attack_class"),
        F.lit(1.0).alias("anomaly_score"),
        F.concat(F.lit("Large traffic volume: "), F.col("bytes").cast("string"), F.lit(" bytes")).alias("explanation"),
    )


def filter_alerts(
    al: DataFrame, *, time_from_us: int | None = None, time_to_us: int | None = None, **equal: str | None
) -> DataFrame:
    """Equality on any column given, and an inclusive time range; None means no condition."""
    for column, value in equal.items():
        if value is not None:
            al = al.filter(F.col(column) == value)
    if time_from_us is not None:
        al = al.filter(F.col("ts_us") >= time_from_us)
    if time_to_us is not None:
        al = al.filter(F.col("ts_us") <= time_to_us)
    return al


def _like(text: str) -> str:
    return f"%{text}%"


def search_logs(
    lg: DataFrame, search: str = "", type: str = "", protocol: str = "", severity: str = ""
) -> DataFrame:
    for column, value in (("type", type), ("protocol", protocol), ("severity", severity)):
        if value:
            lg = lg.filter(F.col(column) == value)
    if search:
        p = _like(search)
        lg = lg.filter(F.col("src_ip").ilike(p) | F.col("dst_ip").ilike(p) | F.col("message").ilike(p))
    return lg


def filter_rules(
    rules: DataFrame, search: str = "", category: str = "", severity: str = "", status: str = ""
) -> DataFrame:
    if search:
        rules = rules.filter(F.col("name").ilike(_like(search)) | F.col("category").ilike(_like(search)))
    if category:
        rules = rules.filter(F.col("category") == category)
    if severity:
        rules = rules.filter(F.col("severity") == severity)
    if status in ("Enabled", "Disabled"):
        rules = rules.filter(F.col("enabled") == (status == "Enabled"))
    return rules.orderBy("sid")


def should_write(p: MemoryParams = MemoryParams(), decision: str = "decision") -> Column:
    """Whether a scored event is remembered."""
    keep = (
        (F.col("score") >= p.write_gate) | scores.has_rule() | F.col(decision).isin("Block", "Escalate")
    )
    return keep | (F.col("drift") >= p.drift_gate) if p.write_on_high_drift else keep


def scope_keys(ev: DataFrame) -> DataFrame:
    """ip and host from the addresses; user, session and process from the metadata map."""
    get = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    return ev.select(
        "*", F.col("source").alias("ip"), F.col("destination").alias("host"),
        get("user").alias("user"), get("session").alias("session"), get("proc").alias("process"),
    )


def memory_fanout(records: DataFrame, p: MemoryParams = MemoryParams()) -> DataFrame:
    """One row per scope a record belongs to; global records carry an empty key."""
    one = lambda scope, key, cond: F.when(
        cond, F.struct(F.lit(scope).alias("scope"), key.alias("scope_key")))
    c = F.col
    scopes = F.array(
        one("ip", c("ip"), F.lit(True)),
        one("user", c("user"), c("user") != ""),
        one("host", c("host"), (c("score") >= p.write_gate) & (c("host") != "")),
        one("global", F.lit(""), c("score") >= p.force_gate),
        one("session", c("session"), c("session") != ""),
        one("process", c("process"), c("process") != ""),
    )
    return records.withColumn("_s", F.explode(F.filter(scopes, lambda s: s.isNotNull()))).select(
        *records.columns, "_s.*"
    )


def routing_flag(p: RoutingParams = RoutingParams()) -> Column:
    """force, skip or pass for a flushed segment numbered `segment_no` (1-based) of its scope."""
    return (
        F.when(F.col("score") > p.force_anomaly, "force")
        .when((F.col("trend") < p.skip_threshold) & (F.col("segment_no") < p.min_segments), "skip")
        .otherwise("pass")
    )


def priority_filter(ev: DataFrame, keep_above: float = 0.6, fast_hz: float = 5000.0) -> DataFrame:
    """Keep events whose quick estimate (0.7 above `fast_hz`, else 0.1) reaches `keep_above`."""
    return ev.filter(F.when(F.col("rate_hz") > fast_hz, 0.7).otherwise(0.1) >= keep_above)


def fill_log_defaults(lg: DataFrame) -> DataFrame:
    text = {"type": "", "protocol": "", "src_ip": "", "dst_ip": "", "message": "", "severity": "info"}
    filled = [
        F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(d)).otherwise(F.col(n)).alias(n)
        if n in text else
        F.coalesce(F.col(n), F.lit(0)).alias(n) if n in ("src_port", "dst_port") else F.col(n)
        for n, d in ((c, text.get(c)) for c in lg.columns)
    ]
    return lg.select(*filled)
