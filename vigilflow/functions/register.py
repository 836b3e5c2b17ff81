"""The scalar operators as SQL functions and the tables as views, for use from `spark.sql`."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..params import FusionWeights, GateWeights, Thresholds

T, G, W = Thresholds(), GateWeights(), FusionWeights()

# name: (arguments, result, expression); plain SQL, so the optimizer sees through every call
FUNCTIONS = {
    "score_to_decision": (
        "score DOUBLE", "STRING",
        f"CASE WHEN score < {T.ignore}D THEN 'Ignore' WHEN score < {T.log}D THEN 'Log' WHEN score < {T.alert}D THEN 'Alert'"
        f" WHEN score < {T.block}D THEN 'Block' WHEN score >= {T.escalate}D THEN 'Escalate' ELSE 'Block' END"),
    "alert_severity": (
        "confidence DOUBLE", "STRING",
        "CASE WHEN confidence > 0.9D THEN 'critical' WHEN confidence > 0.7D THEN 'high'"
        " WHEN confidence > 0.5D THEN 'medium' ELSE 'low' END"),
    "is_benign_label": (
        "label STRING", "BOOLEAN",
        "lower(label) LIKE '%benign%' OR lower(label) LIKE '%normal%' OR lower(label) IN ('0', '-', '')"),
    "protocol_name": (
        "number INT", "STRING",
        "CASE number WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 58 THEN 'ICMPv6' ELSE CAST(number AS STRING) END"),
    "crc32_hex": ("data STRING", "STRING", "lower(hex(crc32(CAST(data AS BINARY))))"),
    "clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, x))"),
    "min_max": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "(x - low) / (high - low + 1e-9D)"),
    "softplus": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 20 THEN x ELSE log1p(exp(x)) END"),
    "vector_dot": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        " / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x) + 1e-9D) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x) + 1e-9D))"),
    "gate_score": (
        "local DOUBLE, trend DOUBLE, history DOUBLE, drift DOUBLE, similarity DOUBLE, ruled BOOLEAN", "DOUBLE",
        f"{G.local}D * local + {G.segment}D * trend + {G.history}D * history + {G.drift}D * greatest(0D, least(1D, drift / 10))"
        f" + {G.retrieval}D * similarity + IF(ruled, {G.rule}D, 0D)"),
    "fuse_score": (
        "local DOUBLE, trend DOUBLE, history DOUBLE, drift DOUBLE, retrieved BOOLEAN, ruled BOOLEAN", "DOUBLE",
        f"greatest(0D, least(1D, {W.local}D * local + {W.segment}D * trend + {W.history}D * history"
        f" + {W.drift}D * greatest(0D, least(1D, drift / 10)) + IF(retrieved, {W.retrieval}D, 0D) + IF(ruled, {W.rule}D, 0D)))"),
}


def register_functions(spark: SparkSession) -> None:
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """The security tables as temporary views: flows, alerts, logs, traffic, devices and so on."""
    from ..sources import tables

    for name in ("flows", "alerts", "logs", "traffic", "devices", "subscriptions", "metrics", "rules", "labelled", "signals"):
        getattr(tables, name)(spark, sf_dir).createOrReplaceTempView(name)
