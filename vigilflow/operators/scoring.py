"""Stateful scores per source: rolling statistics, z-scores, embeddings, baselines, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..params import (
    BASELINE_ALPHA, EMBEDDING_DIM, AdaptiveParams, DecisionParams, FlushParams, RoutingParams, SsmParams,
)
from . import steps
from .folds import KeyPlan, fold_by_key
from .sliced import running_sums

FEATURES = steps.FEATURES


def _schema(df: DataFrame, extra: str) -> str:
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {extra}"


def rolling_stats(ev: DataFrame, key: list[str], plan: KeyPlan | None = None, follows: bool = False) -> DataFrame:
    """Running mean and variance of the six features, before (`pm_`, `pv_`) and after each event (`follows`: see `fold_by_key`)."""
    named = ev.withColumn("bytes", F.col("bytes_in") + F.col("bytes_out"))
    extra = ", ".join(f"{p}{f} double" for p in ("m_", "v_", "pm_", "pv_") for f in FEATURES)
    return fold_by_key(named, key, steps.rolling_step, _schema(named, extra + ", seen int"), plan=plan, follows=follows)


def zscore_anomaly(stats: DataFrame, entropy: Column, burst: Column, min_rows: int = 4) -> DataFrame:
    """Score from the features' z-scores against the updated statistics, plus indicators."""
    z = [
        F.abs(F.col(f) - F.col(f"m_{f}")) / F.sqrt(F.greatest(F.lit(1e-6), F.col(f"v_{f}")))
        for f in FEATURES
    ]
    rms = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]) / len(z))
    raw = F.greatest(rms, F.greatest(*z) * 0.5) + scores.indicator_boost(entropy, burst)
    return stats.withColumn(
        "anomaly", F.when(F.col("seen") < min_rows, 0.0).otherwise(scores.clamp(raw / 5, 0.0, 1.0))
    )


def _digits(text: Column) -> list[Column]:
    """Five 5-bit digits of a text's md5, as numbers in [0, 1]."""
    h = F.md5(text)
    return [
        F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int") % 32 / 31.0 for i in range(5)
    ]


def local_embedding(stats: DataFrame) -> DataFrame:
    """The 64-wide vector of an event. Statistics are those from before it; burst and protocol
    entropy include it. Needs the columns of `rolling_stats` and `windows.local_shape`.
    """
    c = F.col
    unit = lambda col, top: col / (top + 1e-9)
    duration = c("duration") if "duration" in stats.columns else F.lit(0.0)
    head = [
        unit(c("bytes_in"), 65535), unit(c("bytes_out"), 65535), unit(c("port_src"), 65535),
        unit(c("port_dst"), 65535), c("protocol") / 255.0, c("flags") / 255.0,
        scores.clamp(c("entropy"), 0.0, 1.0), scores.clamp(c("rate_hz") / 1000, 0.0, 1.0),
        scores.event_type_ordinal(c("type")) / 8.0, c("burst"), c("protocol_entropy"),
        unit(c("packets_total"), 1000), unit(c("packet_size_mean"), 1500), unit(c("iat_mean"), 10),
        unit(c("syn_count"), 50), unit(duration, 100), unit(c("down_up_ratio"), 10),
    ]
    tail = [c("inter_arrival")] + [c(f"pm_{f}") for f in FEATURES] + [
        F.sqrt(F.greatest(F.lit(0.0), c(f"pv_{f}"))) for f in FEATURES
    ]
    values = head + _digits(c("source")) + _digits(c("destination")) + tail
    values += [F.lit(0.0)] * (EMBEDDING_DIM - len(values))
    return stats.withColumn("embedding", F.array(*[v.cast("double") for v in values]))


# ---- baselines -------------------------------------------------------------------------------

def _weights(df: DataFrame, key: list[str], alpha: float, slice_s: float) -> DataFrame:
    """Each row's share in the final state: alpha (1 - alpha)^(rows of the key after it)."""
    back = df.withColumns({"_nts": -F.col("ts_us"), "_nid": -F.col("event_id")})
    ranked = running_sums(back, key, {"_after": F.lit(1)}, order=("_nts", "_nid"))
    return ranked.withColumn("_w", alpha * F.pow(F.lit(1.0 - alpha), F.col("_after") - 1)).drop("_nts", "_nid", "_after")


def baseline_ewma(
    df: DataFrame, key: list[str], values: list[str], alpha: float, slice_s: float,
    freeze: float = AdaptiveParams().freeze,
) -> DataFrame:
    """Final mean and variance of each value per scope; rows scoring `freeze` or more do not count.

    The recurrence is linear, so its end state is one weighted sum with map-side combining.
    """
    w = F.col("_w")
    kept = _weights(df.filter(F.col("score") < freeze), key, alpha, slice_s)
    sums = [F.sum(w * F.col(v)).alias(f"{v}_mean") for v in values]
    squares = [F.sum(w * F.col(v) * F.col(v)).alias(f"_{v}_sq") for v in values]
    out = kept.groupBy(*key).agg(*sums, *squares, F.count(F.lit(1)).alias("events"))
    variances = [
        F.greatest(F.lit(0.0), F.col(f"_{v}_sq") - F.col(f"{v}_mean") * F.col(f"{v}_mean")).alias(f"{v}_var")
        for v in values
    ]
    return out.select(*key, "events", *[f"{v}_mean" for v in values], *variances)


def embedding_baseline(df: DataFrame, key: list[str], vector: str, alpha: float, slice_s: float) -> DataFrame:
    """Final mean and variance per scope and dimension of a vector column."""
    weighted = _weights(df, key, alpha, slice_s).select(*key, "_w", F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    out = weighted.groupBy(*key, "dim").agg(
        F.sum(F.col("_w") * x).alias("mean"), F.sum(F.col("_w") * x * x).alias("_sq")
    )
    return out.withColumn("variance", F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean") * F.col("mean"))).drop("_sq")


def scope_baselines(
    ev: DataFrame, scopes: dict[str, str], values: list[str], slice_s: float
) -> DataFrame:
    """Baselines of several scopes in one table (scope, scope_key, ...); learning rate per scope."""
    out = None
    for scope, column in scopes.items():
        part = baseline_ewma(ev, [column], values, BASELINE_ALPHA[scope], slice_s)
        part = part.withColumnRenamed(column, "scope_key").withColumn("scope", F.lit(scope))
        out = part if out is None else out.unionByName(part)
    whole = baseline_ewma(ev, [], values, BASELINE_ALPHA["global"], slice_s)
    return out.unionByName(whole.withColumns({"scope": F.lit("global"), "scope_key": F.lit("")}))


def running_baseline(
    df: DataFrame, key: list[str], value: str, alpha: float, freeze: float | None = None,
    plan: KeyPlan | None = None,
) -> DataFrame:
    """Mean and variance of a value as they stand after each row."""
    step = steps.EwmaStep(value, alpha, freeze)
    return fold_by_key(df, key, step, _schema(df, "mean double, var double"), plan=plan)


def adaptive_thresholds(mean: Column, variance: Column, p: AdaptiveParams = AdaptiveParams()) -> dict[str, Column]:
    """Decision thresholds that follow a baseline; each keeps its distance to the next."""
    sd = F.sqrt(F.greatest(F.lit(1e-6), variance))
    alert = scores.clamp(mean + p.k_alert * sd, p.alert_min, p.alert_max)
    block = F.greatest(alert + 0.05, F.least(F.lit(p.threshold_max), alert + p.k_block * sd))
    log = F.greatest(F.lit(p.threshold_min), F.least(alert - 0.05, alert * 0.6))
    ignore = F.greatest(F.lit(p.threshold_min), F.least(log - 0.05, log * 0.5))
    return {"ignore": ignore, "log": log, "alert": alert, "block": block}


def scale_anomaly(score: Column, mean: Column, variance: Column) -> Column:
    return scores.clamp((score - mean) / F.sqrt(F.greatest(F.lit(1e-6), variance)), 0.0, 1.0)


def adaptive_decay(rate: Column, baseline_rate: Column, slow: float, fast: float) -> Column:
    return F.when(rate > baseline_rate, slow).otherwise(fast)


def adaptive_promote(anomaly: Column, base: float, k: float) -> Column:
    return scores.clamp(base + k * anomaly, 0.20, 0.90)


def adaptive_gate(noise: Column, p: AdaptiveParams = AdaptiveParams()) -> Column:
    return scores.clamp(p.base_gate + p.gate_k * noise, 0.20, 0.80)


def threshold_shifts(
    df: DataFrame, key: list[str], columns: list[str], start: list[float], plan: KeyPlan | None = None
) -> DataFrame:
    """Flag rows where a value has moved more than the step since it was last flagged."""
    extra = ", ".join(f"{c}_shift boolean" for c in columns)
    return fold_by_key(df, key, steps.ShiftStep(columns, start), _schema(df, extra), plan=plan)


# ---- segments and hierarchy ------------------------------------------------------------------

def segment_flush(ev: DataFrame, key: list[str], p: FlushParams = FlushParams(), plan: KeyPlan | None = None, follows: bool = False) -> DataFrame:
    """Number each event's segment and mark the event that flushes it (`follows`: see `fold_by_key`)."""
    return fold_by_key(
        ev, key, steps.SegmentStep(p), _schema(ev, "segment_id long, flushed boolean"), plan=plan, follows=follows
    )


def segment_summary(
    segmented: DataFrame, key: list[str], carry: list[str] = (), plan: KeyPlan | None = None, follows: bool = False,
) -> DataFrame:
    """One row per flushed segment; the commonest type wins, the lower ordinal on a tie.

    `carry` columns are taken from the flushing event. With `follows` (see `fold_by_key`) and no hot keys, segments are
    summed up where their rows lie.
    """
    by = [*key, "segment_id"]
    if follows and plan.later is None:
        kinds = {f.name: f.dataType.simpleString() for f in segmented.schema.fields}
        typed = segmented.select(*dict.fromkeys([*by, "ts_us", "event_id", "type", "score", "rate_hz", "flushed", *carry])).withColumn(
            "_ord", scores.event_type_ordinal(F.col("type")))
        own = lambda names: [f"{c} {kinds[c]}" for c in names]
        schema = ", ".join([*own(by), "events long, trend double, rate_mean double, error_freq double, dominant_type string", *own(["ts_us", "event_id"]),
                            f"last_score {kinds['score']}", *own(carry)])
        return fold_by_key(typed, key, steps.SummaryStep(), schema, plan=plan, follows=True)
    per_type = segmented.withColumn("_ord", scores.event_type_ordinal(F.col("type"))).groupBy(*by, "_ord").agg(
        F.first("type").alias("type"), F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_s"),
        F.sum("rate_hz").alias("_r"), F.count_if(F.col("score") > 0.5).alias("_e"),
        F.max(F.when(F.col("flushed"), F.struct("ts_us", "event_id", "score", *carry))).alias("_end"),
    )
    n = F.sum("_n")
    out = per_type.groupBy(*by).agg(
        n.alias("events"), (F.sum("_s") / n).alias("trend"), (F.sum("_r") / n).alias("rate_mean"),
        (F.sum("_e") / n).alias("error_freq"),
        F.max_by("type", F.struct("_n", -F.col("_ord"))).alias("dominant_type"), F.max("_end").alias("_end"),
    )
    return out.filter(F.col("_end").isNotNull()).select(
        *by, "events", "trend", "rate_mean", "error_freq", "dominant_type",
        F.col("_end.ts_us").alias("ts_us"), F.col("_end.event_id").alias("event_id"),
        F.col("_end.score").alias("last_score"), *[F.col(f"_end.{c}").alias(c) for c in carry],
    )


def ssm_scan(
    df: DataFrame, key: list[str], vector: str, order: list[str], p: SsmParams = SsmParams(),
    plan: KeyPlan | None = None, follows: bool = False,
) -> DataFrame:
    """Selective state-space recurrence over a key's vectors; output vector `y` (`follows`: see `fold_by_key`)."""
    return fold_by_key(df, key, steps.SsmStep(vector, p), _schema(df, "y array<double>"), order=order, plan=plan, follows=follows)


def hierarchy_drift(
    segments: DataFrame, scope: list[str], p: RoutingParams = RoutingParams(), ssm: SsmParams = SsmParams(),
    plan: KeyPlan | None = None,
) -> DataFrame:
    """Route, drift and anomaly history of each segment of a scope, from its `state` vector."""
    schema = _schema(segments, "route string, drift double, history double")
    return fold_by_key(segments, scope, steps.HierarchyStep(p, ssm), schema, plan=plan)


def anomaly_history(segments: DataFrame, scope: list[str], slice_s: float, alpha: float = RoutingParams().history_alpha) -> DataFrame:
    """Final anomaly history per scope: the weighted sum the recurrence ends in."""
    weighted = _weights(segments, scope, alpha, slice_s)
    return weighted.groupBy(*scope).agg(
        F.sum(F.col("_w") * F.col("trend")).alias("history"), F.count(F.lit(1)).alias("segments")
    )


# ---- decisions and admission -----------------------------------------------------------------

def decide_stream(al: DataFrame, p: DecisionParams = DecisionParams(), plan: KeyPlan | None = None) -> DataFrame:
    """Final decision per alert after overrides, hysteresis, cooldown and learning mode; the
    column `final` is null where nothing is emitted.
    """
    return fold_by_key(al, ["source"], steps.DecisionStep(p), _schema(al, "final string"), plan=plan)


def cooldown(df: DataFrame, key: list[str], seconds: float, plan: KeyPlan | None = None) -> DataFrame:
    """Rows that are at least `seconds` after their key's last row kept."""
    return fold_by_key(df, key, steps.CooldownStep(seconds), _schema(df, "")[:-2], plan=plan)


def rate_limit(df: DataFrame, key: list[str], n: int, seconds: float, plan: KeyPlan | None = None) -> DataFrame:
    """Mark the rows admitted under a sliding limit."""
    return fold_by_key(df, key, steps.RateLimitStep(n, seconds), _schema(df, "admitted boolean"), plan=plan)


