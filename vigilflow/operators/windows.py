"""Per-source and per-destination windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions import scores, vectors
from ..params import (
    FLAG_FIN, FLAG_RST, FLAG_SYN, US, AttackPattern, CorrelationParams, SuspicionParams, Thresholds,
    ATTACK_PATTERNS,
)
from ..session import cut
from .salted import salted_join
from .sliced import (
    ORDER, distinct_in_window, drop_halo, newest_per_key, running_sums, sliced_window, trailing_counts,
    with_row_halo,
)

LOCAL_ROWS = 64


def _frame(key: list[str], back: int):
    return sliced_window(key).rowsBetween(-back, 0)


def _gap_s(key: list[str]) -> Column:
    return (F.col("ts_us") - F.lag("ts_us").over(sliced_window(key))) / float(US)


def inter_arrival(ev: DataFrame, key: list[str], slice_s: float) -> DataFrame:
    """Seconds since the key's previous event over ten, within [0, 1]; 0 for the first."""
    halo = with_row_halo(ev, key, 1, slice_s)
    dt = scores.clamp(F.coalesce(_gap_s(key), F.lit(0.0)) / 10, 0.0, 1.0)
    return drop_halo(halo.withColumn("inter_arrival", dt))


def _entropy_of(seen: Column) -> Column:
    """Entropy in bits over eight of the values in an array."""
    counts = F.transform(F.array_distinct(seen), lambda p: F.size(seen) - F.size(F.array_remove(seen, p)))
    return vectors.entropy_of_counts(counts, F.size(seen)) / 8


def _burst(frame_gaps, rows_in_frame: Column) -> Column:
    mean = F.avg("_gap").over(frame_gaps)
    spread = F.stddev_pop("_gap").over(frame_gaps)
    return (
        F.when(rows_in_frame < 3, 0.0).when(mean < 1e-9, 1.0)
        .otherwise(scores.clamp(spread / mean, 0.0, 1.0))
    )


def local_shape(ev: DataFrame, key: list[str], slice_s: float, rows: int = LOCAL_ROWS) -> DataFrame:
    """Protocol entropy and burst metric over the last `rows` events, and the inter-arrival time.

    One pass: all three share the exchange and the sort.
    """
    halo = with_row_halo(ev, key, rows - 1, slice_s).withColumn("_gap", _gap_s(key))
    out = halo.withColumns({
        "_seen": F.collect_list("protocol").over(_frame(key, rows - 1)),
        "burst": _burst(_frame(key, rows - 2), F.count(F.lit(1)).over(_frame(key, rows - 1))),
        "inter_arrival": scores.clamp(F.coalesce("_gap", F.lit(0.0)) / 10, 0.0, 1.0),
    })
    return drop_halo(out).withColumn("protocol_entropy", _entropy_of(F.col("_seen"))).drop("_gap", "_seen")


def near_miss(al: DataFrame, slice_s: float, p: SuspicionParams = SuspicionParams(), score: str = "score") -> DataFrame:
    """Rows in the band below an alert that are at least the n-th within the trailing window."""
    band = (F.col(score) >= p.near_min) & (F.col(score) < p.near_max)
    counted = trailing_counts(al, ["source"], {"_near": (p.near_window_s, band)}, slice_s)
    return counted.withColumn("near_miss", band & (F.col("_near") >= p.near_n)).drop("_near")


def ip_window(ev: DataFrame, slice_s: float, p: SuspicionParams = SuspicionParams()) -> DataFrame:
    """Boost from the flags, sizes and protocols of the source's last `ip_rows` events."""
    key = ["source"]
    halo = with_row_halo(ev, key, p.ip_rows - 1, slice_s)
    frame = _frame(key, p.ip_rows - 1)
    n = F.count(F.lit(1)).over(frame)
    flag = lambda bit: F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) != 0).over(frame)
    out = halo.withColumns({
        "_n": n, "_syn": flag(FLAG_SYN), "_rst": flag(FLAG_RST), "_fin": flag(FLAG_FIN),
        "_bytes": F.sum(F.col("bytes_in") + F.col("bytes_out")).over(frame),
        "_seen": F.collect_list("protocol").over(frame),
    })
    out = drop_halo(out)
    # half of eight bits takes more than 16 different protocols, so few rows need the entropy
    mixed = F.size(F.array_distinct("_seen")) > 16
    c, rate = F.col, lambda name: F.col(name) / F.col("_n")
    boost = F.greatest(
        F.when((rate("_syn") > 0.8) & (rate("_rst") < 0.1), 0.5).otherwise(0.0),
        F.when(rate("_rst") > 0.3, 0.4).otherwise(0.0),
        F.when((c("_syn") > 0) & (c("_fin") > c("_syn") * 3), 0.35).otherwise(0.0),
        F.when((rate("_bytes") < 50) & (c("_n") > 10), 0.3).otherwise(0.0),
        F.when(mixed, F.when(_entropy_of(c("_seen")) > 0.5, 0.2).otherwise(0.0)).otherwise(0.0),
    )
    scored = out.withColumn("ip_window", F.when(c("_n") < p.ip_min_rows, 0.0).otherwise(boost))
    return scored.drop("_n", "_syn", "_rst", "_fin", "_bytes", "_seen")


def suspicion_boost(
    al: DataFrame, slice_s: float, p: SuspicionParams = SuspicionParams(), t: Thresholds = Thresholds()
) -> DataFrame:
    """Raise rows below the alert threshold by the stronger of both suspicions, and re-decide.

    Only such rows feed the two windows, so the rest skips them.
    """
    low = F.col("confidence") < t.alert
    weak = ip_window(cut(near_miss(al.filter(low), slice_s, p, "confidence")), slice_s, p)
    extra = F.greatest(
        F.when(F.col("near_miss"), p.near_boost).otherwise(0.0), F.col("ip_window") * p.ip_boost
    )
    raised = weak.withColumn("_extra", extra).withColumn(
        "confidence", F.when(F.col("_extra") > 0, scores.clamp(F.col("confidence") + F.col("_extra"), 0.0, 1.0))
        .otherwise(F.col("confidence")),
    ).withColumn(
        "decision", F.when(F.col("_extra") > 0, scores.decide(F.col("confidence"), t)).otherwise(F.col("decision"))
    )
    return raised.select(*al.columns).unionByName(al.filter(~low | low.isNull()))


# ---- correlation -----------------------------------------------------------------------------

def repeat_and_slow(al: DataFrame, slice_s: float, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """Counts per source in the repeat window and, above the slow score, in the slow window."""
    return trailing_counts(
        al, ["source"],
        {"repeat_count": (p.repeat_window_s, F.lit(True)),
         "slow_count": (p.slow_window_s, F.col("score") >= p.slow_score)},
        slice_s,
    )


def distributed(al: DataFrame, slice_s: float, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """Different sources that hit the row's destination in the trailing window."""
    return distinct_in_window(al, ["destination"], "source", p.dist_window_s, slice_s, "source_count")


def stage_completions(al: DataFrame, patterns: tuple[AttackPattern, ...] = ATTACK_PATTERNS) -> DataFrame:
    """Per source and pattern: the alert that first completed it, as (ts_us, event_id) in `done`.

    Each stage is the first alert of its class after the previous stage, and must come within
    the gap. The first is the closest, so later ones cannot succeed where it fails: a chain of
    minimum aggregates is exact. One pass per stage serves all patterns.
    """
    at, cls = F.struct(F.col("ts_us"), F.col("event_id")), F.col("attack_class")
    slim = al.select("source", "ts_us", "event_id", "attack_class")

    def of(stage: int) -> DataFrame:
        return slim.filter(cls.isin(*{p.stages[stage] for p in patterns if len(p.stages) > stage}))

    found = of(0).groupBy("source").agg(
        *[F.min(F.when(cls == p.stages[0], at)).alias(f"d{i}") for i, p in enumerate(patterns)])
    for stage in range(1, max(len(p.stages) for p in patterns)):
        live = [(i, p) for i, p in enumerate(patterns) if len(p.stages) > stage]
        later = salted_join(of(stage), found, ["source"], "event_id", "inner").groupBy("source").agg(*[
            F.min(F.when((cls == p.stages[stage]) & (at > F.col(f"d{i}")), at)).alias(f"n{i}") for i, p in live])
        gap = lambda i: F.col(f"n{i}.ts_us") - F.col(f"d{i}.ts_us")
        found = found.join(later, "source", "left").withColumns({
            f"d{i}": F.when(gap(i) <= int(p.max_gap_s * US), F.col(f"n{i}")) for i, p in live
        }).drop(*[f"n{i}" for i, _ in live])
    each = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.col(f"d{i}").alias("done")) for i, p in enumerate(patterns)])
    return found.select("source", F.explode(each).alias("f")).select("source", "f.*").filter(F.col("done").isNotNull())


def _mark_stages(al: DataFrame, completions: DataFrame) -> DataFrame:
    first = completions.groupBy("source").agg(F.min("done").alias("_done"))
    flagged = salted_join(al, first, ["source"], "event_id")
    hit = F.struct("ts_us", "event_id") >= F.col("_done")
    return flagged.withColumn("multi_stage", F.coalesce(hit, F.lit(False))).drop("_done")


def multi_stage(al: DataFrame, patterns: tuple[AttackPattern, ...] = ATTACK_PATTERNS) -> DataFrame:
    """Flag every alert of a source from the moment the source has completed a pattern."""
    return _mark_stages(al, stage_completions(al, patterns))


def correlate(
    al: DataFrame, slice_s: float, p: CorrelationParams = CorrelationParams(),
    patterns: tuple[AttackPattern, ...] = ATTACK_PATTERNS,
) -> DataFrame:
    """All four correlations of each alert, their score and type, and the upgraded decision.

    The counts per source are written down before the pass per destination, which reads them
    twice; stages are found on the alerts as given.
    """
    counted = cut(repeat_and_slow(al, slice_s, p))
    seen = _mark_stages(distributed(counted, slice_s, p), stage_completions(al, patterns))
    flags = seen.withColumns({
        "repeat": F.col("repeat_count") >= p.repeat_n,
        "distributed": F.col("source_count") >= p.dist_sources,
        "slow_attack": F.col("slow_count") >= p.slow_n,
    })
    add = lambda name, w: F.when(F.col(name), w).otherwise(0.0)
    total = (
        add("repeat", p.repeat_weight) + add("multi_stage", p.stage_weight)
        + add("distributed", p.dist_weight) + add("slow_attack", p.slow_weight)
    )
    kind = (
        F.when(F.col("slow_attack"), "slow_attack").when(F.col("distributed"), "distributed")
        .when(F.col("multi_stage"), "multi_stage").when(F.col("repeat"), "repeat").otherwise("")
    )
    return flags.withColumn("corr_score", scores.clamp(total, 0.0, 1.0)).withColumns({
        "correlation_type": kind,
        "upgraded_decision": F.when(
            (F.col("corr_score") > p.escalate_above) & (F.col("decision") == "Alert"), "Escalate"
        ).otherwise(F.col("decision")),
    })


# ---- order and retention ---------------------------------------------------------------------

def retain_last(al: DataFrame, key: list[str], n: int) -> DataFrame:
    """The newest `n` rows per key; an empty key keeps the newest overall."""
    return newest_per_key(al, key, n, [F.col(c).desc() for c in ORDER], F.col("event_id"))


def alert_seq(al: DataFrame) -> DataFrame:
    """Running alert number in time order, without sorting everything in one task."""
    return running_sums(al, [], {"alert_seq": F.lit(1)})


def sample_one_in(ev: DataFrame, n: int) -> DataFrame:
    """Every n-th event in time order, starting with the first."""
    return running_sums(ev, [], {"_nth": F.lit(1)}).filter((F.col("_nth") - 1) % n == 0).drop("_nth")


def repeat_escalate(
    al: DataFrame, slice_s: float, n: int = 10, window_s: float = 300.0
) -> DataFrame:
    """Whether a source has raised `n` alerts since it was last quiet for longer than the window,
    the first of them no more than the window ago.
    """
    key = ["source"]
    gap = int(window_s * US)
    halo = with_row_halo(al, key, 1, slice_s)
    prev = F.lag("ts_us").over(sliced_window(key))
    marked = cut(drop_halo(halo.withColumn("_new", prev.isNull() | (F.col("ts_us") - prev > gap))))
    runs = cut(running_sums(marked, key, {"_run": F.when(F.col("_new"), 1).otherwise(0), "_no": F.lit(1)}))
    starts = runs.filter("_new").select(
        *key, "_run", F.col("_no").alias("_first_no"), F.col("ts_us").alias("_first_us")
    )
    joined = salted_join(runs, starts, [*key, "_run"], "event_id", "inner")
    return joined.withColumn("alerts_in_run", F.col("_no") - F.col("_first_no") + 1).withColumn(
        "repeat_escalate",
        (F.col("alerts_in_run") >= n) & (F.col("ts_us") - F.col("_first_us") <= gap),
    ).drop("_new", "_run", "_no", "_first_no", "_first_us")


def sessions(ev: DataFrame, key: list[str], gap_s: float, slice_s: float, name: str = "session_no") -> DataFrame:
    """Number each key's sessions: a new one starts after more than `gap_s` without an event."""
    halo = with_row_halo(ev, key, 1, slice_s)
    prev = F.lag("ts_us").over(sliced_window(key))
    fresh = F.when(prev.isNull() | (F.col("ts_us") - prev > int(gap_s * US)), 1).otherwise(0)
    marked = cut(drop_halo(halo.withColumn("_new", fresh)))
    return running_sums(marked, key, {name: F.col("_new")}).drop("_new")


def state_phase(ev: DataFrame, now_us: int, idle_s: float = 300.0, expire_s: float = 3600.0) -> DataFrame:
    """Active, Idle or Expired per source by the age of its last event."""
    age = (F.lit(now_us) - F.col("last_us")) / float(US)
    last = ev.groupBy("source").agg(F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("events"))
    return last.withColumn(
        "phase", F.when(age > expire_s, "Expired").when(age > idle_s, "Idle").otherwise("Active")
    )


