"""Calibration and evaluation of scores on labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..params import EVALUATION_THRESHOLDS, Thresholds
from ..session import cut
from .ranks import count_below, rank_of_share, values_at_ranks

# Multiplier and bounds per suggested threshold.
SUGGEST = {"gate": (1.2, 0.15, 0.50), "alert": (1.5, 0.30, 0.70), "block": (2.0, 0.50, 0.92)}
SCORE_BOUNDS = (0.0, 1.0)
CALIBRATE = {
    "gate": (0.7, 0.2, 0.6), "alert": (1.0, 0.3, 0.8), "block": (1.3, 0.5, 0.95), "flush": (0.9, 0.3, 0.85),
}


def dataset_stats(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    s, ok = F.col("score"), scores.is_benign(F.col("label"))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("benign"), F.count_if(~ok).alias("attack"),
        F.sum(s).alias("score_sum"), F.sum(s * s).alias("score_sum_sq"), F.max(s).alias("max_score"),
    )


def class_counts(scored: DataFrame) -> DataFrame:
    attack = scored.filter(~scores.is_benign(F.col("label")))
    return attack.groupBy(scores.normalize_label(F.col("label")).alias("attack_class")).agg(F.count(F.lit(1)).alias("events"))


def _benign(scored: DataFrame) -> DataFrame:
    return scored.filter(scores.is_benign(F.col("label"))).select("score")


def benign_percentiles(scored: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row: the benign score at position floor(n * share) for each name."""
    ok = _benign(scored)
    n = ok.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    named = F.explode(F.array(*[
        F.struct(F.lit(k).alias("name"), rank_of_share(F.col("n"), F.lit(v)).alias("rank")) for k, v in shares.items()]))
    ranks = n.select(named.alias("r")).select("r.*")
    found = values_at_ranks(ok, [], "score", ranks.select("rank").distinct(), SCORE_BOUNDS)
    at = ranks.join(found, "rank")
    return at.agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in shares])


def _scaled(base: Column, rules: dict[str, tuple[float, float, float]]) -> list[Column]:
    return [scores.clamp(base * m, lo, hi).alias(f"{n}_threshold") for n, (m, lo, hi) in rules.items()]


def suggest_thresholds(scored: DataFrame, fp_target: float = 0.01) -> DataFrame:
    """Thresholds scaled from the benign score that `fp_target` of benign rows exceed."""
    base = benign_percentiles(scored, {"base": 1.0 - fp_target})
    return base.select("base", *_scaled(F.col("base"), SUGGEST))


def calibrate_thresholds(scored: DataFrame, fp_target: float = 0.01) -> DataFrame:
    """The calibrator's variant, which also suggests a flush level."""
    base = benign_percentiles(scored, {"base": 1.0 - fp_target})
    return base.select("base", *_scaled(F.col("base"), CALIBRATE))


def class_thresholds(scored: DataFrame, base_alert: float = 0.25, min_samples: int = 5, steps: int = 20) -> DataFrame:
    """Per attack class: the score, among about `steps` of its own, with the best F1 against benign.

    Candidates are the class's scores at positions 1, 1 + step, ... below the last.
    """
    attack = scored.filter(~scores.is_benign(F.col("label"))).select(
        scores.normalize_label(F.col("label")).alias("attack_class"), "score")
    ok = _benign(scored)
    sizes = attack.groupBy("attack_class").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples)
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"n div {steps}"))
    ranks = sizes.select("attack_class", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 2, step)).alias("rank"))
    found = values_at_ranks(attack, ["attack_class"], "score", ranks.select("attack_class", "rank"), SCORE_BOUNDS)
    cand = ranks.join(found, ["attack_class", "rank"]).withColumn("tp", F.col("n") - F.col("below")).drop("below")
    total = ok.agg(F.count(F.lit(1)).alias("_benign"))
    cand = count_below(ok, "score", cut(cand), "value").join(F.broadcast(total), F.lit(True))
    fp = F.col("_benign") - F.col("below")
    prec, rec = 100.0 * F.col("tp") / (F.col("tp") + fp), 100.0 * F.col("tp") / F.col("n")
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    best = cand.withColumn("f1", f1).groupBy("attack_class").agg(
        F.max_by(F.struct("value", "f1"), F.struct("f1", -F.col("rank"))).alias("b"))
    return sizes.join(best, "attack_class", "left").select(
        "attack_class", F.col("n").alias("samples"),
        F.when(F.col("b.f1") > 0, F.col("b.value")).otherwise(base_alert).alias("threshold"),
    )


def _rates(smooth: int = 0) -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(0.0)
    prec, rec = share(tp, tp + fp + smooth), share(tp, tp + fn + smooth)
    return {
        "accuracy": share(tp + tn, tp + tn + fp + fn), "precision": prec, "recall": rec,
        "f1": F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0),
    }


def confusion(
    scored: DataFrame, by: tuple[str, ...] = (), t: Thresholds = EVALUATION_THRESHOLDS, smooth: int = 0,
    with_total: bool = False,
) -> DataFrame:
    """Confusion counts and rates in percent; detected means Alert or stronger."""
    judged = scored.withColumn("_d", scores.decide(F.col("score"), t))
    hit, bad = F.col("_d").isin("Alert", "Block", "Escalate"), ~scores.is_benign(F.col("label"))
    grouped = judged.rollup(*by) if with_total else judged.groupBy(*by)
    counts = grouped.agg(
        F.count_if(bad & hit).alias("tp"), F.count_if(~bad & ~hit).alias("tn"),
        F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(hit).alias("alerts"),
        F.count_if(F.col("_d") == "Block").alias("blocks"), F.count_if(F.col("_d") == "Escalate").alias("escalations"),
    )
    return counts.withColumns(_rates(smooth))


def train_eval(train: DataFrame, test: DataFrame, by: tuple[str, ...] = (), fp_target: float = 0.01) -> DataFrame:
    """Fit alert and block thresholds on `train`, then sum the confusion of `test` with them."""
    fitted = suggest_thresholds(train, fp_target).select("alert_threshold", "block_threshold")
    judged = test.join(F.broadcast(fitted), F.lit(True))
    hit, bad = F.col("score") >= F.col("alert_threshold"), ~scores.is_benign(F.col("label"))
    counts = judged.groupBy(*by).agg(
        F.count_if(bad & hit).alias("tp"), F.count_if(~bad & ~hit).alias("tn"),
        F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"),
        F.count_if(F.col("score") >= F.col("block_threshold")).alias("blocks"),
    )
    return counts.withColumns(_rates(smooth=1))


def error_stats(errors: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of reconstruction errors."""
    return errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
