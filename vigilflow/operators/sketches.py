"""Quantile sketches that merge by addition, time series of states, and bounded logs of faults or routing.

A sketch counts values by logarithmic buckets: bucket b holds the values in (g**(b-1), g**b] with
g = (1 + error) / (1 - error), so the middle of a bucket is within `error` of every value in it, relatively. Counts
of equal buckets add, whatever order or batches the values came in. Values that are not positive share one
bucket of their own, estimated as 0; nulls and NaN are not counted. A group has at most some
1,400 / error buckets whatever its rows, as that is how many fit between the smallest and the largest double.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import US
from .sliced import newest_per_key

ERROR = 0.01
NOT_POSITIVE = -(2**31)
FACTS = ("n", "total", "peak")


def base(error: float = ERROR) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / math.log(base(error))).cast("int")).otherwise(NOT_POSITIVE)


def sketch(df: DataFrame, by: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """Per group and bucket: how many values, their sum and the largest; infinite values are left out."""
    x = F.col(value).cast("double")
    counted = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return counted.groupBy(*by, bucket(x, error).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.max(x).alias("peak"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts added up; `by` may name fewer columns than the parts have, as minutes add up to hours."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("peak").alias("peak"))


def quantiles(sketches: DataFrame, by: Sequence[str], wanted: dict[str, float], error: float = ERROR) -> DataFrame:
    """Samples, mean, peak and the named quantiles of each group of a merged sketch.

    The quantile q is the value that q of the samples do not exceed, as `latency_stats` has it, within `error`;
    it never exceeds the largest value.
    """
    g = base(error)
    order = Window.partitionBy(*by).orderBy("bucket")
    whole = Window.partitionBy(*by)
    through = sketches.withColumns({
        "_through": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(whole),
        "_middle": F.when(F.col("bucket") == NOT_POSITIVE, 0.0).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))})
    reached = lambda q: F.least(
        F.min(F.when(F.col("_through") >= F.greatest(F.ceil(F.col("_all") * q), F.lit(1)), F.col("_middle"))), F.greatest(F.max("peak"), F.lit(0.0)))
    return through.groupBy(*by).agg(
        F.sum("n").alias("samples"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("peak").alias("peak"),
        *[reached(q).alias(name) for name, q in wanted.items()])


# ---- series and logs ---------------------------------------------------------------------------

def series(states: DataFrame, key: str, step_s: float, columns: Sequence[str], keep: int | None = None) -> DataFrame:
    """Per key and time step the last, mean and largest of each column and the number of samples; with `keep`
    the newest steps of every key only. States: key, ts_us, event_id and the columns.
    """
    step = int(step_s * US)
    last = F.struct("ts_us", "event_id")
    steps = states.groupBy(key, (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(step))).alias("step_us")).agg(
        F.count(F.lit(1)).alias("samples"),
        *[a for c in columns for a in (F.max_by(c, last).alias(f"{c}_last"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_peak"))])
    return steps if keep is None else newest_per_key(steps, [key], keep, [F.col("step_us").desc()], F.col("step_us"))


def newest_by_kind(log: DataFrame, keep: int, kind: str = "kind") -> DataFrame:
    """The newest `keep` records of every kind with the number of all records of the kind."""
    counts = log.groupBy(kind).agg(F.count(F.lit(1)).alias("seen"))
    kept = newest_per_key(log, [kind], keep, [F.col("ts_us").desc(), F.col("event_id").desc()], F.col("event_id"))
    return kept.join(counts, kept[kind].eqNullSafe(counts[kind])).drop(counts[kind])
