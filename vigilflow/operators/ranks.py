"""Exact order statistics and ranks without sorting a group in one task.

Values are counted in 4,096 buckets between the group's least and greatest value; only the
bucket that holds the wanted rank is opened again, in 4,096 finer ones, and only there are single
values counted. Every pass is one aggregate with map-side combining, so neither a hot group nor a
value shared by many rows matters, and the tables joined back are tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .salted import salted_join

BUCKETS = 4096


def _level(df: DataFrame, by: list[str], part: str, wanted: DataFrame) -> DataFrame:
    """Narrow each wanted rank from its current bucket to one value of `part` inside it."""
    counts = df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    spans = counts.withColumn("_lo", F.coalesce(before, F.lit(0)))
    inside = (F.col("rank") - F.col("_base") >= F.col("_lo")) & (
        F.col("rank") - F.col("_base") < F.col("_lo") + F.col("_n"))
    return wanted.join(spans, by).filter(inside).withColumn("_base", F.col("_base") + F.col("_lo")).drop("_lo", "_n")


def values_at_ranks(
    df: DataFrame, by: list[str], value: str, ranks: DataFrame, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """For each (by, rank), rank counting from 0: the value there and the rows strictly below it.

    `bounds` spares the pass for the least and greatest value where both are known. The tables
    between the passes hold one row per rank and are written down, so no pass repeats another.
    """
    v, group = F.col("_v"), ["_all", *by]
    rows = df.filter(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), *by, F.col(value).alias("_v"))
    if bounds is None:
        ends = rows.groupBy(*group).agg(F.min("_v").cast("double").alias("_min"), F.max("_v").cast("double").alias("_max"))
        rows = salted_join(rows, cut(ends), group, "_v", "inner")
    else:
        rows = rows.withColumns({"_min": F.lit(float(bounds[0])), "_max": F.lit(float(bounds[1]))})
    place = F.when(F.col("_max") > F.col("_min"), (v - F.col("_min")) / (F.col("_max") - F.col("_min"))).otherwise(0.0)
    rows = rows.withColumn("_b2", F.floor(place * (BUCKETS * BUCKETS)).cast("long"))
    rows = rows.select(*group, F.expr(f"_b2 div {BUCKETS}").alias("_b1"), "_b2", "_v")
    wanted = cut(ranks.select(F.lit(0).alias("_all"), *by, "rank").withColumn("_base", F.lit(0).cast("long")))
    at = cut(_level(rows, group, "_b1", wanted))
    rows = rows.join(at.select(*group, "_b1").distinct(), [*group, "_b1"], "left_semi")
    at = cut(_level(rows, [*group, "_b1"], "_b2", at))
    rows = rows.join(at.select(*group, "_b1", "_b2").distinct(), [*group, "_b1", "_b2"], "left_semi")
    at = cut(_level(rows, [*group, "_b1", "_b2"], "_v", at))
    return at.select(*by, "rank", F.col("_v").alias("value"), F.col("_base").alias("below"))


def count_below(df: DataFrame, value: str, points: DataFrame, point: str) -> DataFrame:
    """Add to `points` the number of rows of `df` whose value (0 to 1) is strictly below each."""
    bucket = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * BUCKETS).cast("long")
    rows = df.select(bucket(F.col(value)).alias("_b"), F.col(value).alias("_v"))
    whole = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    spans = F.sort_array(F.collect_list(F.struct("_b", "_n")))  # at most 4,097 entries
    table = whole.agg(spans.alias("_spans"))
    targets = points.select(point).distinct().withColumn("_b", bucket(F.col(point)))
    opened = rows.join(targets.select("_b").distinct(), "_b", "left_semi").groupBy("_b", "_v").agg(
        F.count(F.lit(1)).alias("_n"))
    near = targets.join(opened, "_b", "left").groupBy(point, "_b").agg(
        F.coalesce(F.sum(F.when(F.col("_v") < F.col(point), F.col("_n"))), F.lit(0)).alias("_near"))
    full = F.aggregate(
        F.filter("_spans", lambda s: s["_b"] < F.col("_b")), F.lit(0).cast("long"), lambda a, s: a + s["_n"])
    done = near.join(F.broadcast(table), F.lit(True)).select(point, (full + F.col("_near")).alias("below"))
    return points.join(done, point)


def rank_of_share(n: Column, share: Column | float) -> Column:
    """Position floor(n * share) of n sorted rows, at most the last."""
    return F.least(F.floor(n * share), n - 1).cast("long")


def lowest_share(df: DataFrame, by: list[str], value: str, unique: str, counts: DataFrame) -> DataFrame:
    """Mark (`_low`) the `drop` lowest rows of each group by (value, unique).

    `counts` holds (by, drop) for the groups that lose rows. The value and, among equal values,
    the id where the cut falls are order statistics; the rest is a comparison.
    """
    last = cut(counts.filter(F.col("drop") > 0).select(*by, (F.col("drop") - 1).alias("rank"), "drop"))
    edge = values_at_ranks(df, by, value, last.select(*by, "rank")).join(last, [*by, "rank"]).select(
        *by, F.col("value").alias("_cut"), (F.col("drop") - F.col("below") - 1).alias("rank"))
    tied = salted_join(df, edge, by, unique, "inner").filter(F.col(value) == F.col("_cut"))
    ids = values_at_ranks(tied, by, unique, edge.select(*by, "rank")).select(*by, F.col("value").alias("_last_id"))
    marked = salted_join(df, edge.select(*by, "_cut").join(ids, by), by, unique)
    low = (F.col(value) < F.col("_cut")) | ((F.col(value) == F.col("_cut")) & (F.col(unique) <= F.col("_last_id")))
    return marked.withColumn("_low", F.coalesce(low, F.lit(False))).drop("_cut", "_last_id")
