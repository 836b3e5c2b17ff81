"""Mixing sources to target weights by entropy balancing.

Sources share a budget of words by weight, none above `most` times its size; the excess is reshared
until none is above. Each document then gets a rate: among all rates between 0 and `most` whose
words meet the source's target, those nearest to one copy each in relative entropy. The dual has one
multiplier per source, and rate = min(most, exp(multiplier * size / mean size)). Newton steps on
the dual run for all sources at once over counts by (source, size), kept within a bracket.

Rates become whole copies in parts of a source, largest documents first: each takes the floor or
ceiling of its rate, whichever keeps the part's words nearer to what its rates have asked for so
far. What is left open is about half the smallest document of a part.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources
of size 0 have target 0; repeated rows get equal copies; rows without id are mixed like others; an
empty table gives no rows; other columns are kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_ROWS, WORD, by_key, packed, unpacked


def numbered(df: DataFrame, order: Sequence, name: str = "no") -> DataFrame:
    """Rows with their place in an order, from 0, by range partitions and their counts; no task sees all rows."""
    spread = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    spread = spread.withColumn("_at", F.monotonically_increasing_id())
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = counts.alias("a").join(counts.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(
        F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return spread.withColumn("_part", part).withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(
        name, F.col("_before") + F.col("_inside")).drop("_at", "_part", "_inside", "_before")


def small(df: DataFrame) -> DataFrame:
    """Broadcast a materialised table when its rows are few; otherwise leave the join to Spark, which splits skew."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, docs, no, target) from (source, source_size, docs)."""
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    state = cut(ranked.withColumns({"weight": weight, "cap": most * F.col("source_size"), "full": F.lit(False)}))
    while True:
        sums = state.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("given"),
                         F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not sums["open"]:
            return state.select("source", "source_size", "docs", "no", F.col("cap").alias("target"))
        level = (share * sums["all"] - sums["given"]) / sums["open"]
        above = ~F.col("full") & (F.col("weight") * level > F.col("cap"))
        if state.filter(above).isEmpty():
            target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)
            return state.select("source", "source_size", "docs", "no", target.alias("target"))
        state = cut(state.withColumn("full", F.col("full") | above))


def multipliers(counts: DataFrame, sources: DataFrame, most: float, rounds: int = 40, tolerance: float = 1e-5) -> DataFrame:
    """(no, mult) that solve the dual of each source; counts has (no, size, n)."""
    usable = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-9))
    state = cut(sources.select(
        "no", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.when(usable, 0.0).when(F.col("target") > 0, 1e9).otherwise(0.0).alias("mult"),
        F.lit(-1e4).alias("low"), F.lit(1e9).alias("high"), (~usable).alias("done")))
    # sums of millionths as whole numbers do not depend on the order of rows, so reruns agree
    total = lambda c: F.sum((c * 1e6).cast("decimal(30,0)")).cast("double") / 1e6
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("mult") * z, F.lit(50.0)))
        rate = F.least(tilt, F.lit(most))
        sums = counts.join(small(state.filter(~F.col("done"))), "no").groupBy("no").agg(
            total(F.col("n") * rate * F.col("size")).alias("words"),
            total(F.when(tilt < most, F.col("n") * tilt * F.col("size") * z).otherwise(0.0)).alias("slope"))
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("mult")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("mult")).otherwise(F.col("high"))
        newton = F.col("mult") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        # outside the bracket: halve it, or while it is still open step by factors
        halved = F.when((low > -1e4) & (high < 1e9), (low + high) / 2).when(gap < 0, F.greatest(F.col("mult") * 4, F.lit(1.0))).otherwise(F.least(F.col("mult") * 4, F.lit(-1.0)))
        there = F.abs(gap) <= tolerance * F.col("target")
        moved = F.when(there, F.col("mult")).when(inside, newton).otherwise(halved)
        state = cut(state.join(sums, "no", "left").select(
            "no", "target", "mean", F.when(F.col("done"), F.col("mult")).otherwise(moved).alias("mult"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.coalesce(there, F.lit(True))).alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("no", "mean", "mult")


def plan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2),
         share: float = 1.5, most: float = 2.0, part: int = 4096) -> DataFrame:
    """(id, source, text_hash, rows, size, source_size, target, rate, copies, taken): one row for equal
    rows (id, source and text) that get the same number of `copies`. Together equal rows are taken `rows * rate` times, so
    some may get the next number below the rate and others the one above; then there are two rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = cut(docs.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), size.alias("size"))
               .groupBy("id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("docs")), weights, share, most))
    known = rows.alias("r").join(small(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.*", "s.source_size", "s.docs", "s.no", "s.target")
    known = cut(known)
    counts = cut(known.groupBy("no", "size").agg(F.sum("rows").alias("n")))
    mult = cut(multipliers(counts, sources, most))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("mult") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = known.join(small(mult), "no").withColumn("rate", rate)
    rated = rated.withColumn("tie", F.xxhash64("id", "text_hash")).withColumn(
        "part", F.pmod("tie", F.greatest(F.ceil(F.col("docs") / part), F.lit(1))).cast("int"))

    def copy(rows_of: pd.DataFrame) -> pd.DataFrame:
        rows_of = rows_of.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
        owed, made = 0.0, []
        for at, n, words, rate in zip(range(len(rows_of)), rows_of["rows"], rows_of["size"], rows_of["rate"], strict=True):
            low, high = int(np.floor(rate)), int(np.ceil(rate))
            owed += rate * n * words
            more = min(int(n), max(0, round(owed / words - n * low))) if high > low and words else 0  # rows that get one copy more
            owed -= (n * low + more) * words
            made.extend((at, share, copies) for share, copies in ((more, high), (n - more, low)) if share)
        place, shares, copies = (list(x) for x in zip(*made, strict=True))
        named = rows_of[["id", "source", "text_hash", "size", "source_size", "target", "rate"]].iloc[place]
        return named.assign(rows=shares, copies=copies)

    id_type = rows.schema["id"].dataType.simpleString()
    out = by_key(rated, ["no", "part"], copy,
                 f"id {id_type}, source string, text_hash bigint, rows bigint, size bigint, source_size bigint, target double, rate double, copies bigint")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """`docs` with each row as often as the plan takes it."""
    key = ["id", "source", "text_hash"]
    shares = plan(docs, id_column, text, source, **options).groupBy(*key).agg(  # two of a class at most
        F.max("copies").alias("most"), F.min("copies").alias("least"), F.max_by("rows", "copies").alias("first"))
    keep = docs.columns
    d = docs.select(packed(keep), F.col(id_column).alias("_id"), F.col(source).cast("string").alias("_source"), F.xxhash64(F.col(text).cast("string")).alias("_hash"))
    met = d.join(shares, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash")) & F.col("_source").eqNullSafe(F.col("source")))
    met = cut(met.select("rest", *key, "most", "least", "first").filter("most > 0"))
    same, split = met.filter("most = least"), met.filter("most <> least")
    taken = same.select("rest", F.col("most").alias("copies"))
    if not split.isEmpty():  # number equal rows, the hot ones over many tasks, by a hash of all their columns
        spread = split.withColumn("_spread", F.xxhash64("rest")).withColumn("_tie", F.monotonically_increasing_id())
        placed = numbered(spread, [F.col(c) for c in (*key, "_spread", "_tie")])
        begins = cut(placed.groupBy(*key).agg(F.min("no").alias("_begin")).select(*(F.col(c).alias(f"_k_{c}") for c in key), "_begin"))
        alike = F.lit(True)
        for c in key:
            alike = alike & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        copies = F.when(F.col("no") - F.col("_begin") < F.col("first"), F.col("most")).otherwise(F.col("least"))
        taken = taken.unionByName(placed.join(small(begins), alike).select("rest", copies.alias("copies")))
    return taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*unpacked(keep))
