"""Interaction audit of document filters: what each filter removes in every order of applying them.

A document's failures are one bit per filter. Counts by (part, failure mask) are all that the audit
needs, so the corpus is aggregated once and the orders are walked on at most 2**k rows a part.

The subsets of k filters form a lattice: a state is the set of filters already applied, an edge
applies one more. Counting paths forward from the empty set and backward from the full set says how
many of the k! orders pass an edge. An edge removes the same documents in all of them, so its
removals times its orders, summed by filter, is the Shapley sum; the steps of every single order
are read from the same edges.

Defined cases: null texts are empty texts; a text is a repetition where a row with a smaller id has
the same text, so rows without id are never repetitions and rows of one id and text repeat the same
smaller ids; a null part is the empty string; labels of one id given several times count where any
of them says so, labels without id are ignored; an empty table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

MOST_FILTERS = 6  # the audit has k! * k rows for each part


class Edge(NamedTuple):
    """Applying `filter` (a place in the list) in the state `state` (a set of places as bits)."""

    state: int
    filter: int
    reaching: int  # ways from the empty set to the state
    leaving: int  # ways from the state behind the edge to the full set


def lattice(k: int) -> list[Edge]:
    """The edges of the lattice of subsets of k filters, with their path counts."""
    full = (1 << k) - 1
    reaching, leaving = [0] * (full + 1), [0] * (full + 1)
    reaching[0] = leaving[full] = 1
    for state in range(full + 1):  # a subset is a smaller number than its supersets
        for f in range(k):
            if not state >> f & 1:
                reaching[state | 1 << f] += reaching[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if not state >> f & 1:
                leaving[state] += leaving[state | 1 << f]
    return [Edge(s, f, reaching[s], leaving[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def quality_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need the text alone."""
    words = F.array_remove(F.split(text, WORD.replace("[^", "[")), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, conditions, id_column: str = "doc_id", text: str = "text",
                   part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail.

    `conditions(text)` names the failures that a text alone decides; their bits come first, that of
    repeated texts is the last. Rows move as a hash of the text and a few numbers, and equal ones
    are counted before they move.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bits = list(conditions(F.col("body")).values())
    slim = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    mask = sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0))
    rows = slim.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("text"))
    rows = rows.groupBy("id", "part", "mask", "text").agg(F.count(F.lit(1)).alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    told = labels.select(F.col(id_column).cast("bigint").alias("id"), "quality", "toxic").filter("id is not null")
    told = told.groupBy("id").agg(says("quality"), says("toxic")).filter("quality or toxic").withColumn("spread", F.lit(0))
    # rows without id have no label; they are spread by their texts instead of meeting in one task
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)) + 1).otherwise(0).cast("int")
    known = rows.withColumn("spread", spread).join(told, ["id", "spread"], "left").select(
        "id", "part", "mask", "text", "n", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("bad"))
    # a copy that is not in a row with the text's smallest id repeats that one
    named = F.col("id").isNotNull()
    alike = known.groupBy("text", "mask", "part", "good", "bad").agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("id", "n"))).alias("least"))
    least = F.min("least.id").over(Window.partitionBy("text"))  # a text has one row for each part and label at most
    firsts = F.when(F.col("least.id") == F.col("lowest"), F.col("least.n")).otherwise(0)
    split = alike.withColumn("lowest", least).withColumn("again", F.col("named") - firsts)
    pieces = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("again")).alias("n")),
                     F.struct((F.col("mask") + (1 << len(bits))).alias("mask"), F.col("again").alias("n")))
    count = lambda c: F.sum(F.when(F.col(c), F.col("piece.n")).otherwise(0))
    return split.select("part", "good", "bad", F.explode(pieces).alias("piece")).filter("piece.n > 0").groupBy(
        "part", F.col("piece.mask").alias("mask")).agg(F.sum("piece.n").alias("n"), count("good").alias("good"), count("bad").alias("toxic"))


def audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (part, filter_order, step) from `counts` (part, mask, n, good, toxic), zeros included."""
    k = len(names)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    passes: dict[tuple[int, int], list[tuple[str, int]]] = {(e.state, e.filter): [] for e in lattice(k)}
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            passes[state, f].append(("".join(names[x] for x in order), step))
            state |= 1 << f
    listed = ", ".join(f"({e.state}, {e.filter}, {e.reaching}, {e.leaving})" for e in lattice(k))
    edges = F.expr(f"cast(array({listed}) as array<struct<state: int, filter: int, reaching: int, leaving: int>>)")
    spark = counts.sparkSession
    orders = spark.createDataFrame([(*edge, *row) for edge, rows in passes.items() for row in rows], "state int, filter int, filter_order string, step int")

    at = counts.withColumn("edge", F.explode(edges)).select("part", "mask", "n", "good", "toxic", "edge.*")
    own = F.expr("shiftleft(1, filter)")
    fails, earlier = F.col("mask").bitwiseAND(own) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    total = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    walked = at.groupBy("part", "state", "filter", "reaching", "leaving").agg(
        total(~fails & ~earlier, "n").alias("kept"), total(fails & ~earlier, "n").alias("removed"), total(fails & earlier, "n").alias("redundant"),
        total(F.col("mask") == own, "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"))
    orders_through = F.col("removed") * F.col("reaching") * F.col("leaving")
    weighed = walked.withColumn("shapley", F.sum(orders_through).over(Window.partitionBy("part", "filter")).cast("long"))
    return weighed.join(F.broadcast(orders), ["state", "filter"]).select(  # k! * k rows whatever the corpus
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
