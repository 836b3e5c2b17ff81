"""Places of regular-expression matches as columns, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


#: Items per block of a running fold; arrays are copied once per item within a block only.
BLOCK = 256


def none() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, weight: Callable[[Column], Column], combine: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column], kind: str) -> Column:
    """make(item, combined weights of the items before it) of every item of an array that is not empty.

    Folds go block by block, so the work grows with the items and not with their square.
    """
    zero, empty = F.lit(0).cast("bigint"), F.array().cast(kind)

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda a, x: combine(a, weight(x))))
        before = F.aggregate(totals, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct(
            combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return bound(before, lambda starts: F.flatten(F.transform(blocks, lambda block, i: F.aggregate(
            block, F.struct(F.get(starts, i).alias("at"), empty.alias("out")),
            lambda a, x: F.struct(combine(a["at"], weight(x)).alias("at"), F.concat(a["out"], F.array(make(x, a["at"]))).alias("out")),
            lambda a: a["out"]))))

    def of_items(z: Column) -> Column:
        last = F.floor((F.size(z) - 1) / BLOCK).cast("int")
        return bound(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return bound(items, of_items)


def matches(text: Column, kind: str, pattern: str, when: Column, context: bool = False) -> Column:
    """All leftmost non-overlapping matches of a Java pattern: kind, start, end (code points, exclusive), value.

    The pieces between matches and the matches alternate, so places are sums of lengths. `when` is
    a cheap condition that every text with a match meets; other texts are not searched. With
    `context`, spans also have `before`, up to 64 characters of the piece and the match before.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    schema = SPAN.replace("value:string", "value:string,before:string") if context else SPAN

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        fields = [F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value")]
        return F.struct(*fields, *[F.right(F.concat(F.right(x["last"], F.lit(64)), F.right(x["gap"], F.lit(64))), F.lit(64)).alias("before")] * context)

    def placed(found: Column) -> Column:
        n = F.size(found)
        items = F.arrays_zip(found.alias("hit"), F.slice(gaps, 1, n).alias("gap"), F.slice(F.concat(F.array(F.lit("")), found), 1, n).alias("last"))
        walked = running(items, lambda x: F.length(x["gap"]) + F.length(x["hit"]), lambda a, w: a + w, span, schema)
        return F.when(n > 0, walked).otherwise(F.array().cast(schema))

    return F.when(when, bound(hits, placed)).otherwise(F.array().cast(schema))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column, kinds: Sequence[str], by_kind: bool) -> Column:
    """kind:start:end of all spans joined by commas: by kind as listed then start, or by start then kind."""
    def key(s: Column) -> Column:
        no = F.array_position(F.array(*(F.lit(k) for k in kinds)), s["kind"])
        first, second = (no, s["start"]) if by_kind else (s["start"], no)
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), s["kind"].alias("kind"), s["start"].alias("start"))

    ordered = F.array_sort(F.transform(spans, key))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["c"].cast("string"))), ",")
