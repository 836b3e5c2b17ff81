"""Ordered work per key that stays parallel when one key holds a large share of the rows.

A plain `Window.partitionBy(source)` puts a whole source in one task. The helpers here find the
keys with more than `HOT_ROWS` rows by one counting pass, cut their timelines into slices of
`slice_s` seconds and make the slices independent, exactly; other keys stay whole, and without hot
keys the plan is one exchange and one window:

* `running_sums` slices by ranges with about as many rows each, `trailing_counts` and `distinct_in_window` by time; all
  pre-aggregate per (key, slice), turn the totals into one carry row per slice, and let each slice add its own running
  sum on top;
* `with_row_halo` and `with_time_halo` copy the few context rows a bounded frame needs into the
  slice that needs them, so the frame never crosses a slice.

Nothing is dropped or capped: every input row comes back once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import US
from ..session import cut
from .salted import checked

HOT_ROWS = 200_000
ORDER = ("ts_us", "event_id")
SLICE, HALO = "_slice", "_halo"
_FIRST = -(2**63)


def slice_number(ts: str | Column, slice_s: float) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(c / F.lit(int(slice_s * US))).cast("long")


def hot_keys(df: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """The keys with more than `HOT_ROWS` rows, or None. There are at most rows / `HOT_ROWS` of
    them, which bounds the table.
    """
    if not key:
        return None
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > HOT_ROWS).select(*key)
    return None if hot.isEmpty() else cut(hot)


def _mark(df: DataFrame, key: list[str], hot: DataFrame | None, number: Column) -> DataFrame:
    """Add the slice: by time for hot keys and for an empty key, else one slice per key."""
    if not key:
        return df.withColumn(SLICE, number)
    if hot is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    flag = checked(hot.withColumn("_hot", F.lit(True)))
    return df.join(flag, key, "left").withColumn(SLICE, F.when(F.col("_hot"), number).otherwise(0)).drop("_hot")


def _carry_rows(points: DataFrame, key: list[str], names: list[str], hot: DataFrame | None) -> DataFrame | None:
    """Per (key, slice): what all earlier slices of the key add up to. One small row per slice."""
    if key and hot is None:
        return None
    part = points.join(checked(hot), key, "left_semi") if key else points
    totals = part.groupBy(*key, SLICE).agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*key, SLICE, *[F.sum(n).over(w).alias(n) for n in names]).filter(
        F.col(names[0]).isNotNull()
    )


def _by_rows(df: DataFrame, key: list[str], order: Sequence[str]) -> DataFrame:
    """Slices with about as many rows each, by ranges of (key, order); a burst or an empty key splits like any other.

    The ranges are drawn from a sample and written down, so every later reader sees the same slices.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*key, *order)])
    return cut(ranged.withColumn(SLICE, F.spark_partition_id().cast("long")))


def running_sums(df: DataFrame, key: Sequence[str], sums: dict[str, Column], order: Sequence[str] = ORDER) -> DataFrame:
    """Inclusive running sums over each key's rows in `order`; an empty key means all rows."""
    key = list(key)
    valued = df.withColumns({name: value.cast("long") for name, value in sums.items()})
    split = not key or hot_keys(df, key) is not None
    body = _by_rows(valued, key, order) if split else valued.withColumn(SLICE, F.lit(0).cast("long"))
    w = Window.partitionBy(*key, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.sum(n).over(w).alias(n) for n in sums]
    rest = [c for c in body.columns if c not in sums]
    if not split:
        return body.select(*rest, *own).drop(SLICE)
    totals = body.groupBy(*key, SLICE).agg(*[F.sum(n).alias(f"_b_{n}") for n in sums])  # one row per key and slice
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = cut(totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in key], F.col(SLICE).alias("_k"), *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]))
    same = F.col(SLICE) == F.col("_k")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = body.select(*rest, *own).join(checked(carry), same)
    return out.select(*[c for c in rest if c != SLICE], *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums])


def trailing_counts(
    df: DataFrame, key: Sequence[str], windows: dict[str, tuple[float, Column]], slice_s: float, ts: str = "ts_us"
) -> DataFrame:
    """For each row and each name: rows of its key in [t - window, t] meeting the condition."""
    return step_sums(df, key, {n: (seconds, c, c) for n, (seconds, c) in windows.items()}, slice_s, ts)


def step_sums(
    df: DataFrame,
    key: Sequence[str],
    steps: dict[str, tuple[float, Column, Column]],
    slice_s: float,
    ts: str = "ts_us",
    hot: DataFrame | None = None,
    planned: bool = False,
) -> DataFrame:
    """Running value of step functions given as name -> (hold seconds, up, down).

    A row where `up` holds adds 1 at its time; one where `down` holds takes 1 away just after its
    time plus `hold`. What is in force at a row is then one running sum per key, so slices can be
    far shorter than the windows and no row looks back at other rows. Hot keys may be passed in
    when they are already known (`planned`).
    """
    key, names = list(key), list(steps)
    hot = hot if planned else hot_keys(df, key)

    def points(payload: Column | None) -> DataFrame:
        body = F.lit(None) if payload is None else payload
        empty = F.lit(None) if payload is None else F.when(F.lit(False), payload)
        here = F.struct(
            (F.col(ts) * 2).alias("ord"), body.alias("payload"), F.lit(True).alias("_row"),
            *[F.when(up, 1).otherwise(0).cast("long").alias(n) for n, (_, up, _) in steps.items()],
        )
        leave = [
            F.when(
                down,
                F.struct(
                    ((F.col(ts) + int(hold * US)) * 2 + 1).alias("ord"), empty.alias("payload"),
                    F.lit(False).alias("_row"),
                    *[F.lit(-1 if other == n else 0).cast("long").alias(other) for other in names],
                ),
            )
            for n, (hold, _, down) in steps.items()
        ]
        rows = df.select(*key, F.explode(F.filter(F.array(here, *leave), lambda p: p.isNotNull())).alias("p"))
        return _mark(rows.select(*key, "p.*"), key, hot, slice_number("ord", 2 * slice_s))

    merged = points(F.struct(*df.columns))
    if not key or hot is not None:
        carry = _carry_rows(points(None), key, names, hot)
        merged = merged.unionByName(
            carry.select(*key, SLICE, F.lit(_FIRST).alias("ord"), *names, F.lit(False).alias("_row")),
            allowMissingColumns=True,
        )
    w = (
        Window.partitionBy(*key, SLICE).orderBy("ord")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = merged.select("payload", "_row", *[F.sum(n).over(w).alias(n) for n in names])
    return out.filter("_row").select("payload.*", *names)


def distinct_in_window(
    df: DataFrame, key: Sequence[str], member: str, window_s: float, slice_s: float, name: str
) -> DataFrame:
    """For each row: different `member` values of its key in [t - window, t].

    A member's rows closer than the window form one visit, in force from its first row to the
    window after its last; the distinct count is the number of visits in force. No set is built.
    """
    key = list(key)
    hot = hot_keys(df, key)
    halo = with_time_halo(df, max(slice_s, window_s), window_s, window_s)
    w = sliced_window([*key, member])
    gap = int(window_s * US)
    prev, after = F.lag("ts_us").over(w), F.lead("ts_us").over(w)
    marked = drop_halo(
        halo.withColumns({
            "_start": prev.isNull() | (F.col("ts_us") - prev > gap),
            "_end": after.isNull() | (after - F.col("ts_us") > gap),
        })
    )
    out = step_sums(marked, key, {name: (window_s, F.col("_start"), F.col("_end"))}, slice_s, hot=hot, planned=True)
    return out.drop("_start", "_end")


def with_time_halo(
    df: DataFrame, slice_s: float, before_s: float, after_s: float = 0.0, ts: str = "ts_us"
) -> DataFrame:
    """Copy every row into the slices that look back (`before_s`) or ahead (`after_s`) to it.

    Adds the slice a copy belongs to and whether it is only context there.
    """
    home = slice_number(ts, slice_s)
    first = slice_number(F.col(ts) - int(after_s * US), slice_s)
    last = slice_number(F.col(ts) + int(before_s * US), slice_s)
    return df.withColumn(SLICE, F.explode(F.sequence(first, last))).withColumn(
        HALO, F.col(SLICE) != home
    )


def with_row_halo(
    df: DataFrame, key: Sequence[str], rows: int, slice_s: float, order: Sequence[str] = ORDER
) -> DataFrame:
    """Copy the last `rows` rows before each slice of a hot key into that slice, marked as context.

    Tails are cut down to `rows` per (key, slice) before they are shuffled. A short slice passes
    earlier tails on, so the context is complete however thin the slices are.
    """
    key = list(key)
    hot = hot_keys(df, key)
    body = _mark(df, key, hot, slice_number(order[0], slice_s)).withColumn(HALO, F.lit(False))
    if hot is None:
        return body
    sliced = body.join(checked(hot), key, "left_semi").drop(HALO)
    by_slice = Window.partitionBy(*key).orderBy(SLICE)
    counts = sliced.groupBy(*key, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn(
        "_next",
        F.collect_list(F.struct(F.col(SLICE).alias("s"), F.col("_before").alias("b"))).over(
            by_slice.rowsBetween(1, rows)
        ),
    )
    latest = Window.partitionBy(*key, SLICE).orderBy(*[F.col(c).desc() for c in order])
    tails = sliced.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= rows)
    halo = (
        tails.join(counts, [*key, SLICE])
        .withColumn("_reach", F.col("_before") + F.col("_n") - F.col("_back") + 1 + rows)
        .withColumn(
            "_to", F.explode(F.filter("_next", lambda s: s["b"] < F.col("_reach")))
        )
        .select(*df.columns, F.col("_to.s").alias(SLICE), F.lit(True).alias(HALO))
    )
    return body.unionByName(halo)


def sliced_window(key: Sequence[str], order: Sequence[str] = ORDER):
    """The window to use after a halo helper."""
    return Window.partitionBy(*key, SLICE).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(SLICE, HALO)


def newest_per_key(
    df: DataFrame, key: Sequence[str], n: int, order: Sequence[Column], salt: Column, salts: int = 32
) -> DataFrame:
    """Best `n` rows per key in `order`: first within salted parts of a key, then across them."""
    key = list(key)
    part = F.pmod(F.xxhash64(salt), F.lit(salts))
    inner = Window.partitionBy(*key, "_salt").orderBy(*order)
    outer = Window.partitionBy(*key).orderBy(*order) if key else Window.orderBy(*order)
    return (
        df.withColumn("_salt", part)
        .withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(outer)).filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
