"""State machines over each key's ordered rows, for rules no window can express.

Rows are partitioned by key and sorted by Spark; a task then walks its sorted rows in Arrow
batches, calling one small numpy step per run of equal keys and carrying the state over batch
borders, so memory never grows with a key. A key with more than `max_rows` rows is also cut into
consecutive chunks that run in different tasks. Chunks of a hot key are first
run side by side from an empty state; a chunk whose predecessor turns out to end in another
state than it assumed is run again from the right one, until nothing changes. State that is
forgotten quickly settles after a round or two, and the result always equals the sequential run:
after round r the first r chunks are final. All rounds read the same rows, which are sorted and written down once;
the few states, one per chunk, travel with the function and not with the rows. Running numbers never settle; a step names them in
`additive` (name -> period after which the number means the same, or None if nothing depends on it),
and chunks get them as sums of what the chunks before them have added.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .packed import cut_packed
from .salted import checked
from .sliced import HOT_ROWS, ORDER, slice_number

# step(columns of rows in time order, state or None) -> (new columns, state); a new column named
# `_keep` says which rows to keep
Columns = dict[str, np.ndarray]
Step = Callable[[Columns, object], tuple[dict, object]]

MAX_ROWS = 200_000
FINE_S = 60.0


def dump_state(state: object) -> str:
    """State as text; floats keep every digit, so a carried state is the very same."""
    return json.dumps(state)


def load_state(text: str | None) -> object:
    return None if text is None or pd.isna(text) else json.loads(text)


def _additive(step: Step) -> dict[str, int | None]:
    return getattr(step, "additive", {})


def _start(step: Step, carry: str | None, base: Sequence[int] | None) -> object:
    """The state a chunk starts from: what it carries and the running numbers."""
    state = load_state(carry)
    if state is not None and _additive(step):
        state = state | dict(zip(_additive(step), map(int, base), strict=True))
    return state


def _report(step: Step, key: tuple, carry: str | None, start: object, end: object) -> list:
    """A chunk's end: its state without running numbers, and how far those went on."""
    names = _additive(step)
    if not names:
        return [*key, carry, [], dump_state(end), []]
    before = [start[n] if start else 0 for n in names]
    return [*key, carry, before, dump_state({k: v for k, v in end.items() if k not in names}), [end[n] - b for n, b in zip(names, before, strict=True)]]


def _chunks(df: DataFrame, hot: DataFrame, key: list[str], max_rows: int, fine_s: float, ts: str) -> DataFrame:
    """(key, fine slice, chunk) for the slices that come after a hot key's first `max_rows` rows."""
    fine = df.join(checked(hot), key, "left_semi").groupBy(*key, slice_number(ts, fine_s).alias("_fine")).agg(
        F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*key).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    )
    chunk = F.floor(F.coalesce(before, F.lit(0)) / max_rows).cast("long")
    return fine.select(*key, "_fine", chunk.alias("_chunk")).filter(F.col("_chunk") > 0)


class KeyPlan(NamedTuple):
    """Which rows of which keys belong to a later chunk; `later` is None when no key is hot. `largest` bounds the rows of a key."""

    later: DataFrame | None
    fine_s: float
    largest: int | None = None

    @property
    def whole(self) -> bool:
        """Whether every key stays in one piece here and in `sliced`, so that rows which a window has put in order lie for a fold."""
        return self.later is None and self.largest is not None and self.largest <= HOT_ROWS


def plan_keys(
    df: DataFrame, key: Sequence[str], max_rows: int = MAX_ROWS, fine_s: float = FINE_S, ts: str = "ts_us"
) -> KeyPlan:
    """Find the hot keys with one counting pass; only theirs are counted again by time. Plan once
    on the source of a chain of folds: any chunking is exact, so counts taken upstream serve every
    later step over the same key.
    """
    slim = df.select(*key, ts)
    counts = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest <= max_rows:
        return KeyPlan(None, fine_s, largest)
    hot = counts.filter(F.col("_n") > max_rows).select(*key)
    later = cut(_chunks(slim, cut(hot), list(key), max_rows, fine_s, ts))
    return KeyPlan(None if later.isEmpty() else later, fine_s, largest)


def _runs(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[tuple[tuple, Columns]]:
    """Runs of equal group values within each batch, as numpy columns."""
    for pdf in batches:
        if not len(pdf):
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf) - 1, dtype=bool)
        for c in group:
            change |= cols[c][1:] != cols[c][:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)]
        for i, j in zip(edges[:-1], edges[1:]):
            yield tuple(cols[c][i] for c in group), {c: v[i:j] for c, v in cols.items()}
        yield (), {}  # end of batch


def pick(rows: Columns, added: dict, names: list[str]) -> dict:
    """The output columns of one run, without the rows a step drops."""
    keep = added.pop("_keep", None)
    out = {n: added[n] if n in added else rows[n] for n in names}
    if keep is None:
        return out
    mask = np.asarray(keep, dtype=bool)
    return {n: [x for x, m in zip(v, mask, strict=True) if m] if isinstance(v, list) else v[mask] for n, v in out.items()}


def _column(parts: list) -> object:
    if len(parts) == 1:
        return parts[0]
    if all(isinstance(p, np.ndarray) for p in parts):
        return np.concatenate(parts)
    return [x for p in parts for x in p]


# per group: the state it starts from and its running numbers
Starts = dict[tuple, tuple[str | None, Sequence[int] | None]]


def _walk(step: Step, group: list[str], names: list[str], starts: Starts | None = None):
    """A mapInPandas function that runs `step` along sorted rows."""
    starts = starts or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, parts = None, None, {n: [] for n in names}
        for key, rows in _runs(batches, group):
            if not rows:
                if parts[names[0]]:
                    yield pd.DataFrame({n: _column(v) for n, v in parts.items()})
                parts = {n: [] for n in names}
                continue
            if key != current:
                current, state = key, _start(step, *starts.get(key, (None, None)))
            added, state = step(rows, state)
            for n, v in pick(rows, added, names).items():
                parts[n].append(v)

    return run


def _last_states(step: Step, group: list[str], starts: Starts):
    """A mapInPandas function that reports the state each group starts from and ends in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, carry, start, state, done = None, None, None, None, []
        for key, rows in _runs(batches, group):
            if not rows:
                continue
            if key != current:
                if current is not None:
                    done.append(_report(step, current, carry, start, state))
                carry, base = starts.get(key, (None, None))
                current, start = key, _start(step, carry, base)
                state = start
            state = step(rows, state)[1]
        if current is not None:
            done.append(_report(step, current, carry, start, state))
        if done:
            yield pd.DataFrame(done, columns=[*group, "_carry", "_base", "_end", "_adds"])

    return run


def _sorted(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows partitioned by group and in order within it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *group).sortWithinPartitions(*group, *order)


def fold_by_key(
    df: DataFrame,
    key: Sequence[str],
    step: Step,
    schema: str,
    order: Sequence[str] = ORDER,
    max_rows: int = MAX_ROWS,
    plan: KeyPlan | None = None,
    follows: bool = False,
) -> DataFrame:
    """Run `step` over each key's rows in `order`; the output has `schema`.

    `follows`: `df` is the result of a fold over the same key, order and `plan`, with nothing but columns added, dropped
    or renamed since. Its rows still lie together and in order, so without hot keys they are not shuffled again.
    """
    key, order = list(key), list(order)
    names = [part.split()[0] for part in re.sub(r"<.*?>", "", schema).split(",")]
    if follows and plan is None:
        raise ValueError("a fold that follows another needs its plan")
    plan = plan or plan_keys(df, key, max_rows, ts=order[0])
    if plan.later is None and follows:
        return df.mapInPandas(_walk(step, key, names), schema)
    if plan.later is None:
        return _sorted(df, key, order).mapInPandas(_walk(step, key, names), schema)

    rows = (
        df.withColumn("_fine", slice_number(order[0], plan.fine_s))
        .join(checked(plan.later), [*key, "_fine"], "left").drop("_fine")
        .withColumn("_chunk", F.coalesce("_chunk", F.lit(0).cast("long")))
    )
    group = [*key, "_chunk"]
    laid = cut_packed(_sorted(rows, group, order))  # read by every round and by the last walk
    return laid.mapInPandas(_walk(step, group, names, _settle(laid, plan.later, key, step)), schema)


settle_rounds = 0  # how often the chunks of the last fold were run before they settled


def _settle(laid: DataFrame, later: DataFrame, key: list[str], step: Step) -> Starts:
    """The state each chunk of the hot keys starts from. Only small per-chunk rows are kept.

    `laid` has the rows sorted within tasks; semi-joins against few chunks are broadcast and leave them so.
    """
    global settle_rounds
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    group = [*key, "_chunk"]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in group] + ["_carry string", "_base array<bigint>", "_end string", "_adds array<bigint>"])

    def run(of: DataFrame, on: list[str], starts: Starts) -> DataFrame:
        return laid.join(F.broadcast(of), on, "left_semi").mapInPandas(_last_states(step, group, starts), schema)

    done = cut(run(cut(later.select(*key).distinct()), key, {}))
    by = Window.partitionBy(*key).orderBy("_chunk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    periods = list(_additive(step).values())
    sums = [F.coalesce(F.sum(F.get("_adds", F.lit(i))).over(before), F.lit(0)) for i in range(len(periods))]
    right_base = F.array(*sums).cast("array<bigint>")
    settle_rounds = 1
    while True:
        compared = done.withColumn("_right", F.lag("_end").over(by)).withColumn("_right_base", right_base)
        off = ~F.col("_carry").eqNullSafe(F.col("_right"))
        for i, period in enumerate(periods):
            if period:
                mine = F.coalesce(F.get("_base", F.lit(i)), F.lit(0))
                off = off | (F.pmod(mine, F.lit(period)) != F.pmod(F.get("_right_base", F.lit(i)), F.lit(period)))
        wrong = cut(compared.filter(off).select(*group, "_right", "_right_base"))
        if wrong.isEmpty():
            return _starts(compared.select(*group, "_carry", "_right_base"))
        again = run(wrong.select(*group), group, _starts(wrong))
        done = cut(done.join(wrong, group, "left_anti").unionByName(again))
        settle_rounds += 1


def _starts(chunks: DataFrame) -> Starts:
    """One entry per chunk of `max_rows` rows."""
    return {tuple(r[:-2]): (r[-2], r[-1]) for r in chunks.collect()}
