"""Steps on a stream whose rows come late and out of order.

Rows wait in state until the watermark has passed them and are then released in order of time, so a
step sees the rows it would see in a batch and gives the same result however they arrived. Keys share
`BUCKETS` groups by hash: what arrives for a group waits as one block of columns, one event-time timer
stands at the group's earliest waiting row, and each key has its own step state. So a micro-batch costs
a few calls to the state store per group and two per key released, none per row. What waits is bounded
by what arrives for a group within the allowed lateness. Rows that come later than rows already released
of their key, or have no time, cannot be put in order any more; they are counted per key and not released.
(Rows behind the watermark itself are dropped by Spark and counted in the query's progress.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, DataType, IntegralType, StructField, StructType

from ..operators import steps
from ..operators.folds import Step, _column, dump_state, load_state, pick
from ..operators.sliced import ORDER
from ..params import FlushParams, RoutingParams, SsmParams

AT, LATE, BUCKET = "at", "late_rows", "_bucket"
BUCKETS = 1024  # part of the state's key: a stream keeps the number it began with
BLOCK = 10_000
NEVER = -(2**63)  # the time of rows without one


class _InOrder(StatefulProcessor):
    """Holds the rows of a group of keys back and runs a step over each key's once the watermark has passed them."""

    def __init__(self, step: Step, waiting: StructType, key: Sequence[str], names: Sequence[str], order: Sequence[str]):
        self.step, self.waiting, self.key, self.names, self.order = step, waiting, list(key), list(names), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.waiting.fields]))
        self.timer = handle.getValueState("timer", "due bigint")
        self.kept = handle.getMapState("step", StructType([self.waiting[k] for k in self.key]), "state string, newest bigint, late bigint")

    def wake(self, first: int | None, before: int | None) -> None:
        """One timer, at the earliest waiting row; `before` is the timer that stands."""
        due = None if first is None else first // 1000 + 1
        if due is None or (before is not None and before <= due):
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            self.blocks.appendValue(tuple(_values(part[f.name], f.dataType) for f in self.waiting.fields))
            # rows without a time are counted with the next release
            earliest = part[self.order[0]].min()
            if not pd.isna(earliest):
                first = int(earliest) if first is None else min(first, int(earliest))
        stands = self.timer.get()
        self.wake(first, stands[0] if stands else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = list(self.blocks.get())
        waiting = pd.DataFrame({c: pd.Series([v for b in blocks for v in b[i]]) for i, c in enumerate(self.waiting.names)})
        waiting[self.order[0]] = waiting[self.order[0]].fillna(NEVER).astype("int64")
        ready = waiting[self.order[0]] < passed
        due, rest = waiting[ready], waiting[~ready]
        self.timer.clear()
        self.blocks.clear()
        for i in range(0, len(rest), BLOCK):
            self.blocks.appendValue(tuple(_values(rest[f.name].iloc[i:i + BLOCK], f.dataType) for f in self.waiting.fields))
        if len(rest):
            self.wake(int(rest[self.order[0]].min()), None)
        if len(due):
            yield from self.release(due)

    def release(self, due: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What the step gives for rows that the watermark has passed, key by key, in order."""
        number = due.groupby(self.key, sort=False, dropna=False).ngroup()
        due = due.assign(_key=number).sort_values(["_key", *self.order], kind="stable", ignore_index=True)
        number, time = due.pop("_key").to_numpy(), due[self.order[0]].to_numpy()
        columns = {c: due[c].to_numpy() for c in due.columns}
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(due)]
        keys = zip(*[_values(due[k].iloc[edges[:-1]], self.waiting[k].dataType) for k in self.key], strict=True)
        parts: dict[str, list] = {n: [] for n in [*self.names, LATE]}
        for k, i, j in zip(keys, edges[:-1], edges[1:], strict=True):
            state, newest, late = self.kept.getValue(k) or (None, None, 0)
            missed = int((time[i:j] <= (NEVER if newest is None else newest)).sum())
            late += missed
            if missed < j - i:
                rows = {c: v[i + missed:j] for c, v in columns.items()}
                added, after = self.step(rows, load_state(state))
                made = pick(rows, added, self.names)
                n = len(made[self.names[0]])
                for c, v in made.items():
                    parts[c].append(v)
                parts[LATE].append(np.zeros(n, dtype="int64"))
                if n:
                    parts[LATE][-1][-1], late = late, 0
                state, newest = dump_state(after), int(time[j - 1])
            self.kept.updateValue(k, (state, newest, late))
        if parts[LATE]:
            out = pd.DataFrame({c: _column(v) for c, v in parts.items()})
            out[AT] = pd.to_datetime(out[self.order[0]], unit="us")
            yield out

    def close(self) -> None:
        pass


def _values(column: pd.Series, kind: DataType) -> list:
    """Values as the state's encoder takes them; integers beside nulls come as floats."""
    if isinstance(kind, IntegralType) and column.dtype.kind == "f":
        return [None if v != v else int(v) for v in column.tolist()]
    return [_plain(v) for v in column] if column.dtype == object else column.tolist()


def _plain(value):
    if hasattr(value, "tolist"):
        return value.tolist()
    return None if value is None or value is pd.NaT else value


def fold_in_order(
    sdf: DataFrame, key: Sequence[str], step: Step, schema: str, names: Sequence[str], late: str | None, order: Sequence[str] = ORDER,
) -> DataFrame:
    """`fold_by_key` on a stream, rows of a key in order of `order` (microseconds first) within the allowed lateness.

    `names` (the columns of `schema`) must hold the first order column. Two columns are added:
    `late_rows`, rows that came too late since the key's last release, and the timestamp `at`, which
    carries the watermark on, so that another step may follow with `late` None.
    """
    timed = sdf if late is None else sdf.withColumn(AT, F.timestamp_micros(order[0])).withWatermark(AT, late)
    waiting = StructType([f for f in sdf.schema.fields if f.name not in (AT, LATE)])
    out = StructType.fromDDL(f"{schema}, {LATE} bigint, {AT} timestamp")
    grouped = timed.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")).groupBy(BUCKET)
    return grouped.transformWithStateInPandas(
        _InOrder(step, waiting, key, names, order), out, "append", "EventTime", eventTimeColumnName=AT)


SEGMENT = ("event_id bigint, ts_us bigint, source string, tenant string, segment_id bigint, events bigint, trend double, rate_mean double,"
           " error_freq double, dominant_type string, last_score double")


def segment_stream(sdf: DataFrame, late: str, p: FlushParams = FlushParams(), vector: str | None = None, ssm: SsmParams = SsmParams()) -> DataFrame:
    """Summaries of the segments that each source flushes, whatever order its events arrive in."""
    schema = SEGMENT + (", state array<double>" if vector else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return fold_in_order(sdf, ["source"], steps.SegmentSummaryStep(p, vector, ssm), schema, names, late)


def hierarchy_stream(segments: DataFrame, p: RoutingParams = RoutingParams(), ssm: SsmParams = SsmParams()) -> DataFrame:
    """Route, drift and anomaly history of every segment of `segment_stream`, per tenant."""
    schema = "event_id bigint, ts_us bigint, source string, tenant string, segment_id bigint, route string, drift double, history double"
    return fold_in_order(segments, ["tenant"], steps.HierarchyStep(p, ssm), schema, [c.split()[0] for c in schema.split(", ")], None)


def with_state_store(spark) -> None:
    """Streams of this module need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
