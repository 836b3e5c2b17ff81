"""The batch steps as keyed streaming operators: same function, state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Step, dump_state, load_state, pick
from ..operators.sliced import ORDER
from ..params import US


def fold_stream(
    sdf: DataFrame, key: Sequence[str], step: Step, schema: str, names: list[str],
    order: Sequence[str] = ORDER, forget_after_s: float | None = None,
) -> DataFrame:
    """`fold_by_key` on a stream: each micro-batch continues from the state of the last one.

    A step needs its rows in order, so a key's rows of one micro-batch are sorted together; the
    source's maxFilesPerTrigger or maxBytesPerTrigger bounds them. With `forget_after_s`, the
    state of a key not seen for that long (processing time) is dropped.
    """
    order = list(order)
    idle = None if forget_after_s is None else int(forget_after_s * 1000)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        added, after = step(columns, load_state(state.get[0]) if state.exists else None)
        state.update((dump_state(after),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(pick(columns, added, names))

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return sdf.groupBy(*key).applyInPandasWithState(run, schema, "state string", "append", timeout)


def device_liveness(
    sdf: DataFrame, key: str = "device", silence_s: float = 120.0, late: str = "1 minute", at: str = "at"
) -> DataFrame:
    """(device, offline_us) whenever a device has been silent for `silence_s`.

    A silence inside a batch is reported with the batch, an open one when the watermark passes
    its end. `at` is the event's timestamp.
    """
    silence = int(silence_s * US)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        offline = []
        if state.hasTimedOut:
            offline.append(last + silence)
            state.remove()
        else:
            for ts in sorted(t for part in parts for t in part["ts_us"].tolist()):
                if last is not None and ts - last > silence:
                    offline.append(last + silence)
                last = ts if last is None else max(last, ts)
            due = (last + silence) // 1000 + 1
            if due <= state.getCurrentWatermarkMs():
                offline.append(last + silence)
                if state.exists:
                    state.remove()
            else:
                state.update((int(last),))
                state.setTimeoutTimestamp(due)
        if offline:
            yield pd.DataFrame({key: k[0], "offline_us": offline})

    timed = sdf.select(key, "ts_us", at).withWatermark(at, late)
    return timed.groupBy(key).applyInPandasWithState(
        run, f"{key} string, offline_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
