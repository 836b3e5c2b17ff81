"""Repair of damaged conversations: the cheapest edits that give a lawful order of roles.

A lawful conversation has the role initials `(s?(ua)+)?`. Rows are kept, deleted, given another role
or preceded by inserted empty rows. The edits are found by iterative-deepening A*: a depth-first
search tries edits in ASCII order of their initials under a bound of cost and raises the bound to
the least cost that went beyond it until a path is accepted, so the first accepted path is the
cheapest and, of equal ones, the ASCII-least. A state (row, what the order of roles expects) that
failed is remembered with the budget it failed with. The lower bound comes from an abstraction in
which a row after the system's counts as one after the assistant's.

Conversations of up to `long_rows` rows are searched whole. Longer ones are cut by ranges of rows
into parts of about that size, in different tasks: searches from each state to each state price
every part, prices are added up from the end (sixteen numbers a part), and each part is searched
again with the price of what follows it as the cost of its ends. Only the digest of a whole
conversation, a sequential hash, streams through one task, a batch at a time.

Defined cases: null roles and texts are one space, also in what is hashed; null turns come first,
rows of one turn in order of role and text; equal rows repeat each other; rows without conversation
id are a conversation of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.salted import checked
from ..session import cut
from .common import by_key, small_batches

LONG_ROWS = 10_000
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row of the repaired conversation is
ACCEPTED = (START, ASSISTANT)
EXPECTED = (USER, USER, ASSISTANT, USER)  # the row that may be inserted or renamed in each state
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, RENAME = "D", "I", "K", "R"
DELETED, INSERTED, RENAMED, TRUNCATED = 4, 3, 3, 3  # costs
NEVER = 1 << 60
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)  # faults
WHITE = r"\x20\x09-\x0D"


def keeps(state: int, row: int) -> bool:
    """Whether a row (a state, or -1 for any other role) may follow."""
    return row == EXPECTED[state] or row == SYSTEM and state == START


class Row(NamedTuple):
    """What the search knows of a row."""

    role: int  # SYSTEM, USER, ASSISTANT, or -1
    fault: int


def _moves(row: Row | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, rows read, next state, cost) in ASCII order; `row` is None behind the last one."""
    out = [(INSERT, 0, EXPECTED[state], INSERTED)]
    if row is None:
        return out
    out.insert(0, (DELETE, 1, state, DELETED))
    if row.fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if row.fault == CUT_OFF else 0
        if keeps(state, row.role):
            out.append((KEEP, 1, row.role, extra))
        out.append((RENAME, 1, EXPECTED[state], RENAMED + extra))
    return out


MOVES = {(row, state): _moves(row, state) for row in (None, *(Row(r, f) for r in (-1, SYSTEM, USER, ASSISTANT) for f in range(4))) for state in range(4)}
ABSTRACT = (0, 1, 2, 1)  # START, after the system or the assistant, after the user


def lower_bounds(rows: Sequence[Row], ends: Sequence[int], last: bool) -> list[tuple[int, int, int]]:
    """By row and abstract state, a cost that no way to the end goes below; ends[q] is what ending in q costs."""

    def inserted(start: int, after: int, user: int) -> tuple[int, int, int]:
        after, user = min(after, user + INSERTED), min(user, after + INSERTED)
        return min(start, user + INSERTED), after, user

    here = (ends[START], min(ends[SYSTEM], ends[ASSISTANT]), ends[USER])
    if last:
        here = inserted(*here)
    out = [here]
    for row in reversed(rows):
        start, after, user = (DELETED + x for x in here)
        if row.fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if row.fault == CUT_OFF else 0
            own = extra + (0 if row.role == USER else RENAMED)
            start, after = min(start, own + here[2]), min(after, own + here[2])
            user = min(user, extra + (0 if row.role == ASSISTANT else RENAMED) + here[1])
            if row.role == SYSTEM:
                start = min(start, extra + here[1])
        here = inserted(start, after, user)
        out.append(here)
    out.reverse()
    return out


def search(rows: Sequence[Row], entry: int = START, ends: Sequence[int] = (0, NEVER, NEVER, 0), last: bool = True,
           bounds: list | None = None) -> tuple[int, str, int] | None:
    """(cost, edits, state at the end) of the cheapest path from `entry`, the ASCII-least of equal ones.

    ends[q] is the cost of ending in state q. Only in the last part of a conversation may rows be
    inserted behind its last row; elsewhere they are inserted before the next one.
    """
    n = len(rows)
    low = bounds or lower_bounds(rows, ends, last)
    bound = low[0][ABSTRACT[entry]]
    while bound < NEVER:
        beyond = NEVER
        failed: dict[tuple[int, int], int] = {}
        edits: list[str] = []
        stack = [[0, entry, 0, 0]]  # row, state, cost so far, next move
        while stack:
            top = stack[-1]
            i, state, cost, move = top
            if move == 0:
                if i == n and cost + ends[state] <= bound:
                    return cost + ends[state], "".join(edits), state
                if failed.get((i, state), -1) >= bound - cost:
                    stack.pop()
                    if edits:
                        edits.pop()
                    continue
            moves = MOVES[rows[i], state] if i < n else MOVES[None, state] if last else ()
            while move < len(moves):
                edit, read, to, price = moves[move]
                move += 1
                guess = cost + price + low[i + read][ABSTRACT[to]]
                if guess > bound:
                    beyond = min(beyond, guess)
                    continue
                top[3] = move
                stack.append([i + read, to, cost + price, 0])
                edits.append(edit)
                break
            else:
                if i == n and cost + ends[state] > bound:
                    beyond = min(beyond, cost + ends[state])
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                stack.pop()
                if edits:
                    edits.pop()
        bound = beyond
    return None


def behind_system(rows: Sequence[Row]) -> list[int]:
    """By entry, the cost of a part that ends behind the system's row: every other row goes, so nothing is searched."""
    kept = [TRUNCATED if r.fault == CUT_OFF else 0 for r in rows if r.role == SYSTEM and r.fault not in (BLANK, DUPLICATE)]
    return [DELETED * (len(rows) - 1) + min(kept) if kept else NEVER, DELETED * len(rows), NEVER, NEVER]


# ---------------------------------------------------------------- rows


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): `convs` with the damage that a checksum of the row's name picks.

    Of twenty cases 0 drops the row (it stays here as `gone`), 1 empties its text, 2 takes its full
    stops, 3 repeats it and 4 makes it the user's.
    """
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    case = (F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20).alias("case")
    rows = convs.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), case)
    text = F.when(F.col("case").isin(0, 1), "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("case") == 0).alias("gone"), F.when(F.col("case") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("_", "times")


def own_fault() -> Column:
    """The fault a row has by itself; repetitions need the rows before."""
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    return F.when(blank, BLANK).when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), CUT_OFF).otherwise(FINE)


EDITS = "conv_id bigint, part bigint, turn bigint, was string, fault int, edit string, cost bigint, role string, text string"


def _written(ident, part, frame: dict, faults: Sequence[int], path: str | None, entry: int) -> Iterator[tuple]:
    """One row for every edit, in order; rows that the damage dropped have none."""
    state, at = entry, 0
    live = [i for i, gone in enumerate(frame["gone"]) if not gone]
    for i, gone in enumerate(frame["gone"]):
        if gone:
            yield ident, part, None, None, None, None, 0, None, None
    for edit in path or "":
        if edit == INSERT:
            state = EXPECTED[state]
            yield ident, part, None, None, None, edit, INSERTED, NAMES[state], ""
            continue
        i = live[at]
        at += 1
        role, text, turn = frame["role"][i], frame["text"][i], frame["turn"][i]
        price = DELETED
        if edit != DELETE:
            price = (RENAMED if edit == RENAME else 0) + (TRUNCATED if faults[i] == CUT_OFF else 0)
            state = EXPECTED[state] if edit == RENAME else INITIALS[role[:1]]
        yield (ident, part, turn, role[:1], faults[i], edit, price,
               None if edit == DELETE else NAMES[state] if edit == RENAME else role, None if edit == DELETE else text)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict]]:
    """(key, columns as lists) of the rows of each key, the first `keys` columns, out of sorted batches."""
    key, held = None, None
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if held is None or row[:keys] != key:
                if held is not None:
                    yield key, held
                key, held = row[:keys], {n: [] for n in names[keys:]}
            for n, v in zip(names[keys:], row[keys:], strict=True):
                held[n].append(v)
    if held is not None:
        yield key, held


def _searched(frame: dict, repeated: Sequence[bool] | None) -> tuple[list[int], list[Row]]:
    """(fault of every row, the rows that are left, as the search sees them)."""
    faults, rows, seen = list(frame["fault"]), [], set()
    for i, (role, text, gone) in enumerate(zip(frame["role"], frame["text"], frame["gone"], strict=True)):
        if gone:
            continue
        if faults[i] != BLANK:
            if repeated is None:
                again = (role, text) in seen
                seen.add((role, text))
            else:
                again = repeated[i]
            if again:
                faults[i] = DUPLICATE
        rows.append(Row(INITIALS.get(role[:1], -1), faults[i]))
    return faults, rows


def _as_edits(made: Iterator[tuple], size: int = 2_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("turn", pa.int64()), ("was", pa.string()), ("fault", pa.int32()), ("edit", pa.string()),
                        ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    held = []
    for row in made:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple]:
        for (ident,), frame in _grouped(batches, 1):
            faults, rows = _searched(frame, None)
            yield from _written(ident, 0, frame, faults, search(rows)[1], START)

    return _as_edits(made())


def long_conversations(convs: DataFrame, long_rows: int) -> tuple[DataFrame | None, int]:
    """Conversations of more than `long_rows` rows, of which there are at most rows / `long_rows`, and the rows they have."""
    counts = convs.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_rows)
    found = cut(counts)
    total = found.agg(F.sum("n")).first()[0]
    return (None, 0) if not total else (found.select(F.col("conv_id").alias("_long")), total)


def edits(convs: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """The edits of each conversation, one row for each, in order inside a task.

    `edit` is its initial, `role` and `text` the repaired row (null if deleted), `was` the role's initial
    and `fault` the fault before. A conversation without rows after the damage has a row without edit.
    """
    small_batches(convs.sparkSession)
    rows = damaged(convs).withColumn("fault", own_fault())
    columns = ["turn", "role", "text", "gone", "fault"]
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    long, total = long_conversations(convs, long_rows)
    is_long = None if long is None else F.col("conv_id").eqNullSafe(F.col("_long"))
    plain = rows if long is None else rows.join(checked(long), is_long, "left_anti")
    short = plain.select("conv_id", *columns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_short, EDITS)
    if long is None:
        return short
    return short.unionByName(_long(rows.join(checked(long), is_long, "left_semi"), columns, -(-total // long_rows)))


def _long(rows: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Edits of long conversations, whose rows are cut into parts by ranges of rows."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("no")]
    ranged = cut(rows.withColumn("no", F.monotonically_increasing_id()).repartitionByRange(max(2, parts), *order)
                 .withColumn("part", F.spark_partition_id().cast("bigint")))  # written down: later readers see the same parts
    name = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    place = F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), F.col("turn").isNotNull().alias("told"), "no")
    live = ranged.filter(f"not gone and fault <> {BLANK}").select(F.col("conv_id").alias("_conv"), name.alias("_name"), place.alias("_place"))
    firsts = cut(live.groupBy("_conv", "_name").agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    again = (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("name") == F.col("_name"))
    named = ranged.withColumn("name", name).join(checked(firsts), again, "left")
    fault = F.when((F.col("fault") != BLANK) & (place > F.col("_place")), DUPLICATE).otherwise(F.col("fault"))
    known = cut(named.select("conv_id", "part", "turn", "no", "role", "text", "gone", fault.alias("fault")))

    def sorted_parts(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", *order[1:])

    def prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ident, part), frame in _grouped(batches, 2):
            coded = [Row(INITIALS.get(r[:1], -1), f) for r, f, gone in zip(frame["role"], frame["fault"], frame["gone"], strict=True) if not gone]
            out = []
            for q in range(4):
                if q == SYSTEM:
                    out.extend(behind_system(coded))
                    continue
                ends = [0 if x == q else NEVER for x in range(4)]
                low = lower_bounds(coded, ends, False)
                found = [search(coded, p, ends, False, low) for p in range(4)]
                out.extend(NEVER if f is None else f[0] for f in found)
            yield pa.RecordBatch.from_pydict({"conv_id": [ident], "part": [part], "prices": [out]},
                                             schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("prices", pa.list_(pa.int64()))]))

    slim = known.select("conv_id", "part", "turn", "role", F.lit("").alias("text"), "no", "gone", "fault")
    priced = sorted_parts(slim).select("conv_id", "part", "role", "gone", "fault").mapInArrow(prices, "conv_id bigint, part bigint, prices array<bigint>")

    def from_the_end(frame: pd.DataFrame) -> pd.DataFrame:
        """The cost of ending each part in each state: the cheapest way from there to the conversation's end."""
        frame = frame.sort_values("part", ignore_index=True)
        after = np.array([0, 2 * INSERTED, INSERTED, 0])  # behind the last row: what must be inserted to be accepted
        ends = []
        for prices in reversed(frame["prices"].tolist()):
            ends.append(after.tolist())
            after = np.minimum(NEVER, np.array(prices).reshape(4, 4).T + after).min(axis=1)
        return pd.DataFrame({"conv": frame["conv_id"], "piece": frame["part"], "ends": ends[::-1], "ending": frame["part"] == frame["part"].max()})

    def one(df: DataFrame, step, schema: str) -> DataFrame:  # a conversation's parts, sixteen numbers each
        return by_key(df.withColumn("conv_id", F.coalesce("conv_id", F.lit(-(1 << 63)))), ["conv_id"], step, schema)

    back = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    ends = cut(one(priced, from_the_end, "conv bigint, piece bigint, ends array<bigint>, ending boolean").select(back("conv"), "piece", "ends", "ending"))

    def with_ends(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(checked(table), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("piece")))

    def found(frame: dict, entries: Sequence[int]) -> list:
        coded = [Row(INITIALS.get(r[:1], -1), f) for r, f, gone in zip(frame["role"], frame["fault"], frame["gone"], strict=True) if not gone]
        last = frame["ending"][0]
        ends = (0, NEVER, NEVER, 0) if last else frame["ends"][0]
        low = lower_bounds(coded, ends, last)
        return [search(coded, p, ends, last, low) for p in entries]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ident, part), frame in _grouped(batches, 2):
            to = [p if f is None else f[2] for p, f in enumerate(found(frame, range(4)))]
            yield pa.RecordBatch.from_pydict({"conv_id": [ident], "part": [part], "prices": [to]},
                                             schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("prices", pa.list_(pa.int64()))]))

    lead = with_ends(sorted_parts(slim), ends)
    lead = sorted_parts(lead).select("conv_id", "part", "role", "gone", "fault", "ends", "ending").mapInArrow(leads, "conv_id bigint, part bigint, prices array<bigint>")

    def walked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part", ignore_index=True)
        states = [START]
        for to in frame["prices"].tolist()[:-1]:
            states.append(int(to[states[-1]]))
        return pd.DataFrame({"conv": frame["conv_id"], "piece": frame["part"], "entry": states})

    entry = cut(one(lead, walked, "conv bigint, piece bigint, entry int").select(back("conv"), "piece", "entry"))
    started = ends.join(entry.withColumnsRenamed({"conv": "_c", "piece": "_p"}), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (ident, part), frame in _grouped(batches, 2):
                first = frame["entry"][0]
                path = found(frame, [first])[0]
                yield from _written(ident, part, frame, frame["fault"], path and path[1], first)

        return _as_edits(made())

    whole = sorted_parts(with_ends(known, cut(started))).select("conv_id", "part", *columns, "ends", "ending", "entry").mapInArrow(final, EDITS)
    ordered = whole.withColumn("at", F.monotonically_increasing_id())  # grows along a part
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").drop("at")


def audits(edited: DataFrame) -> DataFrame:
    """One row per conversation from `edits`, read as a stream: counts, cost, the edits' initials and the digest."""
    schema = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held = None, None

        def close() -> None:
            turns = held["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            out.append((key, gaps, *held["faults"][1:], held["illegal"], held["cost"], "".join(held["audit"]), held["sha"].hexdigest()))

        def table() -> pa.RecordBatch:
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)},
                                              schema=pa.schema([*((n, pa.int64()) for n in names[:7]), (names[7], pa.string()), (names[8], pa.string())]))

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "was", "fault", "edit", "cost", "role", "text")]
            for ident, turn, was, fault, edit, cost, role, text in zip(*columns, strict=True):
                if held is None or ident != key:
                    if held is not None:
                        close()
                    key = ident
                    held = {"turns": None, "faults": [0] * 4, "illegal": 0, "was": None, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
                if edit is None:
                    continue
                held["audit"].append(edit)
                held["cost"] += cost
                if was is not None:
                    held["faults"][fault] += 1
                    held["illegal"] += held["was"] is not None and held["was"] + was not in ("su", "ua", "au")
                    held["was"] = was
                    if turn is not None:  # turns ascend
                        t = held["turns"]
                        held["turns"] = (turn, turn, 1) if t is None else (t[0], turn, t[2] + (turn != t[1]))
                if edit != DELETE:
                    held["sha"].update(f"{chr(10) if held['any'] else ''}{role}:{text}".encode())
                    held["any"] = True
            if len(out) >= 5_000:
                yield table()
                out = []
        if held is not None:
            close()
        if out:
            yield table()

    return edited.mapInArrow(run, schema)


def repair(convs: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """The audit of every conversation; `edits` gives the repaired rows themselves."""
    return audits(edits(convs, long_rows))
