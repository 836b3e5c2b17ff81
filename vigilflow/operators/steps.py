"""The per-key steps that `fold_by_key` runs in batch and the streams run per micro-batch.

Each takes the columns of one key's rows in time order and the state left by earlier rows, and
returns the columns it adds and the new state. States are plain numbers, lists and dicts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np

from ..params import (
    DECISIONS, EVENT_TYPES, SSM_DIM, US, AdaptiveParams, DecisionParams, FlushParams, RoutingParams, SsmParams,
)

# ---- rolling statistics ----------------------------------------------------------------------

# The features tracked per source, in model order.
FEATURES = ("bytes", "rate_hz", "packets_total", "packet_size_mean", "iat_mean", "syn_count")
WINDOW = 64


BLOCK = 256


def _recur(start: np.ndarray, keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """y[t] = keep[t] y[t-1] + add[t] for each column, over a short block: the running product of
    `keep` turns the recurrence into a running sum.
    """
    scale = np.cumprod(keep)[:, None]
    return scale * (start + np.cumsum(add / scale, axis=0))


def rolling_step(rows: dict, state) -> tuple[dict, object]:
    """Mean and variance per feature, with weight 1/(t+1) for the t-th row and 1/65 from row 64.

    Adds before and after values: `pm_*`/`pv_*` are those the event was met with.
    """
    x = np.column_stack([rows[f].astype(float) for f in FEATURES])
    n, width = x.shape
    start = 0 if state is None else state["n"]
    seen = np.minimum(np.arange(1, n + 1) + start, WINDOW)
    weight = 1.0 / (seen + 1)
    mean = np.zeros((n + 1, width))
    var = np.zeros((n + 1, width))
    if state is not None:
        mean[0], var[0] = state["mean"], state["var"]
    for i in range(0, n, BLOCK):
        b, w = slice(i + 1, min(i + BLOCK, n) + 1), weight[i:i + BLOCK]
        mean[b] = _recur(mean[i], 1 - w, w[:, None] * x[i:i + BLOCK])
        delta = x[i:i + BLOCK] - mean[i:i + BLOCK][: len(w)]
        var[b] = _recur(var[i], 1 - w, ((1 - w) * w)[:, None] * delta * delta)
    out = {"seen": seen}
    for p, stats in (("m", mean[1:]), ("v", var[1:]), ("pm", mean[:-1]), ("pv", var[:-1])):
        out.update({f"{p}_{f}": stats[:, i] for i, f in enumerate(FEATURES)})
    return out, {"n": int(seen[-1]) if n else start, "mean": mean[-1].tolist(), "var": var[-1].tolist()}


# ---- segments --------------------------------------------------------------------------------

class SegmentStep:
    """Flush a source's segment on count, mean score, age, session end or a change of type."""

    additive = {"segment": None}

    def __init__(self, p: FlushParams = FlushParams()):
        self.p = p

    def __call__(self, rows: dict, state):
        p = self.p
        s = state or {"segment": 0, "count": 0, "score": 0.0, "flushed": None, "type": None}
        seg, count, acc, flushed, last = s["segment"], s["count"], s["score"], s["flushed"], s["type"]
        ends = rows["session_end"] if "session_end" in rows else [False] * len(rows["ts_us"])
        numbers, flags = [], []
        for ts, score, kind, end in zip(
            rows["ts_us"].tolist(), rows["score"].tolist(), rows["type"].tolist(), ends
        ):
            count += 1
            acc += score
            aged = flushed is not None and ts - flushed >= p.max_age_s * US
            flushed = ts if flushed is None else flushed
            changed = p.on_type_change and last not in (None, "unk") and kind != last
            last = kind
            flush = (
                count >= p.max_events or acc / count > p.anomaly or aged
                or (p.on_session_end and bool(end)) or changed
            )
            numbers.append(seg)
            flags.append(flush)
            if flush:
                seg, count, acc, flushed = seg + 1, 0, 0.0, ts
        added = {"segment_id": np.array(numbers), "flushed": np.array(flags)}
        return added, {"segment": seg, "count": count, "score": acc, "flushed": flushed, "type": last}


# ---- state space recurrence ------------------------------------------------------------------

def _softplus(x):
    return np.where(x > 20, x, np.log1p(np.exp(np.minimum(x, 20))))


def ssm_update(h: np.ndarray, x: np.ndarray, p: SsmParams) -> np.ndarray:
    """One selective step of the diagonal recurrence; reset on overflow, clamp on high energy."""
    delta = _softplus(p.delta * x)
    h = np.exp(-delta * np.exp(p.a_log)) * h + delta * p.b * x
    if not np.isfinite(h).all():
        return np.zeros_like(h)
    if np.sqrt((h * h).sum()) > p.max_energy:
        h = np.clip(h, -p.clamp, p.clamp)
        if np.sqrt((h * h).sum()) > 2 * p.max_energy:
            return np.zeros_like(h)
    return h


def affine_scan(keep: np.ndarray, add: np.ndarray, start: np.ndarray) -> np.ndarray:
    """h[t] = keep[t] h[t-1] + add[t] for all rows at once.

    Row t's map is composed with the map of the rows before it in log steps, each twice as far back;
    nothing is divided, so a state that is forgotten at once does no harm.
    """
    keep, add = keep.copy(), add.copy()
    reach = 1
    while reach < len(keep):
        add[reach:] += keep[reach:] * add[:-reach]
        keep[reach:] *= keep[:-reach].copy()
        reach *= 2
    return keep * start + add


class SsmStep:
    """y = c h + d x per row over the vector column; keeps `y` as a list.

    Between resets and clamps the state is an affine map of the state before, so blocks of rows are
    scanned at once. Where a row of a block trips one, the rows before it stand, that row is
    stepped alone and the rest of the block is scanned again from there. While rows keep
    tripping, they are stepped one by one.
    """

    SCANNED, STEPPED = 256, 32  # rows of a block; rows stepped alone after a trip soon after the last one

    def __init__(self, vector: str = "embedding", p: SsmParams = SsmParams(), dim: int = SSM_DIM):
        self.vector, self.p, self.dim = vector, p, dim

    def __call__(self, rows: dict, state):
        p = self.p
        h = np.zeros(self.dim) if state is None else np.array(state)
        vectors = rows[self.vector]
        x = np.array([v[: self.dim] for v in vectors], dtype=float).reshape(len(vectors), -1)
        delta = _softplus(p.delta * x)
        keep, add = np.exp(-delta * np.exp(p.a_log)), delta * p.b * x
        states = np.empty_like(x)
        at, alone, tripped = 0, 0, -self.SCANNED
        while at < len(x):
            if alone:
                h = states[at] = ssm_update(h, x[at], p)
                at, alone = at + 1, alone - 1
                continue
            block = slice(at, min(at + self.SCANNED, len(x)))
            made = affine_scan(keep[block], add[block], h)
            with np.errstate(over="ignore", invalid="ignore"):
                bad = ~(np.sqrt((made * made).sum(axis=1)) <= p.max_energy)  # also where not finite
            good = int(np.argmax(bad)) if bad.any() else len(made)
            states[at:at + good] = made[:good]
            h = states[at + good - 1] if good else h
            at += good
            if good < len(made):
                alone = self.STEPPED if at - tripped < self.STEPPED else 1
                tripped = at
        return {"y": (p.c * states + p.d * x).tolist()}, h.tolist()


class SegmentSummaryStep:
    """One row for every flushed segment, at the row that flushes it: what `segment_summary` gives for
    whole segments, with the recurrence's output `state` there if a vector column is named.
    """

    def __init__(self, p: FlushParams = FlushParams(), vector: str | None = None, ssm: SsmParams = SsmParams()):
        self.cut = SegmentStep(p)
        self.scan = SsmStep(vector, ssm) if vector else None

    def __call__(self, rows: dict, state):
        s = state or {"cut": None, "scan": None, "open": None}
        marks, cut = self.cut(rows, s["cut"])
        scanned, scan = self.scan(rows, s["scan"]) if self.scan else ({}, None)
        score, rate, kind = np.asarray(rows["score"], dtype=float), np.asarray(rows["rate_hz"], dtype=float), list(rows["type"])
        open_ = s["open"] or {"n": 0, "score": 0.0, "rate": 0.0, "errors": 0, "types": {}}
        flushed = np.asarray(marks["flushed"], dtype=bool)
        made: dict[str, list] = {c: [None] * len(score) for c in ("events", "trend", "rate_mean", "error_freq", "dominant_type")}
        begin = 0
        for end in [*(np.flatnonzero(flushed) + 1).tolist(), len(score)]:
            part = slice(begin, end)
            types = dict(open_["types"])
            for k in kind[part]:
                types[k] = types.get(k, 0) + 1
            open_ = {"n": open_["n"] + end - begin, "score": open_["score"] + float(score[part].sum()), "rate": open_["rate"] + float(rate[part].sum()),
                     "errors": open_["errors"] + int((score[part] > 0.5).sum()), "types": types}
            if end > begin and flushed[end - 1]:
                n = open_["n"]
                best = max(types, key=lambda k: (types[k], -_ordinal(k)))
                for c, v in zip(made, (n, open_["score"] / n, open_["rate"] / n, open_["errors"] / n, best), strict=True):
                    made[c][end - 1] = v
                open_ = {"n": 0, "score": 0.0, "rate": 0.0, "errors": 0, "types": {}}
            begin = end
        added = {"_keep": flushed, "segment_id": marks["segment_id"], "last_score": score, **made}
        if self.scan:
            added["state"] = scanned["y"]
        return added, {"cut": cut, "scan": scan, "open": open_}


class SummaryStep:
    """One row for every flushed segment, at the row that flushes it, of rows that `SegmentStep` has marked; `_ord` is the type's ordinal."""

    def __call__(self, rows: dict, state):
        flushed = np.asarray(rows["flushed"], dtype=bool)
        ends = np.flatnonzero(flushed)
        open_ = state or {"n": 0, "score": [0.0, 0], "rate": [0.0, 0], "errors": 0, "types": []}
        run = np.searchsorted(ends, np.arange(len(flushed)))  # the last run may go on in later rows
        runs, score = len(ends) + 1, np.asarray(rows["score"], dtype=float)
        counted = lambda mask: np.bincount(run[mask], minlength=runs)
        n = np.bincount(run, minlength=runs)
        n[0] += open_["n"]
        errors = counted(score > 0.5)
        errors[0] += open_["errors"]
        sums = {}
        for name, values in (("score", score), ("rate", np.asarray(rows["rate_hz"], dtype=float))):
            known = ~np.isnan(values)  # a sum leaves nulls out and is null without any value
            total, found = np.bincount(run[known], values[known], minlength=runs), counted(known)
            total[0], found[0] = total[0] + open_[name][0], found[0] + open_[name][1]
            sums[name] = total, found
        before = {o: (kind, seen) for o, kind, seen in open_["types"]}
        kinds, code = np.unique([*before, *np.asarray(rows["_ord"]).tolist()], return_inverse=True)
        at = run * len(kinds) + code[len(before):]
        types = np.bincount(at, minlength=runs * len(kinds)).reshape(runs, -1)
        cells, first = np.unique(at, return_index=True)
        named = dict(zip(cells.tolist(), (rows["type"][i] for i in first), strict=True))  # types of one ordinal go by their first
        for j, (kind, seen) in zip(code.tolist(), before.values()):
            types[0, j] += seen
            named[j] = kind
        top = np.argmax(types[:-1], axis=1)  # the first of equals has the lower ordinal
        best = [named[i * len(kinds) + j] for i, j in enumerate(top.tolist())]
        mean = lambda total, found: np.where(found > 0, total / np.maximum(n, 1), np.nan)[:-1]
        added = {"_keep": flushed}
        values = {"events": n[:-1], "trend": mean(*sums["score"]), "rate_mean": mean(*sums["rate"]), "error_freq": errors[:-1] / np.maximum(n[:-1], 1),
                  "dominant_type": np.array(best, dtype=object), "last_score": score[ends]}
        for name, made in values.items():
            column = np.zeros(len(flushed), dtype=made.dtype) if made.dtype != object else np.full(len(flushed), None, dtype=object)
            column[ends] = made
            added[name] = column
        return added, {
            "n": int(n[-1]), "errors": int(errors[-1]), **{c: [float(v[-1]), int(k[-1])] for c, (v, k) in sums.items()},
            "types": [[int(o), named[(runs - 1) * len(kinds) + j], int(types[-1, j])] for j, o in enumerate(kinds) if types[-1, j]],
        }


def _ordinal(kind: str) -> int:
    return EVENT_TYPES.index(kind) if kind in EVENT_TYPES else EVENT_TYPES.index("unk")


class HierarchyStep:
    """Four levels of recurrence over a scope's segments, with drift and anomaly history."""

    def __init__(self, p: RoutingParams = RoutingParams(), ssm: SsmParams = SsmParams(), dim: int = SSM_DIM):
        self.p, self.ssm, self.dim = p, ssm, dim
        self.additive = {"tick": math.lcm(p.mid_tick, p.global_tick, p.top_tick)}

    def __call__(self, rows: dict, state):
        p, zero = self.p, [0.0] * self.dim
        s = state or {"tick": 0, "seen": 0, "h": [zero] * 4, "y": [zero] * 4, "base": zero, "hist": 0.0, "drift": 0.0}
        h = [np.array(v) for v in s["h"]]
        y = [np.array(v) for v in s["y"]]
        base, hist, drift = np.array(s["base"]), s["hist"], s["drift"]
        tick, seen = s["tick"], s["seen"]
        drifts, hists, routes = [], [], []

        def step(level, x):
            h[level] = ssm_update(h[level], x, self.ssm)
            y[level] = self.ssm.c * h[level] + self.ssm.d * x

        for vec, trend, peak in zip(rows["state"], rows["trend"].tolist(), rows["last_score"].tolist()):
            seen = min(seen + 1, p.min_segments)  # no rule asks for more
            force = peak > p.force_anomaly
            skip = trend < p.skip_threshold and seen < p.min_segments and not force
            routes.append("force" if force else "skip" if skip else "pass")
            if not skip:
                tick += 1
                step(0, np.asarray(vec, dtype=float))
                calm = hist < p.skip_threshold and drift < p.skip_drift
                if force or ((tick % p.mid_tick == 0 or hist > p.mid_anomaly or drift > p.mid_drift) and not calm):
                    step(1, y[0])
                quiet = hist < p.global_history and drift < p.global_drift
                if force or (
                    (tick % p.global_tick == 0 or drift > p.global_drift or hist > p.global_history) and not quiet
                ):
                    step(2, y[1])
                if force or tick % p.top_tick == 0 or drift > 1.5 * p.global_drift:
                    step(3, y[2])
                base = base + p.baseline_alpha * (y[3] - base)
                drift = float(np.sqrt(((y[3] - base) ** 2).sum()))
                hist += p.history_alpha * (trend - hist)
            drifts.append(drift)
            hists.append(hist)
        return {"route": routes, "drift": drifts, "history": hists}, {
            "tick": tick, "seen": seen, "h": [v.tolist() for v in h], "y": [v.tolist() for v in y],
            "base": base.tolist(), "hist": hist, "drift": drift,
        }


# ---- decisions -------------------------------------------------------------------------------

LONG_AGO = -(1 << 62)


class DecisionStep:
    """Overrides, hysteresis, cooldown and learning mode per source; null `final` means silent."""

    def __init__(self, p: DecisionParams = DecisionParams()):
        self.p = p

    def __call__(self, rows: dict, state):
        p = self.p
        s = state or {"last": None, "at": None, "n": 0, "first": None, "seen": None}
        last, at, n, first, seen = s["last"], s["at"], s["n"], s["first"], s["seen"]
        finals = []
        columns = ("source", "ts_us", "confidence", "decision", "history", "drift", "false_positive")
        for src, ts, conf, decision, history, drift, fp in zip(*(rows[c].tolist() for c in columns)):
            if fp or conf < p.min_confidence:
                finals.append(None)
                continue
            d = self._override(src, ts, decision, history, drift, n, first)
            age = None if at is None else (ts - at) / US
            held = age is not None and age < p.hold_s and last == "Block"
            if held and conf >= p.thresholds.block - p.hysteresis:
                d = "Block"
            if self._suppressed(last, age, d):
                finals.append(None)
                continue
            if p.learning and d in ("Block", "Escalate"):
                d = "Alert"
            if seen is not None and (ts - seen) / US > p.repeat_window_s:
                n, first = 0, None
            if first is not None and (ts - first) / US > p.repeat_window_s:
                n, first = 0, LONG_AGO  # no longer a repeat until the source has been quiet
            elif first is None:
                n, first = min(1, p.repeat_n), ts
            else:
                n = min(n + 1, p.repeat_n)  # no rule asks for more
            seen = ts
            last, at = d, ts
            finals.append(d)
        return {"final": finals}, {"last": last, "at": at, "n": n, "first": first, "seen": seen}

    def _override(self, src, ts, d, history, drift, n, first):
        p = self.p
        if any(a in src for a in p.allow):
            return "Ignore"
        if any(b in src for b in p.block):
            return "Block"
        if DECISIONS.index(d) < 2:
            return d
        repeated = n >= p.repeat_n and (ts - first) / US <= p.repeat_window_s
        uneasy = history >= p.escalate_history and drift >= p.escalate_drift / 2
        return "Escalate" if repeated or uneasy or drift >= p.escalate_drift else d

    def _suppressed(self, last, age, d) -> bool:
        if age is None:
            return False
        if last == "Block" and age < self.p.block_cooldown_s:
            return d != "Escalate"
        if last == "Alert" and age < self.p.alert_cooldown_s:
            return d not in ("Block", "Escalate")
        return False


def chain(after: np.ndarray, start: int, size: int = 64) -> np.ndarray:
    """Which rows lie on the chain start, after[start], after[after[start]] ...; after[i] > i, len(after) ends it.

    Slices of `size` rows are worked through side by side: first every row learns, from the slice's
    end backwards, where a chain through it leaves the slice; the chain then goes from slice to
    slice; last, each slice marks its rows from where the chain came in.
    """
    n = len(after)
    parts = -(-n // size)
    total = parts * size
    to = np.arange(1, total + 1)
    to[:n] = np.where(after < n, after, total)
    first = np.arange(parts) * size
    leaves = to.copy()
    for j in range(size - 2, -1, -1):
        at = first + j
        inside = to[at] < first + size
        leaves[at[inside]] = leaves[to[at[inside]]]
    on = np.zeros(total + 1, dtype=bool)
    while start < n:
        on[start] = True
        start = int(leaves[start])
    for j in range(size - 1):
        at = first + j
        on[to[at[on[at]]]] = True
    return on[:n]


class CooldownStep:
    """Keep a row only when its key's last kept row is at least `seconds` old.

    From every row the next one that may be kept is a binary search away; the kept rows are a chain of these.
    """

    def __init__(self, seconds: float):
        self.wait = int(seconds * US)

    def __call__(self, rows: dict, state):
        ts = np.asarray(rows["ts_us"])
        if not len(ts):
            return {"_keep": np.zeros(0, dtype=bool)}, state
        start = 0 if state is None else int(np.searchsorted(ts, state + self.wait))
        after = np.maximum(np.searchsorted(ts, ts + self.wait), np.arange(1, len(ts) + 1))
        kept = chain(after, start)
        at = np.flatnonzero(kept)
        return {"_keep": kept}, int(ts[at[-1]]) if len(at) else state


class FlowCutStep:
    """Number a key's flows, with their start and the seconds since the flow's packet before, null for its first.

    A packet opens a flow after a pause of more than `idle_s` or more than `active_s` after the flow's first
    packet. From every packet the next one to open a flow is the nearer of two searches; openers are a chain of these.
    """

    additive = {"flow": None}

    def __init__(self, idle_s: float, active_s: float | None):
        self.idle, self.active = int(idle_s * US), 2**61 if active_s is None else int(active_s * US)

    def __call__(self, rows: dict, state):
        ts = np.asarray(rows["ts_us"], dtype=np.int64)
        s = state or {"flow": 0, "start": None, "last": None}
        if not len(ts):
            return {"flow": np.zeros(0, dtype=np.int64), "gap": np.zeros(0), "opened_us": np.zeros(0, dtype=np.int64)}, s
        n, last, start = len(ts), s["last"], s["start"]
        pause = np.diff(ts, prepend=ts[0] if last is None else last)
        idle = np.flatnonzero(pause > self.idle)
        nearest = np.append(idle, n)

        def opens_after(at, first):  # the next opener behind place `at` of a flow that began at `first`
            return np.minimum(nearest[np.searchsorted(idle, at, side="right")], np.searchsorted(ts, first + self.active, side="right"))

        begin = 0 if last is None else int(opens_after(-1, start))
        opened = chain(opens_after(np.arange(n), ts), begin)
        gap = pause / US
        gap[opened] = np.nan
        count, at = np.cumsum(opened), np.flatnonzero(opened)
        number = s["flow"] + count
        starts = np.append(0 if start is None else start, ts[at])[count]
        end = {"flow": int(number[-1]), "start": int(starts[-1]), "last": int(ts[-1])}
        return {"flow": number, "gap": gap, "opened_us": starts}, end


class Resumed:
    """A step whose keys go on from a state kept elsewhere: as text in column `_seed` of a key's rows, null for a new key."""

    def __init__(self, step):
        self.step = step
        self.additive = getattr(step, "additive", {})

    def __call__(self, rows: dict, state):
        seed = rows["_seed"][0]
        if state is None and isinstance(seed, str):
            state = json.loads(seed)
        return self.step(rows, state)


class RateLimitStep:
    """Admit at most `n` rows of a key in any sliding window; refused rows do not count.

    A row with fewer than `n` rows of any kind in its window is admitted, without a look at the
    others. Elsewhere the next row to be admitted is the first after the last admitted one that
    lies a window behind the n-th last one: refused rows are jumped over.
    """

    def __init__(self, n: int, seconds: float):
        self.n, self.span = n, int(seconds * US)

    def __call__(self, rows: dict, state):
        old = list(state or [])[-self.n:] if self.n else []
        ts = np.concatenate((np.array(old, dtype=np.int64), np.asarray(rows["ts_us"], dtype=np.int64)))
        begin, total = len(old), len(ts)
        admitted = np.zeros(total, dtype=bool)
        admitted[:begin] = True
        if self.n:
            crowded = np.zeros(total, dtype=bool)
            crowded[self.n:] = ts[self.n:] - ts[: -self.n] < self.span
            crowded[:begin] = False
            places = np.flatnonzero(crowded)
            free = np.searchsorted(ts, ts + self.span)  # the first row that a row does not count for
            i, n = begin, self.n
            while i < total:
                k = int(np.searchsorted(places, i))
                calm = int(places[k]) if k < len(places) else total
                admitted[i:calm] = True
                i = calm
                if i == total:
                    break
                recent = np.flatnonzero(admitted[max(0, i - n):i])[-n:] + max(0, i - n)
                if len(recent) < n:  # refused rows lie between the admitted ones
                    recent = np.flatnonzero(admitted[:i])[-n:]
                last = recent.tolist()
                quiet = 0
                while i < total and quiet < n:  # till as many rows as count are admitted without being crowded
                    j = max(i, int(free[last[0]])) if len(last) == n else i
                    if j >= total:
                        i = total
                        break
                    admitted[j] = True
                    quiet = 0 if crowded[j] or j > i else quiet + 1
                    last = [*last[1:], j] if len(last) == n else [*last, j]
                    i = j + 1
        recent = ts[admitted][-self.n:] if self.n and total else np.zeros(0, dtype=np.int64)
        return {"admitted": admitted[begin:]}, recent[ts[-1] - recent < self.span].tolist() if total else []


class ShiftStep:
    """Flag rows where a value has moved more than `step` from the last flagged one.

    Rows without a shift are passed over in stretches that double; where shifts come close together a
    short stretch is walked.
    """

    LEAST, MOST = 16, 4096

    def __init__(self, columns: Sequence[str], start: Sequence[float], step: float = AdaptiveParams().shift):
        self.columns, self.start, self.step = list(columns), list(start), step

    def flags(self, values: np.ndarray, last: float) -> tuple[np.ndarray, float]:
        out = np.zeros(len(values), dtype=bool)
        at, stretch = 0, self.LEAST
        while at < len(values):
            if stretch <= self.LEAST:
                for i, v in enumerate(values[at:at + 4 * stretch].tolist(), at):
                    if abs(v - last) > self.step:
                        out[i], last = True, v
                moved = out[at:at + 4 * stretch].sum()
                at += 4 * stretch
                stretch = stretch if moved > 2 else 2 * stretch
                continue
            far = np.abs(values[at:at + stretch] - last) > self.step
            first = int(np.argmax(far))
            if not far[first]:
                at, stretch = at + stretch, min(2 * stretch, self.MOST)
                continue
            at += first
            out[at], last = True, float(values[at])
            at, stretch = at + 1, max(self.LEAST, first)
        return out, last

    def __call__(self, rows: dict, state):
        last = list(state or self.start)
        added = {}
        for i, c in enumerate(self.columns):
            added[f"{c}_shift"], last[i] = self.flags(np.asarray(rows[c], dtype=float), last[i])
        return added, last


class EwmaStep:
    """Running exponentially weighted mean and variance; rows at or above `freeze` do not count."""

    def __init__(self, value: str, alpha: float, freeze: float | None = None, score: str = "score"):
        self.value, self.alpha, self.freeze, self.score = value, alpha, freeze, score

    def __call__(self, rows: dict, state):
        mean, var = state or (0.0, 0.0)
        x = np.asarray(rows[self.value], dtype=float)
        counts = np.ones(len(x)) if self.freeze is None else (~(np.asarray(rows[self.score]) >= self.freeze)).astype(float)
        means, spreads = np.empty(len(x)), np.empty(len(x))
        block = max(1, min(BLOCK, int(-200 / np.log2(max(1e-9, 1 - self.alpha)) if self.alpha < 1 else 1)))
        for i in range(0, len(x), block):
            b = slice(i, i + block)
            weight = self.alpha * counts[b]
            if self.alpha >= 1:  # the last row alone
                m = np.where(counts[b] > 0, x[b], mean)
                v = np.where(counts[b] > 0, 0.0, var)
            else:
                m = _recur(np.array([mean]), 1 - weight, (weight * x[b])[:, None])[:, 0]
                gap = x[b] - np.concatenate(([mean], m[:-1]))
                v = _recur(np.array([var]), 1 - weight, ((1 - weight) * weight * gap * gap)[:, None])[:, 0]
            means[b], spreads[b] = m, v
            mean, var = float(m[-1]), float(v[-1])
        return {"mean": means, "var": spreads}, [mean, var]
