"""Vectorised steps against the same rules row by row, whole and cut into batches, with their speed."""

import random
import time

import numpy as np
import pytest

from vigilflow.operators import steps
from vigilflow.params import US, SsmParams


def by_batches(step, rows, sizes):
    """The step run batch by batch, its state carried on."""
    state, at, parts = None, 0, []
    n = len(next(iter(rows.values())))
    for size in (*sizes, n):
        part = {c: v[at:at + size] for c, v in rows.items()}
        at += size
        if len(next(iter(part.values()))):
            added, state = step(part, state)
            parts.append(added)
    return {c: np.concatenate([np.asarray(p[c]) for p in parts]) for c in parts[0]}


def cooldown(ts, wait):
    last, out = None, []
    for t in ts:
        out.append(last is None or t - last >= wait)
        last = t if out[-1] else last
    return out


def limited(ts, n, span):
    recent, out = [], []
    for t in ts:
        recent = [r for r in recent if t - r < span]
        out.append(len(recent) < n)
        if out[-1]:
            recent.append(t)
    return out


def shifts(values, last, step):
    out = []
    for v in values:
        out.append(abs(v - last) > step)
        last = v if out[-1] else last
    return out


def flow_cuts(ts, idle, active):
    start = last = None
    number, out = 0, []
    for t in ts:
        opens = last is None or t - last > idle or t - start > active
        number, start = (number + 1, t) if opens else (number, start)
        out.append((number, None if opens else (t - last) / US))
        last = t
    return out


def times(seed, n):
    """Bursts, ties and pauses."""
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 1, 2, 5, 40]) * US // rng.choice([1, 1, 4])
        out.append(t)
    return np.array(out, dtype=np.int64)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("wait", [0, 1, 3, 100])
def test_cooldown(seed, wait):
    ts = times(seed, 700)
    got = by_batches(steps.CooldownStep(wait), {"ts_us": ts}, [1, 130, 64, 65, 3])
    assert got["_keep"].tolist() == cooldown(ts.tolist(), wait * US)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("n", "span"), [(1, 2), (3, 4), (5, 30), (8, 1000), (2, 0), (0, 3)])
def test_rate_limit(seed, n, span):
    ts = times(seed, 700)
    got = by_batches(steps.RateLimitStep(n, span), {"ts_us": ts}, [1, 130, 2, 64, 1, 1, 65, 3])
    assert got["admitted"].tolist() == limited(ts.tolist(), n, span * US)


@pytest.mark.parametrize("scale", [0.0001, 0.001, 0.004, 0.02])
def test_shifts(scale):
    walk = np.cumsum(np.random.default_rng(3).normal(0, scale, 3000))
    got = by_batches(steps.ShiftStep(["a"], [0.0], 0.005), {"a": walk}, [1, 700, 64, 65, 3])
    assert got["a_shift"].tolist() == shifts(walk.tolist(), 0.0, 0.005)


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.5, 0.999, 1.0])
def test_ewma(alpha):
    rng = np.random.default_rng(4)
    rows = {"v": rng.normal(5, 2, 1500), "score": rng.random(1500)}
    got = by_batches(steps.EwmaStep("v", alpha, 0.7), rows, [1, 300, 257])
    mean, var, expected = 0.0, 0.0, []
    for x, s in zip(rows["v"], rows["score"], strict=True):
        if s < 0.7:
            gap = x - mean
            var = (1 - alpha) * (var + alpha * gap * gap)
            mean += alpha * gap
        expected.append((mean, var))
    assert np.allclose(np.column_stack([got["mean"], got["var"]]), expected, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [0.5, 30.0, 3000.0])
def test_state_space_scan(size):
    """Calm rows, some resets and clamps, nothing but these."""
    p = SsmParams()
    rng = np.random.default_rng(5)
    x = rng.normal(0, size, (900, 40)) * rng.choice([1, 1, 1, 50], (900, 1))
    got = by_batches(steps.SsmStep("v", p), {"v": list(x)}, [1, 300, 255])
    h, expected = np.zeros(32), []
    for row in x[:, :32]:
        h = steps.ssm_update(h, row, p)
        expected.append(p.c * h + p.d * row)
    assert np.allclose(got["y"], expected, rtol=1e-9, atol=1e-12)


def test_chain_of_any_jumps():
    rng = np.random.default_rng(6)
    for n in (1, 2, 63, 64, 65, 500):
        after = np.minimum(n, np.arange(1, n + 1) + rng.integers(0, rng.choice([1, 5, 90]), n))
        for start in {0, n // 2, n - 1, n}:
            at, on = start, np.zeros(n, dtype=bool)
            while at < n:
                on[at] = True
                at = after[at]
            assert (steps.chain(after, start) == on).all()


def test_rows_a_second():
    """One key of 300,000 rows; the rule row by row beside it."""
    ts = np.arange(300_000, dtype=np.int64) * US // 7

    def seconds(run):
        begin = time.perf_counter()
        run()
        return time.perf_counter() - begin

    walk = np.cumsum(np.random.default_rng(7).normal(0, 0.0002, len(ts)))
    pairs = {
        "cooldown": (lambda: steps.CooldownStep(5)({"ts_us": ts}, None), lambda: cooldown(ts.tolist(), 5 * US)),
        "rate limit": (lambda: steps.RateLimitStep(5, 60)({"ts_us": ts}, None), lambda: limited(ts.tolist(), 5, 60 * US)),
        "shift": (lambda: steps.ShiftStep(["a"], [0.0])({"a": walk}, None), lambda: shifts(walk.tolist(), 0.0, 0.005)),
    }
    for name, (ours, rule) in pairs.items():
        fast, slow = min(seconds(ours) for _ in range(3)), seconds(rule)
        print(f"{name}: {len(ts) / fast:,.0f} rows a second, row by row {len(ts) / slow:,.0f}")
        assert fast < slow


@pytest.mark.parametrize("seed", range(6))
def test_flows_are_cut_by_pauses_and_age(seed):
    ts = times(seed, 900)
    for idle, active in ((4, 30), (39, 100), (100, 12), (1, 1000)):
        want = flow_cuts(ts.tolist(), idle * US, active * US)
        for sizes in ((), (1, 1, 7, 200), (64, 63, 65, 128)):
            got = by_batches(steps.FlowCutStep(idle, active), {"ts_us": ts}, sizes)
            assert got["flow"].tolist() == [n for n, _ in want]
            assert [None if np.isnan(g) else g for g in got["gap"]] == [g for _, g in want]
