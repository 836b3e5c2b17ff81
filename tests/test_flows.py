"""Two-way flows against a plain loop over each conversation's packets."""

import random
import statistics

from vigilflow.operators import flows
from vigilflow.params import US, FlowParams

P = FlowParams(idle_s=5.0, active_s=20.0)
KINDS = "event_id long, ts_us long, source string, destination string, port_src int, port_dst int, protocol int, flags int, size long, window int, note string"


def packets(n: int, seed: int = 1):
    """Half of all packets belong to one conversation; times tie, ends turn, some values are missing."""
    rng, out = random.Random(seed), []
    for i in range(n):
        ends = [("10.0.0.1", 1), ("10.0.0.2", 2)] if rng.random() < 0.5 else [(f"10.0.0.{rng.randint(3, 5)}", 5), ("10.0.0.1", 443)]
        rng.shuffle(ends)
        if i % 97 == 0:
            ends = [(None, None), ends[0]]
        ts = None if i % 101 == 0 else rng.randint(0, 400) * US // 2
        out.append((i, ts, ends[0][0], ends[1][0], ends[0][1], ends[1][1], 6, rng.choice([2, 16, 18, 1, 4, None]), rng.randint(40, 1500), rng.randint(0, 99), "x"))
    rng.shuffle(out)
    return out


def by_loop(rows):
    talks = {}
    for i, ts, src, dst, sport, dport, proto, flags, size, window, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        here, there = (src or "", sport or 0), (dst or "", dport or 0)
        talk = talks.setdefault((*sorted((here, there)), proto), [])
        if not talk or ts - talk[-1][-1][1] > P.idle_s * US or ts - talk[-1][0][1] > P.active_s * US:
            talk.append([])
        talk[-1].append((i, ts, here, there, flags or 0, size, window))
    out = []
    for flow in (f for talk in talks.values() for f in talk):
        ahead = flow[0][2]
        fwd, bwd = [p for p in flow if p[2] == ahead], [p for p in flow if p[2] != ahead]
        gaps = [(b[1] - a[1]) / US for a, b in zip(flow, flow[1:])] or [0.0]
        sizes = [p[5] for p in flow]
        out.append((flow[0][0], *ahead, *flow[0][3], len(flow), len(fwd), len(bwd), sum(sizes), sum(p[5] for p in fwd), sum(p[5] for p in bwd),
                    *(sum(p[4] & bit > 0 for p in flow) for bit in (2, 1, 16, 4)), fwd[0][6], bwd[0][6] if bwd else 0,
                    round(statistics.mean(gaps), 6), round(statistics.pstdev(gaps), 6), max(gaps), min(gaps), round(statistics.pstdev(sizes), 6),
                    (flow[-1][1] - flow[0][1]) / US, len(bwd) / len(fwd)))
    return sorted(out)


def found(df, max_rows=flows.MAX_ROWS):
    names = ("event_id source port_src destination port_dst packets_total packets_fwd packets_bwd bytes_total bytes_fwd bytes_bwd syn_count fin_count ack_count"
             " rst_count fwd_init_win bwd_init_win iat_mean iat_std iat_max iat_min packet_size_std duration down_up_ratio").split()
    rows = flows.two_way_flows(df, P, max_rows).select(*names).collect()
    return sorted(tuple(round(v, 6) if n in ("iat_mean", "iat_std", "packet_size_std") else v for n, v in zip(names, r)) for r in rows)


def test_flows_equal_a_loop_however_hot_a_conversation(spark):
    rows = packets(1200)
    df, want = spark.createDataFrame(rows, KINDS), by_loop(rows)
    assert len(want) > 40 and any(w[7] > w[6] for w in want)
    assert found(df) == want
    assert found(df.repartition(7), max_rows=40) == want  # the busy conversation runs in chunks


def test_no_packets(spark):
    assert found(spark.createDataFrame([], KINDS)) == []


def test_self_talk_and_ties_have_a_direction(spark):
    rows = [(2, 0, "a", "a", 1, 1, 6, 2, 60, 7, ""), (1, 0, "a", "a", 1, 1, 6, 2, 60, 9, ""), (3, 0, "a", "b", 1, 1, 6, 2, 60, 3, ""), (4, 0, "b", "a", 1, 1, 6, 2, 60, 4, "")]
    got = found(spark.createDataFrame(rows, KINDS))
    assert got == by_loop(rows) and [g[6:8] for g in got] == [(2, 0), (1, 1)]
