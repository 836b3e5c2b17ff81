"""Fixed values of the model on small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilflow.functions import scores, times, vectors
from vigilflow.operators import dashboards, specialists
from vigilflow.params import DECISIONS, FlushParams, Profile, Thresholds, sparse_profile
from vigilflow.sources import flow_csv, packets


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


BANDS = {
    "Ignore": (0.0, 0.15), "Log": (0.20, 0.35), "Alert": (0.40, 0.55), "Block": (0.60, 0.80, 0.85), "Escalate": (0.95, 1.0),
}


def test_decision_bands(spark):
    rows = [(s, d) for d, values in BANDS.items() for s in values]
    got = spark.createDataFrame(rows, "s double, d string").select("s", "d", scores.decide(F.col("s")).alias("g")).collect()
    assert all(r.d == r.g for r in got)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=30))
def test_decision_rises_with_score(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = sorted((r.s, r.o) for r in df.select("s", scores.strength(scores.decide(F.col("s"))).alias("o")).collect())
    assert [o for _, o in got] == sorted(o for _, o in got)


@pytest.mark.parametrize("label,expected", [
    ("Benign", True), ("benign", True), ("normal", True), ("0", True), ("", True), ("-", True), ("DoS_Hulk", False), ("PortScan", False)])
def test_benign_labels(spark, label, expected):
    assert one(spark, b=scores.is_benign(F.lit(label))).b is expected


def test_allow_list_wins(spark):
    got = one(spark, d=scores.list_override(F.lit("10.0.0.1"), F.lit("Alert"), ("10.0",), ("10.0.0.1",)))
    assert got.d == "Ignore"


@pytest.mark.parametrize("conf,full,short", [(0.95, "critical", "critical"), (0.8, "high", "high"), (0.6, "medium", "medium"), (0.2, "low", "medium")])
def test_severity(spark, conf, full, short):
    got = one(spark, a=scores.severity(F.lit(conf)), b=scores.severity(F.lit(conf), low=False))
    assert (got.a, got.b) == (full, short)


@pytest.mark.parametrize("text,number", [("12", 12.0), ("12abc", 12.0), ("-1.5e2x", -150.0), (" .5", 0.5), ("x1", 7.0), ("", 7.0)])
def test_numeric_prefix(spark, text, number):
    assert one(spark, n=scores.numeric_prefix(F.lit(text), 7.0)).n == number


@pytest.mark.parametrize("line,fields", [
    ('a,"b,c",d', ["a", "b,c", "d"]), ("a,,b", ["a", "", "b"]), ('"x""y",z', ["xy", "z"]), ('a,"b,c', ["a", "b,c"])])
def test_split_line(spark, line, fields):
    assert one(spark, f=flow_csv.split_line(F.lit(line))).f == fields


@pytest.mark.parametrize("header,kind", [
    ("flow_id,src_ip,dst_ip,label", "FlowCSV"), ("timestamp,source_ip,dest_ip,action", "CyberLog"), ("a,b", "Unknown")])
def test_formats(spark, header, kind):
    assert one(spark, k=flow_csv.detect_format(F.lit(header))).k == kind == flow_csv.spark_format(header)


def test_header_given_or_found_is_the_same(spark, tmp_path):
    text = "flow_id,src_ip,dst_ip,src_port,dst_port,protocol,label\r\n1,10.0.0.1,10.0.0.2,443,80,TCP,Benign\r\n\r\nshort,row\r\n2,10.0.0.3,10.0.0.4,1,70000,UDP,\"Port,Scan\"\n"
    (tmp_path / "a.csv").write_text(text)
    found = flow_csv.to_events(flow_csv.with_label(flow_csv.read_flow_csv(spark, str(tmp_path)))).drop("file")
    given_ = flow_csv.to_events(flow_csv.with_label(flow_csv.read_flow_csv(spark, str(tmp_path), text.split("\r\n")[0]))).drop("file")
    rows = sorted(found.collect())
    assert rows == sorted(given_.collect())
    assert [(r.port_src, r.port_dst, r.protocol, r.label) for r in rows] == [(443, 80, 6, "Benign"), (1, 4464, 17, "Port,Scan")]


def test_missing_protocol_is_udp(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flow_id,src_ip,dst_ip,duration,total_payload_bytes,label\n1,a,b,2,100,x\n")
    ev = flow_csv.to_events(flow_csv.read_flow_csv(spark, str(tmp_path))).first()
    assert (ev.protocol, ev.rate_hz, ev.entropy) == (17, 50.0, 0.3)


def test_specialists_one_event_each(spark):
    row = {"type": "net", "flags": 2, "port_dst": 443, "entropy": 0.99, "rate_hz": 6000.0, "bytes_out": 60000, "source": "a"}
    df = spark.createDataFrame([row])
    found = {r.attack_class: r for r in df.select(F.explode(specialists.results()).alias("r")).select("r.*").collect()}
    assert found["PortScan"].confidence == 0.6 and found["PortScan"].validated
    assert found["BruteForce"].confidence == 0.0 and not found["BruteForce"].validated
    assert found["DDoS"].decision == "Block" and abs(found["DDoS"].confidence - 0.9) < 1e-9
    best = df.select(specialists.fuse_consensus(specialists.results()).alias("f")).first().f
    assert best.attack_class == "DDoS" and best.details.startswith("agreed findings: [PortScan:0.60] [WebExploit:0.75]")
    first = df.select(specialists.fuse_priority(specialists.results()).alias("f")).first().f
    assert first.attack_class == "ZeroDay" and first.details.startswith("critical finding ZeroDay: ")


def test_custom_specialist(spark):
    specialists.register("beacon", lambda: specialists.result("Beacon", F.col("rate_hz") < 1, 0.99, "Alert", F.lit(True)))
    try:
        row = {"type": "net", "flags": 0, "port_dst": 1, "entropy": 0.0, "rate_hz": 0.5, "bytes_out": 0, "source": "a"}
        assert spark.createDataFrame([row]).select(specialists.fuse_consensus(specialists.results()).alias("f")).first().f.attack_class == "Beacon"
    finally:
        del specialists.SPECIALISTS["beacon"]


def test_bad_parameters():
    with pytest.raises(ValueError):
        Thresholds(ignore=0.5, log=0.4).validate()
    with pytest.raises(ValueError):
        FlushParams(max_events=0).validate()
    assert Profile().validate() and sparse_profile().slice_s == 86400.0
    assert DECISIONS.index("Escalate") == 4


@pytest.mark.parametrize("seconds,text", [(10, "just now"), (125, "2 minutes ago"), (7300, "2h 1m ago")])
def test_human_ago(spark, seconds, text):
    assert one(spark, t=scores.human_ago(F.lit(seconds))).t == text


@pytest.mark.parametrize("text,us", [
    ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01T02:00:00+02:00", 0), ("1970-01-01 00:00:00.5", 500_000), ("soon", -1)])
def test_parse_iso(spark, text, us):
    assert one(spark, t=times.parse_iso_us(F.lit(text), F.lit(-1))).t == us


def test_periods():
    assert dashboards.periods(100, 160) == ((100, 160), (40, 100))
    with pytest.raises(ValueError):
        dashboards.periods(5, 5)


def test_attention_is_bounded(spark):
    v = F.array(*[F.lit(9.0)] * 4)
    assert one(spark, s=vectors.attention_similarity(F.array(v, v), 4)).s == 1.0


@pytest.mark.parametrize("groups,text", [
    ("0:0:0:0:0:0:0:0", "::"), ("2001:db8:0:0:1:0:0:0", "2001:db8:0:0:1::"), ("1:0:0:2:0:0:3:4", "1::2:0:0:3:4"), ("0:0:0:0:0:0:0:1", "::1"), ("1:0:2:3:4:5:6:7", "1:0:2:3:4:5:6:7")])
def test_ipv6_text(spark, groups, text):
    assert one(spark, t=packets._shorten(F.lit(groups))).t == text


def test_byte_entropy(spark):
    df = spark.createDataFrame([(bytes(range(256)),), (b"aaaa",), (b"",), (None,)], "b binary")
    assert [r.e for r in df.select(packets.payload_entropy(F.col("b")).alias("e")).collect()] == [1.0, 0.0, 0.0, None]
    head = df.limit(1).select(packets.payload_entropy(F.col("b"), 2).alias("e")).first().e
    assert abs(head - 1 / 8) < 1e-12


def test_entropies_of_runs_equal_those_of_each_payload():
    rng = np.random.default_rng(2)
    made = [rng.integers(0, rng.integers(1, 257), rng.choice([0, 1, 7, 300, 5000])).astype(np.uint8).tobytes() for _ in range(200)]

    def alone(data):
        p = np.unique(np.frombuffer(data, np.uint8), return_counts=True)[1] / max(1, len(data))
        return float(-(p * np.log2(p)).sum() / 8)

    for joined in (1, 600, 1 << 20):
        assert np.allclose(packets.entropies(made, joined), [alone(d) for d in made], atol=1e-12)
    assert packets.entropies([]).tolist() == []


def test_sql_functions_equal_columns(spark, sf_dir):
    from vigilflow.functions.register import register_functions, register_views

    register_functions(spark)
    register_views(spark, sf_dir)
    got = spark.sql(
        "select count_if(score_to_decision(s.score) <> d.decision) as a, count(*) as n,"
        " count_if(abs(gate_score(s.score, trend, history, drift, similarity, size(rules) > 0) - s.g) > 1e-9) as b"
        " from (select *, 0.35D * score + 0.25D * trend + 0.15D * history + 0.1D * least(1D, drift / 10) + 0.1D * similarity"
        " + if(size(rules) > 0, 0.05D, 0D) as g from signals) s join alerts d using (event_id)").first()
    assert got.n > 0 and got.a == 0 and got.b == 0
    assert spark.sql("select round(vector_cosine(array(1D, 0D), array(1D, 1D)), 6) as c, protocol_name(58) as p, is_benign_label('NORMAL') as b").first() == (0.707107, "ICMPv6", True)


def test_only_the_first_line_is_a_header(spark, tmp_path):
    """Lines that look like a header are data; each file has its own first line."""
    from vigilflow.sources import flow_csv

    (tmp_path / "a.csv").write_text("flow_id,src_ip,dst_ip,src_port,label\n1,10.0.0.1,10.0.0.2,443,benign\nflow_id,x,y,1,attack,label\n")
    (tmp_path / "b.csv").write_text("timestamp,source_ip,dest_ip,protocol,action\nt,10.0.0.3,10.0.0.4,TCP,allow\nflow_id,a,b,c,label\n")
    (tmp_path / "c.csv").write_text("1,2,3,4,5\nflow_id,src_ip,dst_ip,src_port,label\n1,9.9.9.9,10.0.0.2,443,benign\n")
    rows = sorted((r.format, r.src_ip) for r in flow_csv.read_flow_csv(spark, str(tmp_path)).collect())
    assert rows == [("CyberLog", "10.0.0.3"), ("CyberLog", "a"), ("FlowCSV", "10.0.0.1"), ("FlowCSV", "x")]
