"""Flow files to alerts: numbered lines, checksums, and files that give the alerts of the same events in a table."""

import zlib

import pytest
from pyspark.sql import functions as F

from vigilflow.functions import hashes
from vigilflow.params import Profile
from vigilflow.plans import detect as plan
from vigilflow.sources import flow_csv

HEADER = "flow_id,src_ip,src_port,dst_ip,dst_port,protocol,duration,payload_bytes_mean,payload_bytes_std,syn_flag_counts,ack_flag_counts,bytes_rate,packets_rate,label"


def fnv(data: bytes) -> str:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return f"{h:x}"


def test_checksums(spark):
    values = [b"", b"a", bytes(range(256)), "héllo".encode() * 40, None]
    df = spark.createDataFrame([(v,) for v in values], "b binary")
    got = df.select(hashes.fnv1a(F.col("b")).alias("f"), hashes.crc32(F.col("b")).alias("c")).collect()
    assert [(r.f, r.c) for r in got] == [(None, None) if v is None else (fnv(v), f"{zlib.crc32(v):x}") for v in values]


def _line(i: int) -> str:
    loud = i % 9 == 0
    return f"{i},10.0.0.{i % 4},{1000 + i},192.168.0.{i % 3},{22 if loud else 443},TCP,1,{40 + i % 5},{900 if loud else 3},{i % 3},{i % 2},{90000 if loud else 10 + i % 7},{i % 50},{'DoS' if loud else 'benign'}"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("flows")
    lines = [_line(i) for i in range(360)]
    for part in range(3):
        body = lines[part * 120:(part + 1) * 120]
        (path / f"part{part}.csv").write_text("\r\n".join([HEADER, *body[:60], "", *body[60:]]) + "\n")
    return str(path)


def test_numbers_do_not_depend_on_splits(spark, folder):
    def read():
        df = flow_csv.read_flow_csv(spark, folder, number=True)
        return sorted((r.line_no, r.src_port) for r in df.select("line_no", "src_port").collect())

    want = [(i + i // 120 + 1, str(1000 + i)) for i in range(360)]  # headers take a number, empty lines do not
    assert read() == want
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for small in ("700", "2000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", small)
            assert read() == want
        lines = flow_csv._lines(spark, folder)
        index = flow_csv.line_index(lines)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        with pytest.raises(Exception, match="splits of the files changed"):
            flow_csv.numbered(flow_csv._lines(spark, folder), index).agg(F.sum("line_no")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_files_give_the_alerts_of_the_same_table(spark, folder):
    ev = flow_csv.to_events(flow_csv.with_label(flow_csv.read_flow_csv(spark, folder, number=True)), 1_700_000_000_000_000, 250_000, "t1")
    rows = ev.collect()
    assert len(rows) == 360 and {r.flags for r in rows} == {0, 2, 16, 18} and {r.tenant for r in rows} == {"t1"}
    table = spark.createDataFrame(rows, ev.schema)
    columns = ["event_id", "ts_us", "source", "attack_class", "final"]
    rules = spark.createDataFrame([(1, "watched", True, None, "10.0.0.1")], "id long, name string, enabled boolean, threshold double, pattern string")
    alerts = [sorted(plan.detect(x, Profile(), rules).select(*columns).collect()) for x in (ev, table.repartition(5))]
    assert alerts[0] == alerts[1] and len(alerts[0]) > 0
    assert "10.0.0.1" in {r.source for r in alerts[0]}


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text(HEADER + "\n")
    assert flow_csv.to_events(flow_csv.with_label(flow_csv.read_flow_csv(spark, str(tmp_path), number=True))).count() == 0
