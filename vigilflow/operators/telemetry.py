"""Operational numbers: shards, latencies, rates, flow statistics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import FLAG_FIN, FLAG_RST, FLAG_SYN, US
from ..session import cut
from . import dashboards
from .ranks import values_at_ranks
from .sliced import drop_halo, sliced_window, with_row_halo

BUCKET_US, BUCKET_COUNT = 100, 256  # fixed values of the latency histogram


def shard_of(key: Column, shards: int) -> Column:
    """Shard from the first 32 bits of the key's md5, the same in any engine."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % shards).cast("int")


def by_shard(ev: DataFrame, shards: int, key: str = "source") -> DataFrame:
    """Counters per shard and, with shard -1, for all; `skew` compares with the mean shard."""
    per = ev.groupBy(shard_of(F.col(key), shards).alias("shard")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("decision") == "Alert").alias("alerts"),
        F.count_if(F.col("decision") == "Block").alias("blocks"),
        F.count_if(F.col("decision") == "Escalate").alias("escalations"),
    )
    rolled = per.rollup("shard").agg(
        *[F.sum(c).alias(c) for c in ("events", "alerts", "blocks", "escalations")],
        F.avg("events").alias("_mean"), F.max("events").alias("_max"),
    )
    total = F.col("shard").isNull()
    whole = F.max(F.when(total, F.col("_mean"))).over(Window.partitionBy(F.lit(0)))
    return rolled.select(
        F.coalesce("shard", F.lit(-1)).alias("shard"), "events", "alerts", "blocks", "escalations",
        F.when(total, F.col("_max") / F.col("_mean")).otherwise(F.col("events") / whole).alias("skew"),
    )


def latency_histogram(df: DataFrame, stage: str, us: str) -> DataFrame:
    bucket = F.least(F.floor(F.col(us) / BUCKET_US), F.lit(BUCKET_COUNT - 1)).cast("int")
    return df.groupBy(stage, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(us).alias("_sum"), F.max(us).alias("_max"))


def latency_stats(df: DataFrame, stage: str, us: str) -> DataFrame:
    """Average, peak and the exact 99th percentile (the value that 99 % of a stage's samples do not exceed)."""
    sums = cut(df.groupBy(stage).agg(F.count(us).alias("samples"), F.avg(us).alias("avg_us"), F.max(us).alias("peak_us")))
    ranks = sums.filter("samples > 0").select(stage, (F.ceil(F.col("samples") * 0.99) - 1).cast("long").alias("rank"))
    at = values_at_ranks(df, [stage], us, ranks).select(stage, F.col("value").alias("p99_us"))
    return sums.join(at, stage, "left")


def rates(counters: DataFrame, key: list[str], names: list[str], slice_s: float, order: tuple[str, str]) -> DataFrame:
    """Per-second rates between a key's snapshots; a counter that went down was reset."""
    halo = with_row_halo(counters, key, 1, slice_s, order)
    w = sliced_window(key, order)
    elapsed = (F.col(order[0]) - F.lag(order[0]).over(w)) / US
    seconds = F.when(elapsed > 0, elapsed).otherwise(1.0)
    grown = lambda n: F.when(F.col(n) >= F.lag(n).over(w), F.col(n) - F.lag(n).over(w)).otherwise(F.col(n))
    return drop_halo(halo.withColumns({f"{n}_per_sec": grown(n) / seconds for n in names}))


FIVE_TUPLE = ["source", "destination", "port_src", "port_dst", "protocol"]


def flow_stats(packets: DataFrame, slice_s: float, key: list[str] = FIVE_TUPLE) -> DataFrame:
    """Flow statistics per five-tuple from single packets (`size`, `flags`, `ts_us`, `event_id`)."""
    halo = with_row_halo(packets, key, 1, slice_s)
    gap = (F.col("ts_us") - F.lag("ts_us").over(sliced_window(key))) / float(US)
    timed = drop_halo(halo.withColumn("_gap", gap))
    flag = lambda bit: F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) != 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return timed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("packets_total"), F.sum("size").alias("bytes_total"),
        F.avg("size").alias("packet_size_mean"), F.stddev_pop("size").alias("packet_size_std"),
        F.max("size").alias("packet_size_max"), F.min("size").alias("packet_size_min"),
        zero(F.avg("_gap")).alias("iat_mean"), zero(F.stddev_pop("_gap")).alias("iat_std"),
        zero(F.max("_gap")).alias("iat_max"), zero(F.min("_gap")).alias("iat_min"),
        flag(FLAG_SYN).alias("syn_count"), flag(FLAG_FIN).alias("fin_count"), flag(FLAG_RST).alias("rst_count"),
        flag(0x10).alias("ack_count"), ((F.max("ts_us") - F.min("ts_us")) / float(US)).alias("duration"),
    )


# ---- reports ---------------------------------------------------------------------------------

def security_summary(al: DataFrame) -> DataFrame:
    """Alerts, blocks, escalations and the worst score per UTC day."""
    day = (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(86400 * US))).alias("day_us")
    return al.groupBy(day).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("decision") == "Block").alias("blocks"),
        F.count_if(F.col("decision") == "Escalate").alias("escalations"), F.max("score").alias("max_score"),
        F.countDistinct("source").alias("sources"),
    )


def alert_analysis(al: DataFrame) -> DataFrame:
    """Every combination of class and severity with subtotals; `all` marks a total."""
    cube = al.cube("attack_class", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.avg("score").alias("mean_score"),
        F.grouping("attack_class").alias("_c"), F.grouping("severity").alias("_s"),
    )
    name = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.col(c)).alias(c)
    return cube.select(name("attack_class", "_c"), name("severity", "_s"), "alerts", "mean_score")


def protocol_mix(ev: DataFrame) -> DataFrame:
    """Events and bytes per protocol with their share of all bytes."""
    per = ev.groupBy("protocol").agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("bytes_pct", F.col("bytes") / whole * 100)


def network_traffic(ev: DataFrame, k: int = 20) -> DataFrame:
    """The protocol mix beside the `k` sources with the most bytes, as rows (part, name, events, bytes, bytes_pct)."""
    mix = protocol_mix(ev).select(F.lit("protocol").alias("part"), F.col("protocol").cast("string").alias("name"), "events", "bytes", "bytes_pct")
    whole = ev.agg(F.sum("bytes").alias("_all"))
    talkers = ev.groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes")).orderBy(
        F.col("bytes").desc(), "src_ip").limit(k)
    named = talkers.join(F.broadcast(whole), F.lit(True)).select(
        F.lit("talker").alias("part"), F.col("src_ip").alias("name"), "events", "bytes", (F.col("bytes") / F.col("_all") * 100).alias("bytes_pct"))
    return mix.unionByName(named)


def threat_intel(al: DataFrame, k: int = 20) -> DataFrame:
    """The most harmful sources: classes used, destinations hit, worst score."""
    per = al.groupBy("source").agg(
        F.count(F.lit(1)).alias("alerts"), F.countDistinct("attack_class").alias("classes"),
        F.countDistinct("destination").alias("targets"), F.max("score").alias("max_score"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )
    return per.orderBy(F.col("alerts").desc(), "source").limit(k)


REPORTS = {
    "security_summary": security_summary, "alert_analysis": alert_analysis, "threat_intel": threat_intel,
    "top_talkers": dashboards.top_talkers,
}


def report(name: str, al: DataFrame) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"report must be one of {sorted(REPORTS)}")
    return REPORTS[name](al)
