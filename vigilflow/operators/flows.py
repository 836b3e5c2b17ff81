"""Two-way flows from single packets.

Both directions of a conversation share one key: the five-tuple with its two ends in order. A key's packets are
cut into flows by an idle time-out (the pause before a packet) and an active time-out (the time since
the flow's first packet); the first packet's direction is forward. Cutting is a fold over the key's packets
in time, so a key of any size runs in chunks; the statistics of a flow are one aggregate, combined
within tasks before the shuffle, so a flow of very many packets never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FLAG_ACK, FLAG_FIN, FLAG_RST, FLAG_SYN, US, FlowParams
from .folds import MAX_ROWS, fold_by_key
from .steps import FlowCutStep

KEY = ["end_a", "port_a", "end_b", "port_b", "protocol"]
PACKET = ["event_id", "ts_us", "size", "flags", "window"]


def conversations(packets: DataFrame) -> DataFrame:
    """Packets under their undirected five-tuple; `back` says that a packet goes from end b to end a."""
    here, there = F.struct(F.col("source"), F.col("port_src")), F.struct(F.col("destination"), F.col("port_dst"))
    back = here > there
    end = lambda name, one, other: F.when(F.col("_back"), F.col(other)).otherwise(F.col(one)).alias(name)
    return packets.withColumn("_back", back).select(
        end("end_a", "source", "destination"), end("port_a", "port_src", "port_dst"),
        end("end_b", "destination", "source"), end("port_b", "port_dst", "port_src"),
        "protocol", *PACKET, F.col("_back").alias("back"))


def cut_flows(packets: DataFrame, p: FlowParams = FlowParams(), max_rows: int = MAX_ROWS) -> DataFrame:
    """Packets of `conversations` with the number of their flow within the key and the seconds since the flow's packet before.

    Packets without a time belong to no flow and are left out; a missing end counts as an empty text, a missing number as 0.
    """
    timed = packets.filter(F.col("ts_us").isNotNull())
    whole = timed.na.fill("", ["source", "destination"]).na.fill(0, ["port_src", "port_dst", "protocol", "size", "flags", "window"])
    named = conversations(whole)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)
    return fold_by_key(named, KEY, FlowCutStep(p.idle_s, p.active_s), f"{schema}, flow bigint, gap double", max_rows=max_rows)


def two_way_flows(packets: DataFrame, p: FlowParams = FlowParams(), max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per flow with the statistics that flow files carry, its ends seen from the first packet.

    Packets: event_id, ts_us, source, destination, port_src, port_dst, protocol, flags, size, window, as
    `decode_packets` gives them. Times between packets are in seconds, 0 for a single packet.
    """
    timed = cut_flows(packets, p, max_rows)
    when = F.struct("ts_us", "event_id")
    side = lambda back: (F.col("back") == back)
    flag = lambda bit: F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) != 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both: list[Column] = []
    for name, back in (("a", False), ("b", True)):
        both += [
            F.count_if(side(back)).alias(f"_n_{name}"), F.coalesce(F.sum(F.when(side(back), F.col("size"))), F.lit(0)).alias(f"_bytes_{name}"),
            F.min_by(F.when(side(back), F.col("window")), F.when(side(back), when)).alias(f"_win_{name}")]
    sums = timed.groupBy(*KEY, "flow").agg(
        F.min_by("back", when).alias("_turned"), F.min("ts_us").alias("ts_us"), F.min_by("event_id", when).alias("event_id"),
        ((F.max("ts_us") - F.min("ts_us")) / float(US)).alias("duration"),
        F.count(F.lit(1)).alias("packets_total"), F.sum("size").alias("bytes_total"),
        F.avg("size").alias("packet_size_mean"), F.stddev_pop("size").alias("packet_size_std"),
        F.max("size").alias("packet_size_max"), F.min("size").alias("packet_size_min"),
        zero(F.avg("gap")).alias("iat_mean"), zero(F.stddev_pop("gap")).alias("iat_std"),
        zero(F.max("gap")).alias("iat_max"), zero(F.min("gap")).alias("iat_min"),
        flag(FLAG_SYN).alias("syn_count"), flag(FLAG_FIN).alias("fin_count"), flag(FLAG_ACK).alias("ack_count"), flag(FLAG_RST).alias("rst_count"),
        *both)
    ahead = lambda a, b: F.when(F.col("_turned"), F.col(b)).otherwise(F.col(a))
    pair = lambda fwd, bwd, a, b: {fwd: ahead(a, b), bwd: ahead(b, a)}
    turned = {
        **pair("source", "destination", "end_a", "end_b"), **pair("port_src", "port_dst", "port_a", "port_b"),
        **pair("packets_fwd", "packets_bwd", "_n_a", "_n_b"), **pair("bytes_fwd", "bytes_bwd", "_bytes_a", "_bytes_b"),
        **pair("fwd_init_win", "bwd_init_win", "_win_a", "_win_b")}
    out = sums.withColumns(turned).na.fill(0, ["fwd_init_win", "bwd_init_win"])
    return out.withColumn("down_up_ratio", F.col("packets_bwd") / F.col("packets_fwd")).drop(
        *KEY[:4], "flow", "_turned", *(f"_{c}_{s}" for c in ("n", "bytes", "win") for s in "ab"))
