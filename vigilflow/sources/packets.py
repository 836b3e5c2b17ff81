"""Captured frames in a binary column decoded to addresses, ports and flags with built-in functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ETHERNET, IPV4_MIN, IPV6_LEN, TCP_MIN, UDP_LEN = 14, 20, 40, 20, 8


def number(frame: Column, at: Column | int, length: int) -> Column:
    """Unsigned big-endian number of `length` bytes from the zero-based offset."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substr(frame, start, F.lit(length))), 16, 10).cast("long")


def _ipv4(frame: Column, at: int) -> Column:
    return F.concat_ws(".", *[number(frame, at + i, 1).cast("string") for i in range(4)])


def _groups(frame: Column, at: int) -> Column:
    """Eight 16-bit groups in hexadecimal without leading zeros."""
    return F.concat_ws(":", *[F.lower(F.conv(number(frame, at + 2 * i, 2).cast("string"), 10, 16)) for i in range(8)])


def _shorten(groups: Column) -> Column:
    """Write the first longest run of zero groups as `::`."""
    text = groups
    for n in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
        text = F.when(groups.rlike(run), F.regexp_replace(groups, run, "$1::")).otherwise(text)
    return text


def decode_packets(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add source, destination, protocol, ports, TCP flags and window, length and payload offset.

    Frames that are neither IPv4 nor IPv6, or too short for their headers, are left out. Ports,
    flags and window are zero where the transport header is missing or cut off.
    """
    f, size = F.col(frame), F.length(frame)
    head = (number(f, ETHERNET, 1) % 16) * 4
    typed = df.withColumns({"_kind": F.when(size >= ETHERNET, number(f, 12, 2)), "_head": head})
    kind = F.col("_kind")
    v4 = (kind == 0x0800) & (size >= ETHERNET + IPV4_MIN) & (F.col("_head") >= IPV4_MIN) & (size >= F.col("_head") + ETHERNET)
    v6 = (kind == 0x86DD) & (size >= ETHERNET + IPV6_LEN)
    typed = typed.withColumn("_l4", F.when(v4, F.col("_head") + ETHERNET).when(v6, ETHERNET + IPV6_LEN).cast("int"))
    typed = typed.filter(F.col("_l4").isNotNull())
    four = kind == 0x0800
    named = typed.withColumns({
        "protocol": F.when(four, number(f, 23, 1)).otherwise(number(f, 20, 1)).cast("int"),
        "_src": F.when(four, _ipv4(f, 26)).otherwise(_groups(f, 22)),
        "_dst": F.when(four, _ipv4(f, 30)).otherwise(_groups(f, 38)),
    })
    rest = size - F.col("_l4")
    tcp = (F.col("protocol") == 6) & (rest >= TCP_MIN)
    udp = (F.col("protocol") == 17) & (rest >= UDP_LEN)
    at = lambda offset, n: number(f, F.col("_l4") + offset, n)
    return named.select(
        *df.columns, "protocol",
        F.when(four, F.col("_src")).otherwise(_shorten(F.col("_src"))).alias("source"),
        F.when(four, F.col("_dst")).otherwise(_shorten(F.col("_dst"))).alias("destination"),
        F.when(tcp | udp, at(0, 2)).otherwise(0).cast("int").alias("port_src"),
        F.when(tcp | udp, at(2, 2)).otherwise(0).cast("int").alias("port_dst"),
        F.when(tcp, at(13, 1)).otherwise(0).cast("int").alias("flags"),
        F.when(tcp, at(14, 2)).otherwise(0).cast("int").alias("window"),
        size.cast("long").alias("size"),
        (F.col("_l4") + 8).alias("payload_at"),
    )


def entropies(payloads: list[bytes], joined: int = 1 << 20) -> np.ndarray:
    """Entropy of each payload over eight bits, counted for runs of payloads of about `joined` bytes at once; 0 for an empty one."""
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    out = np.zeros(len(payloads))
    run = np.cumsum(sizes + 256) // joined  # 256 for a row's counters
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(payloads)] if len(payloads) else []
    for low, high in zip(edges, edges[1:], strict=False):
        size = sizes[low:high, None]
        data = np.frombuffer(b"".join(payloads[low:high]), dtype=np.uint8)
        if high - low == 1:
            counts = np.bincount(data, minlength=256)[None]
        else:
            counts = np.bincount(np.repeat(np.arange(high - low) * 256, sizes[low:high]) + data, minlength=(high - low) * 256).reshape(-1, 256)
        p = counts / np.maximum(size, 1)
        out[low:high] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1) / 8 + 0.0
    return out


@F.pandas_udf(DoubleType())
def byte_entropy(payload: pd.Series) -> pd.Series:
    """Shannon entropy of a payload's bytes over eight bits, within [0, 1]."""
    known = payload.notna()
    out = pd.Series(np.nan, index=payload.index).astype(object)
    out[known] = entropies(payload[known].tolist())
    return out.where(known, None)


def payload_entropy(payload: Column, first_bytes: int | None = None) -> Column:
    """Entropy of a binary or text column, whole or, as a sensor does, of its first bytes."""
    data = payload.cast("binary")
    return byte_entropy(data if first_bytes is None else F.substr(data, F.lit(1), F.lit(first_bytes)))
