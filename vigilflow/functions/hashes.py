"""Checksums of keys and small blobs as column expressions: FNV-1a of 64 bits and CRC-32, both as hexadecimal text.

SHA-256, MD5 and CRC-32 are Spark's own functions. FNV-1a is a fold over the bytes, meant for keys and
configuration, not for long texts. Nulls stay null; an empty text has the checksum of no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 64-bit FNV-1a: the start as two words of 32 bits, and the prime 2**40 + 435.
FNV_HIGH, FNV_LOW = 0xCBF29CE4, 0x84222325
FNV_PRIME_LOW, FNV_PRIME_SHIFT = 435, 8  # 2**40 moves the low word up by 8 bits of the high one
WORD = 0xFFFFFFFF


def bytes_of(data: Column) -> Column:
    """The bytes of a text or binary column as an array of longs."""
    raw = data.cast("binary")
    digits = F.hex(raw)
    at = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a in lower-case hexadecimal without leading zeros.

    The state is two words, as a product of 64 bits would overflow a long.
    """

    def step(state: Column, byte: Column) -> Column:
        mixed = state["low"].bitwiseXOR(byte)
        low = mixed * FNV_PRIME_LOW
        high = state["high"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(mixed, FNV_PRIME_SHIFT)
        return F.struct(high.bitwiseAND(F.lit(WORD)).alias("high"), low.bitwiseAND(F.lit(WORD)).alias("low"))

    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("high"), F.lit(FNV_LOW).cast("long").alias("low"))
    whole = F.aggregate(bytes_of(data), start, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))
    return F.when(data.isNotNull(), F.lower(F.hex(whole)))


def crc32(data: Column) -> Column:
    """CRC-32 in lower-case hexadecimal without leading zeros."""
    return F.lower(F.hex(F.crc32(data.cast("binary"))))
