"""Equi-joins of a large side to a side with few rows per key, safe when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: str, how: str = "left", salts: int = 16
) -> DataFrame:
    """Join `big` to `small` with each key of `big` spread over `salts` tasks by column `spread`.

    `small` holds a few rows per key and is repeated once per salt; no row of `big` is repeated.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError("the small side can only be looked up")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


BROADCAST_ROWS = 50_000


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a materialised table of at most `rows` rows.

    A larger table gets no hint: its join shuffles, and adaptive execution splits a hot key of the
    other side.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small
