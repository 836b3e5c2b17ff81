"""Nearest signatures and nearest records by cosine or composite score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from ..session import cut

SIGNATURE_PART = 10_000


def label_signatures(embeddings: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """One known signature per label: the mean of its vectors."""
    dims = embeddings.select(label, F.posexplode(vector).alias("i", "v"))
    means = dims.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    return packed.select(F.col(label).alias("signature"), F.col("s.m").alias("vector"))


def match_signatures(df: DataFrame, signatures: DataFrame, vector: str = "embedding") -> DataFrame:
    """The signature closest to each row by cosine; the smaller signature wins a tie.

    Signatures travel in order as arrays of at most `SIGNATURE_PART`, one broadcast row each. A row
    keeps its best so far and meets the arrays in turn, so no row is multiplied by the number of
    signatures and any number gives the same result.
    """
    known = cut(signatures.select("signature", "vector").withColumn("norm", vectors.norm(F.col("vector"))))
    place = F.row_number().over(Window.orderBy("signature")) - 1  # a configured list
    parts = max(1, math.ceil(known.count() / SIGNATURE_PART))
    placed = known.withColumn("part", F.floor(place / SIGNATURE_PART)) if parts > 1 else known.withColumn("part", F.lit(0))
    start = F.struct(F.lit(-2.0).alias("cosine"), F.lit(None).cast(signatures.schema["signature"].dataType).alias("signature"))
    out = df.withColumn("_v", F.transform(vector, lambda x: x.cast("double"))).withColumn("_best", start)
    for part in range(parts):
        some = placed.filter(F.col("part") == part).agg(F.sort_array(F.collect_list(F.struct("signature", "vector", "norm"))).alias("_known"))
        scores = F.transform("_known", lambda s: F.struct(
            vectors.cosine(F.col("_v"), s["vector"], norm_b=s["norm"]).alias("cosine"), s["signature"].alias("signature")))
        best = F.aggregate(scores, F.col("_best"), lambda best, s: F.when(s["cosine"] > best["cosine"], s).otherwise(best))
        out = out.join(F.broadcast(some), F.lit(True)).withColumn("_best", best).drop("_known")
    return out.select(*df.columns, "_best.signature", "_best.cosine")
