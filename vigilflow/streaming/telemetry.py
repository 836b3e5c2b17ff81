"""Latency sketches of a stream: every micro-batch writes its own counts, readers add them up.

A batch's folder is replaced when the batch is repeated, so nothing counts twice. `compact` adds up the
batches so far into one folder, which readers take instead of those batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import sketches


def sketch_batch(folder: str, by: Sequence[str], value: str, error: float = sketches.ERROR) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sketches.sketch(batch, by, value, error).withColumn("through", F.lit(False)).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return run


def sketch_stream(sdf: DataFrame, by: Sequence[str], value: str, folder: str, state: str, error: float = sketches.ERROR) -> DataStreamWriter:
    return sdf.writeStream.foreachBatch(sketch_batch(folder, by, value, error)).option("checkpointLocation", state)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts in force: those of the newest compacted version and of the batches after it."""
    rows = spark.read.parquet(folder)
    newest = rows.filter("through").agg(F.coalesce(F.max("version"), F.lit(-1)).alias("_newest"))
    known = rows.join(F.broadcast(newest), (F.col("version") > F.col("_newest")) | ((F.col("version") == F.col("_newest")) & F.col("through")))
    return known.drop("_newest", "through")


def read_sketch(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame:
    return sketches.merged(parts(spark, folder), by)


def compact(spark: SparkSession, folder: str, by: Sequence[str]) -> int:
    """Add up all versions into the newest one's place, beside its own counts; returns that version."""
    version = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    whole = read_sketch(spark, folder, by).withColumn("through", F.lit(True))
    whole.write.mode("append").parquet(f"{folder}/version={version}")
    return version
