"""A reconstruction model that is refitted on a stream.

Every micro-batch adds the sums of its benign vectors to those of the version before it and writes
them as its own version; the model is a function of the sums. A repeated batch reads the same older
version and replaces its own, so nothing counts twice, and a version that has been read stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import reconstruction
from ..operators.reconstruction import INPUTS, MOMENTS, RANK, ReconstructionModel


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The moments of every version, one row each."""
    return spark.read.schema(f"{MOMENTS}, version bigint").parquet(folder)


def model_before(spark: SparkSession, folder: str, version: int | None = None, inputs: int = INPUTS, rank: int = RANK) -> ReconstructionModel | None:
    """The model of the newest version, or of the newest one before `version`; None where there is none."""
    row = newest_before(spark, folder, version)
    return None if row is None else reconstruction.of_moments(row, inputs, rank)


def newest_before(spark: SparkSession, folder: str, version: int | None):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # noqa: SLF001
        return None
    known = versions(spark, folder)
    return (known if version is None else known.filter(F.col("version") < version)).orderBy(F.col("version").desc()).first()


def refit(
    benign: Callable[[DataFrame], DataFrame], folder: str, vector: str = "embedding", inputs: int = INPUTS, rank: int = RANK,
    scored: Callable[[DataFrame, int], None] | None = None, local: str = "score",
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. `benign` picks the rows to learn from; `scored` gets each batch scored by the
    model as it was before that batch (the first batch, which has none, by its own).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest_before(spark, folder, batch_id)
        own = reconstruction.moments(benign(batch), vector, inputs)
        if before is not None:
            own = reconstruction.merged(own.unionByName(spark.createDataFrame([tuple(before)[:3]], MOMENTS)), inputs)
        own.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        if scored is not None:
            scored(reconstruction.score(batch, model_before(spark, folder, batch_id if before is not None else None, inputs, rank), vector, local), batch_id)

    return run


def refit_stream(sdf: DataFrame, benign: Callable[[DataFrame], DataFrame], folder: str, state: str, **options) -> DataStreamWriter:
    return sdf.writeStream.foreachBatch(refit(benign, folder, **options)).option("checkpointLocation", state)
