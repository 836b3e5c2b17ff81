"""Campaigns that grow with every micro-batch, without a look at earlier alerts.

Between batches two small tables are kept, each as a version of its own: `sessions`, the last session of every class
and source with the campaign it belongs to, and `roots`, which says what campaigns that have since been united
are called now. A batch numbers its sessions on from the kept ones, so an alert links at most two old campaigns;
components are found among the campaigns and new sessions of the batch alone. Alerts are written once, with
the campaign of their batch, and readers look the present name up in the newest `roots`.

The result equals `campaigns` over all alerts. Batches come in order of event time (`ordered.py` sees to that on a
stream). A repeated batch reads the same older version and replaces its own, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.campaigns import component_labels, node_name
from ..operators.folds import MAX_ROWS, fold_by_key
from ..operators.salted import salted_join
from ..operators.steps import FlowCutStep, Resumed
from ..params import CorrelationParams
from ..session import cut

SESSIONS = "kind string, key string, no bigint, start bigint, last bigint, label string"
ROOTS = "label string, final string"
KINDS = {"class": "attack_class", "source": "source"}


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)  # noqa: SLF001


def _kept(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest version of a kept table, or the newest before one; empty where there is none."""
    if _exists(spark, folder):
        rows = spark.read.schema(f"{schema}, version bigint").parquet(folder)
        rows = rows if before is None else rows.filter(F.col("version") < before)
        newest = rows.agg(F.max("version")).first()[0]
        if newest is not None:
            return rows.filter(F.col("version") == newest).drop("version")
    return spark.createDataFrame([], schema)


def _numbered(al: DataFrame, kind: str, kept: DataFrame, p: CorrelationParams, max_rows: int) -> DataFrame:
    """Alerts with the number, start and campaign so far (`_root_`) of their session of one kind."""
    key = KINDS[kind]
    seed = F.to_json(F.struct(F.col("no").alias("flow"), "start", "last"))
    mine = kept.filter(F.col("kind") == kind).select(F.col("key").alias(key), seed.alias("_seed"), F.col("no").alias("_no"), F.col("label").alias("_label"))
    seeded = salted_join(al, mine, [key], "event_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seeded.schema.fields)
    step = Resumed(FlowCutStep(p.campaign_idle_s, p.campaign_max_s))
    cut_ = fold_by_key(seeded, [key], step, f"{schema}, flow bigint, opened_us bigint", max_rows=max_rows)
    root = F.when(F.col("flow") == F.col("_no"), F.col("_label")).otherwise(node_name(kind, key, "flow"))
    return cut_.withColumn(f"_root_{kind}", root).withColumnsRenamed({"flow": f"_no_{kind}", "opened_us": f"_start_{kind}"}).drop("_seed", "_no", "_label")


def campaign_batch(folder: str, p: CorrelationParams = CorrelationParams(), max_rows: int = MAX_ROWS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over alerts (event_id, ts_us, source, attack_class, score and any other columns)."""

    def run(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        roots = cut(_kept(spark, f"{folder}/roots", ROOTS, version))
        kept = _kept(spark, f"{folder}/sessions", SESSIONS, version)
        present = roots.select("label", F.col("final").alias("_final"))
        kept = cut(kept.join(present, "label", "left").withColumn("label", F.coalesce("_final", "label")).drop("_final"))
        linked = batch
        for kind in KINDS:
            linked = _numbered(linked, kind, kept, p, max_rows)
        linked = cut(linked)
        edges = linked.select(F.col("_root_class").alias("a"), F.col("_root_source").alias("b")).distinct()
        found = component_labels(edges).withColumnRenamed("node", "_root_class")
        tagged = cut(salted_join(linked, found, ["_root_class"], "event_id", "inner"))

        tagged.select(*batch.columns, "label").write.mode("overwrite").parquet(f"{folder}/alerts/version={version}")
        tagged.filter(F.col("score") >= p.campaign_min_score).select("label").distinct().write.mode("overwrite").parquet(f"{folder}/open/version={version}")

        united = found.select(F.col("_root_class").alias("_root"), F.col("label").alias("_now"))
        moved = roots.join(united, roots["final"] == united["_root"], "left").select("label", F.coalesce("_now", "final").alias("final"))
        fresh = kept.select("label").distinct().join(united, F.col("label") == F.col("_root")).filter("_root <> _now").select("label", F.col("_now").alias("final"))
        moved.unionByName(fresh).write.mode("overwrite").parquet(f"{folder}/roots/version={version}")

        newest = F.struct("ts_us", "event_id")
        ends = [
            tagged.groupBy(F.col(key).alias("key")).agg(
                F.max_by(F.struct(F.col(f"_no_{kind}").alias("no"), F.col(f"_start_{kind}").alias("start"), "label"), newest).alias("s"), F.max("ts_us").alias("last"))
            .select(F.lit(kind).alias("kind"), "key", "s.no", "s.start", "last", "s.label") for kind, key in KINDS.items()]
        seen = cut(ends[0].unionByName(ends[1]))
        kept.join(seen.select("kind", "key"), ["kind", "key"], "left_anti").unionByName(seen).write.mode("overwrite").parquet(f"{folder}/sessions/version={version}")

    return run


def campaign_stream(sdf: DataFrame, folder: str, state: str, p: CorrelationParams = CorrelationParams()) -> DataStreamWriter:
    return sdf.writeStream.foreachBatch(campaign_batch(folder, p)).option("checkpointLocation", state)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts so far with `campaign_id` as `campaigns` gives it: null where no alert of the campaign is strong enough."""
    roots = cut(_kept(spark, f"{folder}/roots", ROOTS))
    alerts = spark.read.parquet(f"{folder}/alerts").drop("version")
    named = lambda df, spread: salted_join(df, roots, ["label"], spread).withColumn("campaign_id", F.coalesce("final", "label")).drop("label", "final")
    strong = named(spark.read.schema("label string").parquet(f"{folder}/open").select("label"), "label").distinct().withColumn("_open", F.lit(True))
    out = salted_join(named(alerts, "event_id"), strong, ["campaign_id"], "event_id")
    columns = [c for c in alerts.columns if c != "label"]
    return out.select(*columns, F.when(F.col("_open"), F.col("campaign_id")).alias("campaign_id"))
