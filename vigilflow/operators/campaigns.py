"""Campaigns: alerts tied together by a shared class or source without a long pause.

Alerts of one class form a class session until it pauses longer than the idle time, and likewise
for each source. With `campaign_max_s` a session also ends at that age, as a class that never pauses would otherwise
join all sources it meets into one campaign. Every alert links its class session with its source session; a
campaign is a connected component of these links. This is the order-free closure of "joins a campaign that
shares its source or class". `streaming/campaigns.py` grows campaigns batch by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CorrelationParams
from ..session import cut
from .folds import fold_by_key
from .salted import salted_join
from .steps import FlowCutStep
from .windows import sessions


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node name of each connected component of (a, b) edges.

    Labels spread along edges and then jump to the label of their label, so the number of rounds
    grows with the logarithm of a component's diameter. Each round is one pass over the distinct
    edges, checkpointed; hub nodes are combined before the shuffle and salted in joins.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = salted_join(both, labels.withColumnRenamed("node", "b"), ["b"], "a", "inner")
        nearest = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(nearest, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = spread.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = cut(salted_join(spread, roots, ["label"], "node").select(
            "node", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def node_name(kind: str, key: str, number: str) -> Column:
    return F.concat_ws("|", F.lit(kind), F.col(key), F.lpad(F.col(number).cast("string"), 12, "0"))


def _sessions(al: DataFrame, key: str, p: CorrelationParams, slice_s: float, name: str) -> DataFrame:
    if p.campaign_max_s is None:
        return sessions(al, [key], p.campaign_idle_s, slice_s, name)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in al.schema.fields)
    return fold_by_key(al, [key], FlowCutStep(p.campaign_idle_s, p.campaign_max_s), f"{schema}, flow bigint").withColumnRenamed("flow", name)


def campaigns(
    al: DataFrame, slice_s: float, p: CorrelationParams = CorrelationParams()
) -> DataFrame:
    """Add `campaign_id` to alerts; null where no alert of the campaign is strong enough to open it."""
    named = _sessions(_sessions(al, "attack_class", p, slice_s, "_c"), "source", p, slice_s, "_s")
    linked = cut(named.withColumns({"_a": node_name("class", "attack_class", "_c"), "_b": node_name("source", "source", "_s")}))
    labels = component_labels(linked.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    tagged = salted_join(linked, labels.select(F.col("node").alias("_a"), F.col("label").alias("campaign_id")), ["_a"], "event_id")
    strong = tagged.filter(F.col("score") >= p.campaign_min_score).select("campaign_id").distinct().withColumn("_open", F.lit(True))
    opened = salted_join(tagged, strong, ["campaign_id"], "event_id")
    return opened.withColumn("campaign_id", F.when(F.col("_open"), F.col("campaign_id"))).select(*al.columns, "campaign_id")


def campaign_members(tagged: DataFrame) -> DataFrame:
    """Sources and hosts of each campaign as rows (campaign_id, kind, member)."""
    named = tagged.filter(F.col("campaign_id").isNotNull())
    pair = F.explode(F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("member")),
        F.struct(F.lit("host").alias("kind"), F.col("destination").alias("member"))))
    return named.select("campaign_id", pair.alias("m")).select("campaign_id", "m.*").distinct()


def campaign_summary(tagged: DataFrame) -> DataFrame:
    """First and last alert, size, worst score and number of sources and hosts per campaign."""
    named = tagged.filter(F.col("campaign_id").isNotNull())
    facts = named.groupBy("campaign_id").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("events"), F.max("score").alias("max_score"))
    members = campaign_members(tagged).groupBy("campaign_id").agg(
        F.count_if(F.col("kind") == "source").alias("sources"), F.count_if(F.col("kind") == "host").alias("hosts"))
    return facts.join(members, "campaign_id")
