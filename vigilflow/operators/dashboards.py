"""Dashboard questions: overview, trends, categories, timelines, top talkers, usage and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..params import ONLINE_WITHIN_S, US
from .salted import salted_join


def periods(from_us: int, to_us: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """A half-open period and the equally long one before it."""
    if to_us <= from_us:
        raise ValueError("the period must not be empty")
    return (from_us, to_us), (2 * from_us - to_us, from_us)


def default_period(now_us: int, from_us: int | None = None, to_us: int | None = None, minutes: int = 15) -> tuple[int, int]:
    """Bounds given, or the last `minutes` before now."""
    return (now_us - minutes * 60 * US if from_us is None else from_us, now_us if to_us is None else to_us)


def within(period: tuple[int, int], ts: str = "ts_us") -> Column:
    return (F.col(ts) >= period[0]) & (F.col(ts) < period[1])


def _change(now: Column, before: Column) -> Column:
    return F.when(before > 0, F.round((now - before) / before * 100, 1)).otherwise(0.0)


def trend(al: DataFrame, from_us: int, to_us: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Alert counts now and in the previous period from one scan, and the change in percent."""
    now, before = periods(from_us, to_us)
    part = al.filter(within((before[0], now[1])))
    count = lambda period, cond=None: F.count_if(
        within(period) if cond is None else within(period) & cond)
    high = F.col("severity") == "high"
    grouped = part.groupBy(*keys).agg(
        count(now).alias("alerts"), count(before).alias("previous"),
        count(now, high).alias("high"), count(before, high).alias("previous_high"),
    )
    return grouped.withColumns({
        "alerts_trend": _change(F.col("alerts"), F.col("previous")),
        "high_trend": _change(F.col("high"), F.col("previous_high")),
    })


def overview(
    al: DataFrame, ev: DataFrame, dev: DataFrame, metrics: DataFrame,
    from_us: int, to_us: int, now_us: int, key: str = "tenant",
) -> DataFrame:
    """Stat cards per tenant: one conditional aggregate per table, joined on the tenant."""
    now, before = periods(from_us, to_us)
    seconds = max((to_us - from_us) / US, 1.0)
    sev = lambda s: F.count_if(within(now) & (F.col("severity") == s))
    cards = al.filter(within((before[0], now[1]))).groupBy(key).agg(
        F.count_if(within(now)).alias("total_alerts"),
        sev("high").alias("high_severity"), sev("medium").alias("medium_severity"), sev("low").alias("low_severity"),
        F.count_if(within(now) & (F.lower("decision") == "block")).alias("blocked_events"),
        F.count_if(within(before)).alias("_before"),
        F.count_if(within(before) & (F.col("severity") == "high")).alias("_before_high"),
    )
    volume = ev.filter(within(now)).groupBy(key).agg(
        F.count(F.lit(1)).alias("_events"), F.sum("bytes").alias("_bytes"))
    fleet = dev.groupBy(key).agg(
        F.count(F.lit(1)).alias("active_devices"),
        F.count_if((F.lit(now_us) - F.col("last_seen_us")) / US < ONLINE_WITHIN_S).alias("devices_online"),
    )
    latest = latest_metric(metrics, (key,)).select(key, F.col("events_per_sec").alias("_eps"), "avg_latency_us")
    joined = fleet.join(cards, key, "full").join(volume, key, "full").join(latest, key, "full")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    streamed = zero("_events") > 0
    eps = F.coalesce(F.col("_eps"), F.lit(0.0))
    gbps = F.when(streamed, F.round(zero("_bytes") * 8 / seconds / 1e9, 4)).otherwise(F.round(eps * 1024 / 1e9, 2))
    digits = lambda c: F.when(streamed, F.round(c, 4)).otherwise(F.round(c, 2))
    total = F.when(streamed, zero("_events")).otherwise(F.floor(eps * seconds).cast("long"))
    out = joined.select(
        key, *[zero(n).alias(n) for n in (
            "total_alerts", "high_severity", "medium_severity", "low_severity", "blocked_events",
            "active_devices", "devices_online")],
        _change(zero("total_alerts"), zero("_before")).alias("alerts_trend"),
        _change(zero("high_severity"), zero("_before_high")).alias("high_trend"),
        total.alias("total_events"),
        F.when(streamed, F.round(zero("_events") / seconds, 2)).otherwise(F.round(eps, 2)).alias("events_per_sec"),
        gbps.alias("traffic_gbps"), digits(gbps * 0.6).alias("traffic_in_gbps"), digits(gbps * 0.4).alias("traffic_out_gbps"),
        F.coalesce("avg_latency_us", F.lit(0.0)).alias("avg_latency_us"),
    )
    base = F.greatest("total_events", "total_alerts")
    rate = F.when(base > 0, F.round(F.col("total_alerts") / base * 100, 1)).otherwise(0.0)
    return out.withColumn("alert_rate", rate).withColumn("benign_pct", F.round(100.0 - F.col("alert_rate"), 1))


def categories(al: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Alerts per class with their share; a missing class is unknown. The share runs over classes."""
    name = F.when(F.coalesce("attack_class", F.lit("")) == "", "unknown").otherwise(F.col("attack_class"))
    counts = al.groupBy(*keys, name.alias("name")).agg(F.count(F.lit(1)).alias("count"))
    whole = F.sum("count").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", F.round(F.col("count") / whole * 100, 1)).orderBy(
        *keys, F.col("count").desc(), "name"
    )


def timeline(al: DataFrame, unit: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Alerts per UTC minute, hour or day."""
    return al.groupBy(*keys, times.bucket_us(F.col("ts_us"), unit).alias("bucket_us")).agg(
        F.count(F.lit(1)).alias("value")
    )


def top_talkers(al: DataFrame, k: int = 10) -> DataFrame:
    """Noisiest sources with their last alert and a threat score of five per alert up to 100."""
    by = F.when(F.coalesce("source", F.lit("")) == "", "unknown").otherwise(F.col("source"))
    counts = al.groupBy(by.alias("ip")).agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("ts_us").alias("last_seen_us")
    )
    top = counts.orderBy(F.col("alert_count").desc(), "ip").limit(k)
    return top.withColumn("threat_score", F.least(F.lit(100).cast("long"), F.col("alert_count") * 5))


def newest(df: DataFrame, n: int, order: tuple[str, ...] = ("ts_us", "event_id")) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def page(df: DataFrame, number: int, size: int, order: tuple[str, ...] = ("ts_us", "event_id")) -> DataFrame:
    """One newest-first page; every row also has the `total` of all rows."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("pages start at 1 and hold up to 200 rows")
    rows = df.orderBy(*[F.col(c).desc() for c in order]).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


def log_stats(lg: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("type") == kind)
    return lg.agg(
        F.count(F.lit(1)).alias("total"), of("Firewall").alias("firewall"), of("DNS").alias("dns"),
        of("HTTP").alias("http"), of("System").alias("system"),
    )


def rule_stats(rules: DataFrame, now_us: int) -> DataFrame:
    """Totals, and how many rules fired since midnight UTC."""
    midnight = now_us - now_us % (86400 * US)
    return rules.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("active"),
        F.count_if(~F.col("enabled")).alias("disabled"),
        F.count_if(F.col("last_hit_us") >= midnight).alias("triggered_today"),
    )


def device_status(dev: DataFrame, now_us: int, within_s: int = ONLINE_WITHIN_S) -> DataFrame:
    age = (F.lit(now_us) - F.col("last_seen_us")) / US
    return dev.withColumn("status", F.when(age < within_s, "online").otherwise("offline"))


def device_limit(dev: DataFrame, subs: DataFrame) -> DataFrame:
    """Devices per tenant against what its plan allows."""
    counts = dev.groupBy("tenant").agg(F.count(F.lit(1)).alias("devices"))
    return subs.select("tenant", "sensors").join(counts, "tenant", "left").na.fill(0, ["devices"]).withColumn(
        "over_limit", F.col("devices") >= F.col("sensors")
    )


def usage(ev: DataFrame, al: DataFrame) -> DataFrame:
    """Events ingested and alerts stored per tenant and calendar month."""
    count = lambda df, name: df.groupBy("tenant", times.month(F.col("ts_us")).alias("month")).agg(
        F.count(F.lit(1)).alias(name))
    both = count(ev, "events_ingested").join(count(al, "alerts_stored"), ["tenant", "month"], "full")
    return both.na.fill(0, ["events_ingested", "alerts_stored"])


def over_limit(usage_rows: DataFrame, subs: DataFrame, month: str) -> DataFrame:
    """Tenants whose month has reached the event limit of their plan."""
    return usage_rows.filter(F.col("month") == month).join(
        subs.select("tenant", "events_per_month"), "tenant"
    ).filter(F.col("events_ingested") >= F.col("events_per_month"))


def expired(df: DataFrame, subs: DataFrame, now_us: int, keep: bool = True) -> DataFrame:
    """Rows within their plan's retention, or (`keep=False`) the ones past it.

    Subscriptions hold one row per tenant; the rows are spread by event id, so a tenant that owns
    a third of them does not land in one task.
    """
    days = subs.select("tenant", "retention_days")
    joined = salted_join(df, days, ["tenant"], "event_id", "inner")
    fresh = F.col("ts_us") >= F.lit(now_us) - F.col("retention_days").cast("long") * 86400 * US
    return joined.filter(fresh if keep else ~fresh).drop("retention_days")


def latest_metric(metrics: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The newest metric row per key."""
    rest = [c for c in metrics.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("ts_us", *[c for c in ("device",) if c in rest])).alias("m")
    return metrics.groupBy(*keys).agg(best).select(*keys, "m.*")


def rule_hits(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """How often and when each rule last fired; rules that never did count zero. `matches` are single hits, or counted as `hits`."""
    counted = F.sum("hits") if "hits" in matches.columns else F.count(F.lit(1))
    hits = matches.groupBy("rule_id").agg(counted.alias("triggers"), F.max("ts_us").alias("last_hit_us"))
    return rules.join(hits, rules["id"] == hits["rule_id"], "left").drop("rule_id").na.fill(0, ["triggers"])


def decision_counts(al: DataFrame, keys: tuple[str, ...] = (), include_suppressed: bool = True) -> DataFrame:
    """Alerts by decision; without `include_suppressed`, rows marked `suppressed` are left out."""
    if not include_suppressed and "suppressed" in al.columns:
        al = al.filter(~F.coalesce(F.col("suppressed"), F.lit(False)))
    of = lambda d: F.count_if(F.col("decision") == d)
    return al.groupBy(*keys).agg(of("Alert").alias("alerts"), of("Block").alias("blocks"), of("Escalate").alias("escalations"))
