"""Lookups and joins: rules, devices, tenants, baselines, class weights, attribution, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import FusionWeights
from ..session import cut
from .salted import checked, salted_join

RULE_PART = 5_000
SALTS = 16
SPREAD_BYTES = 32_000_000  # lists of rules above this travel by shuffle
LONG_BYTES = 8_192  # events with longer lists are dealt to tasks of their own


def _dealt(df: DataFrame, by: Column) -> DataFrame:
    """Deal rows to as few `_part`s as hold about `RULE_PART` rows each, whatever the number of shuffle partitions."""
    parts = max(1, -(-df.count() // RULE_PART))
    return df.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)))


def _ranked(df: DataFrame, column: str, rank: str, steps: DataFrame) -> DataFrame:
    """Add `rank`, how many of the distinct values `steps.step` are at most `column`; 0 for null.

    The values travel as sorted arrays of about `RULE_PART`, one broadcast row each, and are searched by halving.
    """
    parts = cut(_dealt(steps, F.col("step")).groupBy("_part").agg(F.sort_array(F.collect_list("step")).alias("_steps")).select(
        "_steps", F.size("_steps").alias("_n"), F.col("_part").alias("_at")))
    out = df.withColumn(rank, F.lit(0))
    for at, n in sorted((r["_at"], r["_n"]) for r in parts.select("_at", "_n").collect()):  # one for every RULE_PART values
        strides = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
        below = F.aggregate(strides, F.lit(0), lambda pos, stride: F.when(F.get("_steps", pos + stride - 1) <= F.col(column), pos + stride).otherwise(pos))
        some = parts.filter(F.col("_at") == at).select("_steps")
        out = out.join(F.broadcast(some), F.lit(True)).withColumn(rank, F.col(rank) + below).drop("_steps")
    return out


def _addresses(ev: DataFrame, live: DataFrame) -> DataFrame:
    """(source, _addr): the rules' address patterns that a source contains, sorted; sources without any are left out.

    Each distinct source is cut into its substrings of the lengths that patterns have, and those meet the patterns by equality.
    """
    patterns = live.filter(F.col("pattern") != "").select("pattern").distinct()
    lengths = [r[0] for r in patterns.select(F.length("pattern")).distinct().collect()]
    at = lambda n: F.when(F.length("source") >= n, F.transform(
        F.sequence(F.lit(1), F.length("source") - (n - 1)), lambda i: F.substring("source", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.flatten(F.array(*map(at, sorted(lengths))))) if lengths else F.array().cast("array<string>")
    sources = ev.select("source").distinct().withColumn("pattern", F.explode(pieces))
    return sources.join(patterns, "pattern").groupBy("source").agg(F.sort_array(F.collect_set("pattern")).alias("_addr"))


def _live(rules: DataFrame) -> DataFrame:
    """Enabled rules, each with the rank `r` of its threshold among all of them; null thresholds keep a null rank."""
    live = cut(rules.filter("enabled").select(F.col("id").cast("bigint").alias("id"), "name", "threshold", "pattern"))
    ranked = _ranked(live, "threshold", "r", _steps(live))
    return cut(ranked.withColumn("r", F.when(F.col("threshold").isNotNull(), F.col("r"))))


def _steps(live: DataFrame) -> DataFrame:
    return live.filter(F.col("threshold").isNotNull()).select(F.col("threshold").alias("step")).distinct()


def _marked(ev: DataFrame, live: DataFrame, score: str) -> DataFrame:
    """Events with what decides which rules they meet: `_rank` of the score among the thresholds and `_addr`, the patterns in the source."""
    found = checked(cut(_addresses(ev, live)))
    return _ranked(ev, score, "_rank", _steps(live)).join(found, "source", "left").withColumn(
        "_addr", F.coalesce("_addr", F.array().cast("array<string>"))).select(*ev.columns, "_rank", "_addr")


def _met(marks: DataFrame, live: DataFrame) -> DataFrame:
    """Per row of (_rank, _addr) `met`, the rules met as (id, kind, name) in order of id, kind 0 by score and 1 by address.

    Rules travel as arrays of about `RULE_PART`, one broadcast row each, and every row filters them in turn.
    """
    rule = lambda kind, name, test: F.struct("id", F.lit(kind).alias("kind"), name.alias("name"), F.col(test).alias("test"))
    scored = F.when(F.col("r").isNotNull(), rule(0, F.col("name"), "r"))
    patterned = F.when(F.col("pattern") != "", rule(1, F.concat("name", F.lit(":ip")), "pattern"))
    # by place in the materialised table, so that equal rules are dealt out too
    parts = cut(_dealt(live, F.monotonically_increasing_id()).groupBy("_part").agg(
        F.sort_array(F.collect_list(scored)).alias("_scored"), F.sort_array(F.collect_list(patterned)).alias("_patterned"),
    ).select("_scored", "_patterned", F.col("_part").alias("_at")))
    none = F.array().cast("array<struct<id: bigint, kind: int, name: string>>")
    slim = lambda c: F.transform(c, lambda r: F.struct(r["id"].alias("id"), r["kind"].alias("kind"), r["name"].alias("name")))
    out = marks.withColumn("met", none)
    places = sorted(r["_at"] for r in parts.select("_at").collect())  # one for every RULE_PART rules
    for at in places:
        some = parts.filter(F.col("_at") == at).drop("_at")
        by_score = slim(F.filter("_scored", lambda r: r["test"] <= F.col("_rank")))
        by_address = F.when(F.size("_addr") == 0, none).otherwise(slim(F.filter("_patterned", lambda r: F.array_contains("_addr", r["test"]))))
        out = out.join(F.broadcast(some), F.lit(True)).withColumn("met", F.concat("met", by_score, by_address)).drop("_scored", "_patterned")
    return out.withColumn("met", F.sort_array("met"))


def _with_lists(ev: DataFrame, rules: DataFrame, score: str, made: dict[str, Column]) -> DataFrame:
    """Events with the columns `made` from `met`, each made once for all events that meet the same rules and then looked up."""
    live = _live(rules)
    marked = _marked(ev.drop(*made), live, score)
    parts = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = cut(marked.select("_rank", "_addr").distinct()).repartition(parts, "_rank", "_addr")
    lists = cut(_met(kinds, live).select("_rank", "_addr", *[c.alias(n) for n, c in made.items()]))
    on = ["_rank", "_addr"]
    is_long = F.col("_bytes") > LONG_BYTES
    sized = cut(lists.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*made)))).select(*on, "_bytes"))
    long, short, any_long = sized.agg(*[F.coalesce(F.sum(F.when(c, F.col("_bytes"))), F.lit(0)) for c in (is_long, ~is_long)], F.max(is_long)).first()
    if not any_long or long + short <= SPREAD_BYTES:
        return _looked_up(marked, lists, score, long + short)
    # writers look at their memory after so many rows, as short as the rows before them: many short rows and then long ones fill it
    flagged = marked.join(checked(sized.select(*on, is_long.alias("_long"))), on, "left")
    kinds = lists.join(checked(sized), on)
    few = _looked_up(flagged.filter(F.coalesce(~F.col("_long"), F.lit(True))).drop("_long"), kinds.filter(~is_long).drop("_bytes"), score, short)
    return few.unionByName(_looked_up(flagged.filter("_long").drop("_long"), kinds.filter(is_long).drop("_bytes"), score, long))


def _looked_up(marked: DataFrame, lists: DataFrame, score: str, size: int) -> DataFrame:
    """Marked events with the columns of their list; lists above `SPREAD_BYTES` are shuffled."""
    on = ["_rank", "_addr"]
    if size <= SPREAD_BYTES:
        return marked.join(checked(lists), on, "left").drop(*on)
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = "event_id" if "event_id" in marked.columns else score
    # the numbers of tasks are fixed: the result is much larger than what is shuffled
    salted = marked.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).repartition(parts, *on, "_salt")
    return salted.join(lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], "left").drop(*on, "_salt")


def met_rules(ev: DataFrame, rules: DataFrame, score: str = "score", marks: bool = False) -> DataFrame:
    """Per event `met`, the enabled rules it meets as (id, kind, name) in order of id, kind 0 by score and 1 by address.

    A rule matches by score (its name) and by its address pattern (its name with `:ip`); a null
    threshold or pattern matches nothing. An event's score is placed among the distinct thresholds and its
    source among the patterns, so no event is compared with every rule; events that meet the same rules share one list.

    With `marks`, events get `_rank` and `_addr` instead, which say the same without a list; `rule_matches`
    counts those with the rules beside them.
    """
    if marks:
        return _marked(ev, _live(rules), score)
    return _with_lists(ev, rules, score, {"met": F.col("met")})


def match_rules(ev: DataFrame, rules: DataFrame, score: str = "score", made: dict[str, Column] | None = None) -> DataFrame:
    """Per event, the names of enabled rules it meets as `rules`, ordered by rule id (see `met_rules`).

    With `made`, those columns instead, made from `rules` once for all events that meet the same.
    """
    names = F.transform("met", lambda r: r["name"])
    if made is None:
        return _with_lists(ev, rules, score, {"rules": names})
    return _with_lists(ev, rules, score, {n: F.transform(F.array(names), over)[0] for n, over in made.items()})


def rule_matches(met: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(rule_id, ts_us) per hit of `met_rules`, for counting; one row per event and rule, whatever the rules' names.

    For `met_rules(..., marks=True)` and the same `rules`: (rule_id, hits, ts_us) with all hits of a rule counted, ts_us
    the last one's. Events are counted by what they meet: those by score are the running count from the
    highest rank down, and those by address alone are added per pattern.
    """
    if rules is None:
        return met.select("ts_us", F.explode(F.array_distinct(F.transform("met", lambda r: r["id"]))).alias("rule_id")).select("rule_id", "ts_us")
    # rules of one id count an event once
    live = _live(rules)
    least = live.groupBy("id").agg(F.min("r").alias("r"))
    kinds = cut(met.groupBy("_rank", "_addr").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("ts_us")))
    ranks = kinds.groupBy(F.col("_rank").alias("r")).agg(F.sum("n").alias("n"), F.max("ts_us").alias("ts_us"))
    wanted = ranks.unionByName(live.filter("r is not null").select("r").distinct().withColumns({"n": F.lit(0).cast("long"), "ts_us": F.lit(None).cast("long")}))
    down = Window.orderBy(F.col("r").desc())  # at most one row per distinct threshold
    at = wanted.groupBy("r").agg(F.sum("n").alias("n"), F.max("ts_us").alias("ts_us")).select(
        "r", F.sum("n").over(down).alias("hits"), F.max("ts_us").over(down).alias("ts_us"))
    by_score = least.join(at, "r").select(F.col("id").alias("rule_id"), "hits", "ts_us")
    patterns = live.filter(F.col("pattern") != "").select("id", "pattern").distinct().join(least, "id")
    addressed = kinds.filter(F.size("_addr") > 0).select("*", F.explode("_addr").alias("pattern"))
    only = addressed.join(patterns, "pattern").filter(F.col("r").isNull() | (F.col("_rank") < F.col("r")))
    once = only.groupBy("id", "_rank", "_addr").agg(F.first("n").alias("n"), F.first("ts_us").alias("ts_us"))
    by_address = once.groupBy(F.col("id").alias("rule_id")).agg(F.sum("n").alias("hits"), F.max("ts_us").alias("ts_us"))
    both = by_score.unionByName(by_address).groupBy("rule_id").agg(F.sum("hits").alias("hits"), F.max("ts_us").alias("ts_us"))
    return both.filter("hits > 0")


def enrich_device(df: DataFrame, devices: DataFrame, spread: str = "event_id") -> DataFrame:
    """Attach the device's name, or "unknown"."""
    names = devices.select("device", F.col("name").alias("device_name"))
    return salted_join(df, names, ["device"], spread).withColumn(
        "device_name", F.coalesce("device_name", F.lit("unknown")))


def authenticate(batch: DataFrame, devices: DataFrame, spread: str = "event_id", accepted: bool = True) -> DataFrame:
    """Rows whose device exists and whose key hashes to the stored hash; or the others."""
    keyed = batch.withColumn("key_hash", F.coalesce(F.sha2(F.col("api_key"), 256), F.lit("")))
    how = "left_semi" if accepted else "left_anti"
    return salted_join(keyed, devices.select("device", "key_hash"), ["device", "key_hash"], spread, how).drop("key_hash")


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant") == tenant)


def of_tenants(df: DataFrame, tenants: DataFrame, spread: str = "event_id") -> DataFrame:
    return salted_join(df, tenants.select("tenant").distinct(), ["tenant"], spread, "left_semi")


def with_baseline(ev: DataFrame, baselines: DataFrame, scope: str, key: str, spread: str = "event_id") -> DataFrame:
    """Attach the baseline of the event's scope key, or the global one where there is none."""
    values = [c for c in baselines.columns if c not in ("scope", "scope_key")]
    mine = baselines.filter(F.col("scope") == scope).select(F.col("scope_key").alias(key), *values)
    whole = baselines.filter(F.col("scope") == "global").agg(F.first(F.struct(*values)).alias("_global"))
    joined = salted_join(ev, mine, [key], spread).join(F.broadcast(whole), F.lit(True))
    return joined.select(*ev.columns, *[F.coalesce(F.col(v), F.col(f"_global.{v}")).alias(v) for v in values])


def class_weights(label: Column, weights: list[tuple[str, FusionWeights]], default: FusionWeights = FusionWeights()) -> Column:
    """Fusion weights of the first class contained in the label, as a struct."""
    pack = lambda w: F.struct(*[F.lit(float(v)).alias(n) for n, v in vars(w).items()])
    out = None
    for name, w in weights:
        cond = label.contains(name)
        out = F.when(cond, pack(w)) if out is None else out.when(cond, pack(w))
    return pack(default) if out is None else out.otherwise(pack(default))


def attribute(ev: DataFrame, al: DataFrame, on: str = "event_id") -> DataFrame:
    """Events with the alert raised for them, if any; matched by id, never by position."""
    theirs = al.select(on, *[F.col(c).alias(f"alert_{c}") for c in al.columns if c != on])
    return ev.join(theirs, on, "left")


def compare_alerts(a: DataFrame, b: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """Counts of alerts found on both sides with equal values, with different values, or once."""
    left = a.select(*on, F.struct(*same).alias("_a"))
    right = b.select(*on, F.struct(*same).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    return left.join(right, on, "full").agg(
        F.count_if(x.isNotNull() & y.isNotNull() & x.eqNullSafe(y)).alias("matches"),
        F.count_if(x.isNotNull() & y.isNotNull() & ~x.eqNullSafe(y)).alias("different"),
        F.count_if(y.isNull()).alias("only_replay"), F.count_if(x.isNull()).alias("only_reference"),
    ).withColumn("mismatches", F.col("different") + F.col("only_replay") + F.col("only_reference"))
