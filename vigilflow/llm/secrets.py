"""Secrets by corpus-wide ownership.

Candidates are found by patterns. Each candidate value is counted over the whole corpus by the
distinct repositories and owners that hold it: values that several owners share are widely copied
examples, values of one owner are live-looking credentials of that owner. The counts also decide on
long mixed tokens that no base pattern covers: those of one owner that look random are reported.

Defined cases: a null text is empty and has no spans; a null repository or owner counts as one
unnamed repository or owner; a value twice in a document is two spans of one owner; repeated rows
are one owner's; other columns are kept out of the result, which has the columns named below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spans import SPAN, bound, matches

KINDS = ("assign", "access", "hex")
EXTRA = "owned"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"


def base_spans(text: Column) -> Column:
    """The three base kinds; an assignment's value is its second group, which has six characters or more."""
    lower = F.lower(text)
    named = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(lower, F.lit(word))
    # letters that only become these words in lower case (such as the Kelvin sign) are refused by the pattern itself
    assigned = matches(text, "assign", ASSIGN, named)
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    assigned = F.filter(assigned, lambda s: F.length(value(s)) >= 6)
    return F.concat(assigned, matches(text, "access", ACCESS, F.contains(text, F.lit("AKIA"))),
                    matches(text, "hex", HEX, F.rlike(text, F.lit("[0-9a-f]{24}"))))


def random_looking(value: Column) -> Column:
    """Upper, lower case and digits, and many different characters for the length."""
    letters = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]") & (letters >= 0.5 * F.least(F.length(value), F.lit(40)))


def secret_of(span: Column) -> Column:
    """What identifies a candidate: the assigned value, or the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 1)).otherwise(span["value"])


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source",
         shared_owners: int = 2) -> DataFrame:
    """(id, base spans, spans) of every row; `spans` also has the found tokens, each with its ownership.

    A span of `spans` holds kind, start, end, value, owners, repositories and `live` (its value is
    held by fewer than `shared_owners` owners). Only candidates leave a row: their hashes are
    aggregated, never the texts.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column), F.col(repository).alias("_repository"), F.col(owner).alias("_owner"), body.alias("_text"))
    loose = matches(F.col("_text"), EXTRA, LONG, F.rlike("_text", F.lit("[A-Za-z0-9+/_=-]{24}")))

    def with_long(base: Column) -> Column:
        free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.struct(base.alias("base"), F.filter(loose, lambda s: random_looking(s["value"]) & free(s)).alias("long"))

    found = cut(rows.select(F.col(id_column), "_repository", "_owner", bound(base_spans(F.col("_text")), with_long).alias("f"))
                .select(id_column, "_repository", "_owner", F.col("f.base").alias("_base"), F.col("f.long").alias("_long"), F.monotonically_increasing_id().alias("_row")))
    spans = found.select("_row", "_repository", "_owner", F.explode(F.concat("_base", "_long")).alias("s"))
    spans = spans.withColumn("_hash", F.xxhash64(secret_of(F.col("s"))))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    held = spans.groupBy("_hash", name("_owner").alias("o"), name("_repository").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("_hash", "o").agg(F.count(F.lit(1)).alias("r")).groupBy("_hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))
    judged = spans.join(held, "_hash").withColumn("live", F.col("owners") < shared_owners)
    judged = judged.filter(F.col("live") | (F.col("s.kind") != EXTRA))
    full = F.struct("s.kind", "s.start", "s.end", "s.value", "owners", "repositories", "live")
    per_row = judged.groupBy("_row").agg(F.sort_array(F.collect_list(full)).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,owners:bigint,repositories:bigint,live:boolean>>")
    return found.join(per_row, "_row", "left").select(
        F.col(id_column), F.col("_base").cast(SPAN).alias("base"), F.coalesce("spans", empty).alias("spans"))

