"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns give seed entities. The two words before an entity are a lexical pattern. A graph
links patterns with instances (identifier-like tokens); scores travel over it in rounds: a pattern
is trusted as far as its instances, without those that are unknown but of the kind's shape, are
known to be of one kind, an instance as far as a trusted
pattern proposes it. Instances that trusted patterns propose and no base pattern covers are added.

Defined cases: a null text is empty; a token at the start of a text has the pattern of the missing
words; repeated rows support a pattern once per distinct value; a value proposed for two kinds goes
to the better score, ties to the first kind; other columns never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import others, packed, unpacked
from .spans import bound, matches, none, running

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: Java forms of the base patterns; a run is entered at its start only, which finds the same matches in linear time.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*+"

#: Digit groups of 6 to 19 digits joined by blanks and the like; an identifier when a blank is among them.
GROUPS = r"(?<![^\x20\x09-\x0D])[+(]?[0-9](?:[\x20().-]{0,3}[0-9]){5,18}(?![0-9A-Za-z])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    places = F.transform(F.split(F.reverse(digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column, context: bool = False) -> Column:
    some_digit = F.rlike(text, F.lit("[0-9]"))
    email = matches(text, "email", EMAIL, F.contains(text, F.lit("@")), context)
    small = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$"))
    ip = F.filter(matches(text, "ip", IP, some_digit & F.rlike(text, F.lit(r"[0-9]\.[0-9]")), context), small)
    card = F.filter(matches(text, "card", CARD, some_digit, context), lambda s: luhn(s["value"]))
    phone = F.filter(matches(text, "phone", PHONE, F.contains(text, F.lit("+")), context),
                     lambda s: F.length(digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def shape_fits(kind: Column, value: Column) -> Column:
    """What a proposed value must have in common with its kind."""
    n = F.length(digits(value))
    return (F.when(kind == "email", F.contains(value, F.lit("@")) & (F.length(value) >= 5))
            .when(kind == "ip", value.rlike(r"^[0-9A-Fa-f.:]+$") & (n >= 4))
            .when(kind == "card", n >= 8).otherwise(n.between(6, 15)))


def strictly_fits(kind: Column, value: Column) -> Column:
    """What an unknown value must look like not to speak against its kind."""
    n = F.length(digits(value))
    return (F.when(kind == "email", F.contains(value, F.lit("@")) & (F.length(value) >= 5))
            .when(kind == "ip", value.rlike(r"^[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){2,}$") & (n >= 4))
            .when(kind == "card", value.rlike(r"^[0-9][0-9\x20-]*$") & n.between(12, 19))
            .otherwise(value.rlike(r"^[+(]?[0-9][0-9()./\x20-]*$") & n.between(6, 15)))


def last_words(before: Column) -> Column:
    """The last two words on the line before an entity, in lower case: the lexical pattern."""
    return F.lower(F.regexp_extract(before, r"([^\s]*)[\x20\t]*([^\s]*)[\x20\t]*$", 0))


def extract(docs: DataFrame, text: str = "text", rounds: int = 2, least_score: float = 0.9,
            least_values: int = 5) -> DataFrame:
    """All rows of `docs` with `base` and `spans` (arrays of kind, start, end, value).

    A pattern is trusted when it stands before `least_values` distinct values of a kind and this
    kind's share of the distinct values after it, weighed by their scores and smoothed by half a
    value, is `least_score` or more. Values of no known kind that have the kind's shape do not count.
    """
    keep = others(docs, "base", "spans")
    whole = docs.select(packed(keep), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    tokens = matches(F.col("_text"), "token", TOKEN, F.rlike("_text", F.lit("[0-9@]")), context=True)
    trimmed = F.transform(tokens, lambda s: F.struct(
        s["kind"].alias("kind"),
        (s["start"] + F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^A-Za-z0-9+]+", ""))).alias("start"),
        (s["end"] - F.length(s["value"]) + F.length(F.regexp_replace(s["value"], r"[^A-Za-z0-9]+$", ""))).alias("end"),
        F.regexp_replace(F.regexp_replace(s["value"], r"^[^A-Za-z0-9+]+", ""), r"[^A-Za-z0-9]+$", "").alias("value"), s["before"].alias("before")))

    spaced = matches(F.col("_text"), "token", GROUPS, F.rlike("_text", F.lit(r"[0-9]\)?[\x20][\x20(.-]*[0-9]")), context=True)

    def with_loose(base: Column) -> Column:
        outside = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        groups = F.filter(spaced, lambda s: F.contains(s["value"], F.lit(" ")) & outside(s))
        return F.concat(base, F.filter(trimmed, lambda s: (s["end"] - s["start"] >= 5) & outside(s)), groups)

    seen = bound(base_spans(F.col("_text"), context=True), with_loose)
    named = bound(F.md5("_text"), lambda row: F.transform(seen, lambda s: F.struct(row.alias("row"), s.alias("span"))))  # once per text
    slim = cut(whole.select(F.explode_outer(named).alias("m")).filter("m is not null").select(F.col("m.row").alias("_row"), "m.span.*"))
    mentions = slim.select("_row", "kind", "start", "end", "value", last_words(F.col("before")).alias("pattern")).distinct()
    graph = cut(mentions.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")))
    seeds = graph.filter(F.col("kind") != "token").select("value", F.col("kind").alias("of"), F.lit(1.0).alias("score")).distinct()
    loose = graph.filter("kind = 'token'").select("pattern", "value")
    totals = graph.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("values"))
    known, trusted = seeds, None
    for _ in range(rounds):
        support = graph.select("pattern", "value").distinct().join(known, "value").groupBy("pattern", "of").agg(
            F.sum("score").alias("mass"), F.count(F.lit(1)).alias("held"))
        ready = cut(support.filter((F.col("held") >= least_values) & (F.trim("pattern") != "")))
        fitting = loose.distinct().join(ready.select("pattern", "of"), "pattern").filter(strictly_fits(F.col("of"), F.col("value")))
        unknown = fitting.join(known.select("value").distinct(), "value", "left_anti").groupBy("pattern", "of").agg(F.count(F.lit(1)).alias("unknown"))
        judged = ready.join(totals, "pattern").join(unknown, ["pattern", "of"], "left")
        trust = F.col("mass") / (F.col("values") - F.coalesce("unknown", F.lit(0)) + 0.5)
        trusted = cut(judged.withColumn("trust", trust).filter(F.col("trust") >= least_score).select("pattern", "of", "trust"))
        proposed = loose.join(trusted, "pattern").filter(shape_fits(F.col("of"), F.col("value")))
        better = proposed.groupBy("value", "of").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("trust"))))).alias("score"))
        known = cut(seeds.unionByName(better).groupBy("value", "of").agg(F.max("score").alias("score")))
    no = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("of"))
    added = mentions.filter("kind = 'token'").join(trusted, "pattern").filter(shape_fits(F.col("of"), F.col("value")))
    added = added.groupBy("_row", "start", "end", "value").agg(F.max(F.struct("trust", (-no).alias("no"), "of")).alias("best"))
    added = added.groupBy("_row", "start").agg(F.max(F.struct("end", "value", "best")).alias("m")).select("_row", "start", "m.*")  # digit groups before their first token
    added = added.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
        F.col("best.of").alias("kind"), "start", "end", "value"))).alias("_added"))
    marked = F.rlike("_text", F.lit("[0-9@]"))  # other texts have no spans and stay where they are
    out = whole.filter(marked).withColumn("_row", F.md5("_text")).join(added, "_row", "left").drop("_row")
    out = out.withColumn("base", base_spans(F.col("_text"))).withColumn("spans", F.concat("base", F.coalesce("_added", none())))
    plain = whole.filter(~marked).withColumns({"base": none(), "spans": none()})
    return out.select("rest", "base", "spans").unionByName(plain.select("rest", "base", "spans")).select(*unpacked(keep), "base", "spans")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with every span of `extract` replaced by its kind in brackets; overlapping spans become one mark."""
    if {"base", "spans"} & {c.lower() for c in docs.columns}:  # their own columns of these names stay
        keep = docs.columns
        inner = redact(docs.select(packed(keep), F.col(text).alias("_body")), "_body", **options)
        return inner.select(*(F.col("_body").alias(c) if c == text else x for c, x in zip(keep, unpacked(keep), strict=True)))
    found = extract(docs, text=text, **options)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(text)

    def piece(s: Column, at: Column) -> Column:
        """The text since the last span and this span's mark; nothing if it begins inside that span."""
        kept = F.substring(body, (at + 1).cast("int"), (s["start"] - at).cast("int"))
        return F.when(s["start"] >= at, F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    pieces = running(ordered, lambda s: s["end"], F.greatest, piece, "array<string>")
    rest = F.substring(body, (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"), F.length(body))
    cleaned = F.concat(F.array_join(pieces, ""), rest)
    return found.withColumn(text, F.when(F.size("spans") > 0, cleaned).otherwise(body)).drop("base", "spans")
