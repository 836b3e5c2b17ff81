"""Registered queries of this folder: thin digests of the operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, interactions, language, lattice, mixing, pages, personal, secrets, shingles, spans, substrings, tokencounts, trees, turns
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


@registered
def op7_pattern_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.extract(table(spark, sf_dir, "documents"))
    listed = lambda c: spans.listing(F.col(c), personal.KINDS, by_kind=True)
    return found.select("doc_id", *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in personal.KINDS),
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@registered
def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    listed = lambda c: spans.listing(F.col(c), (*secrets.KINDS, secrets.EXTRA), by_kind=False)
    return found.select("doc_id", *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS),
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


@registered
def op10_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = encode.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", *encode.digests(encoded))


@registered
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@registered
def op8_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.join(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("component_id", "class_id")


@registered
def op1_e8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice.links(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@registered
def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return trees.nearest(vectors, F.col("vec_id") % 50 == 0)


@registered
def op2_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    each = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


@registered
def op3_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.predict(docs.select("doc_id", "text", language.held_out("doc_id").alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


@registered
def op4_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return pages.extract(rows, pages.train(rows)).select("page_id", "url", "text", "n_chars")


@registered
def op11_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = interactions.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), interactions.quality_failures)
    return interactions.audit(counts, "ABCDE")


@registered
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


@registered
def op13_spliced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokencounts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
#: Smallest id reachable by links(a, b), both directions given.
_REACH = "reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a), low as (select a, min(b) as b from reach group by a)"

ORACLE["op1_e8_near_copies"] = f"""with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v),
links as (select x.vec_id as a, y.vec_id as b from n x join n y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.95),
{_REACH}, degree as (select a, count(*) as n from links group by a)
select vec_id, coalesce(d.n, 0) as n_links, least(vec_id, coalesce(low.b, vec_id)) as component_id, vec_id <= coalesce(low.b, vec_id) as kept
from embeddings left join degree d on d.a = vec_id left join low on low.a = vec_id"""

ORACLE["op6_suffix_automata"] = f"""with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d)),
f as (select g, min(doc_id) as first from g group by g),
c as (select distinct doc_id, unnest(range(k, k + 13)) as pos from g join f using (g) where first < doc_id),
u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
s as (select u.doc_id, string_agg(word, ' ' order by u.pos) filter (where c.pos is null) as kept, count(c.pos) as gone
  from u left join c on c.doc_id = u.doc_id and c.pos = u.pos group by u.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join s using (doc_id)"""

ORACLE["op8_bayes_jaccard"] = f"""with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
near as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8::double * (x.n + y.n - c) - 1e-9),
links as (select a, b from near union all select b, a from near), {_REACH}, degree as (select a, count(*) as n from links group by a)
select doc_id, coalesce(x.n, 0) as n_links, least(doc_id, coalesce(low.b, doc_id)) as class_id
from documents left join degree x on x.a = doc_id left join low on low.a = doc_id"""

#: Failure masks of all rows, then the 120 orders walked one by one.
ORACLE["op11_filter_lattice"] = f"""with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from d),
m as (select doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails from w),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
c as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m left join l using (doc_id) group by part, fails),
o as (select '' as o union all select o || f from o, unnest(['A', 'B', 'C', 'D', 'E']) as x(f) where not contains(o, f)),
s as (select o as filter_order, unnest(range(1, 6)) as step from o where len(o) = 5),
x as (select *, ascii(filter_order[step]) - 64 as f, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) as before from s),
e as (select x.*, c.*, fails[f] as fail, list_bool_or(list_concat([false], list_transform(before, lambda i: fails[i]))) as gone,
  len(list_filter(fails, lambda v: v)) as many from x, c),
r as (select part, filter_order, step, f, coalesce(sum(n) filter (where not fail and not gone), 0)::bigint as kept,
  coalesce(sum(n) filter (where fail and not gone), 0)::bigint as removed, coalesce(sum(n) filter (where fail and gone), 0)::bigint as redundant,
  coalesce(sum(n) filter (where fail and many = 1), 0)::bigint as unique_fails, coalesce(sum(good) filter (where fail and not gone), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where fail and not gone), 0)::bigint as toxic_lost from e group by part, filter_order, step, f)
select * exclude f, (sum(removed) over (partition by part, f))::bigint as shapley from r"""
