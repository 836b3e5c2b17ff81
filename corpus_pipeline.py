"""A training corpus from `documents`: language, near copies, personal data, mixture, tokens.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of
`documents`. Between stages rows are written as Parquet in the shared folder and read again, so an
executor's loss costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilflow.llm import encode, language, mixing, personal, shingles
from vigilflow.session import shared_folder

#: No SQL: language models, entropy balancing and BPE cannot be expressed; tests compare with brute force.
ORACLE_SQL = None

#: Documents whose best language has a smaller probability are refused: none of the learned languages fits.
LEAST_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter and those no language fits go."""
    judged = language.predict(docs, language.train(docs))
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return shingles.deduplicate(docs).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; `n_chars` follows the text."""
    return personal.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def balance_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    import public_tokenizers

    encoded = encode.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixture", balance_sources),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
