"""A corpus pipeline over ``documents``: toxic documents go, then copies, then near copies; the rest is mixed to the target
weights of its sources and encoded.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
The last stage returns doc_id, n_tokens and ids of each row of the mix.

Defined cases: a null or empty text scores as not toxic, is a copy of other empty texts, has no near copies, weighs nothing in the
mix and so is not taken; a null id stays a row of its own in every stage; rows repeated in full are copies; columns beside doc_id,
text and source are carried by all stages but the last, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlspan.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from crawlspan.llm.common import Settled, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the model learns from the labels of ``sf_dir``."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return near_dedup.NearDedup(width=5, percent=80).drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses training, MinHash, cube sampling and merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is freed once the next one's is written; the last one's input stays for
    the lazy result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        written = Settled(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
