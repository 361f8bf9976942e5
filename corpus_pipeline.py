"""From raw documents to packed sequences: language, exact copies, near copies, mix, packing.

Every stage takes (spark, docs, sf_dir) and reads all that the one before it kept; the
first four return the columns of their input, whatever columns there are. Rows are told
apart by doc_id and text, so tables with repeated or missing doc_ids go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import exact_dedup, language_net, mixing, order_minhash, packing
from pricetide.llm.common import documents, shared_dir, staged

#: A text whose language is less certain than this is rejected.
CERTAIN = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or no recognisable language."""
    return language_net.filtered(docs, language_net.learned(docs), CERTAIN)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts: that with the largest doc_id."""
    return exact_dedup.filtered(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the lowest doc_id."""
    return order_minhash.filtered(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are shared out among sources, languages and topics as wanted."""
    return mixing.filtered(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixed", mixed), ("packed", packed)]

#: A trained network decides the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = documents(spark, sf_dir), shared_dir(spark)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"{root}/{name}")
    return docs
