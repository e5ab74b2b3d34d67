"""A pipeline over ``documents``: quality, toxicity, near-duplicates, repeated passages, packing.

Every stage takes all that its predecessor kept and, but for the last, returns the columns it was given, whatever their names. Null texts count
as empty. Of empty tables every stage makes an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tramline.llm import packing, quality, simhash, substring_dedup, toxicity
from tramline.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality model rejects go. Rows that repeat are judged each; without labels all stay; a chance of just one half stays."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the toxicity chain rejects go. Rows that repeat are judged each; without labels all stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group stays: of the least id (those without one come last), then of the least hash of the text; empty texts are a group."""
    return simhash.representatives(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages that near-repeat one of an earlier document are cut out; of equal texts the one of the least id stays, documents of which nothing is left go; n_chars is counted anew."""
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of token sequences, a row each, as ``packing.packed`` gives them; an empty text is its end token."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", by_quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", no_near_duplicates),
    ("substring dedup", no_repeated_passages),
    ("packing", packed),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
