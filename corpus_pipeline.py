"""A corpus pipeline: documents in, token ids out.

Quality rules drop texts, exact and near dedup keep one of each group, the mix
repeats and samples by source, and the last stage encodes what is left.

Defined results: null, empty and very short texts go in the first stage, as they fail its
base rules; of equal rows and of equal texts one stays, that of the smallest doc_id, and a
null doc_id stays only where no other row has its text; null is a source like others;
very long texts pass every stage whole; an empty table gives an empty result; all stages
but the last carry further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepiece
from tarnwell.llm.common import bounded_batches, materialise, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the rules reject go."""
    bounded_batches(spark)
    return quality_rules.kept_rows(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near copies stays."""
    bounded_batches(spark)
    return near_dedup.near_deduplicated(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: ids of every row of the mix."""
    bounded_batches(spark)
    return sentencepiece.encoded(docs, sentencepiece.standard())


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("sentencepiece encoding", encode_stage),
]

#: Expectation-maximisation, connected components and the encoding are beyond plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
