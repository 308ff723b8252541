"""From raw documents to token counts: rejects poor texts, thins shared lines and near copies, mixes sources, encodes.

Each stage takes all rows its predecessor kept and returns the columns of ``documents``, the last one the coding of each document
of the mix. A row's ``n_chars`` follows its text. Repeated ids are treated as the operators say; null texts pass as
empty ones.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trendloom.llm import bpe, forest, linededup, mixing, perplexity
from trendloom.llm.common import documents, table
from trendloom.session import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of the trusted texts does not reject, each row by its own verdict."""
    return perplexity.kept_rows(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in a later one."""
    kept = linededup.line_dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies, the one of the smallest id."""
    return forest.one_of_each_class(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed(docs)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: tokens, digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = written(bpe.bpe_encode(docs, path), "coded")  # encoding and decoding in one task would take a worker each
    return bpe.digests(bpe.bpe_decode(coded, path))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("source mixing", source_mixing),
    ("bpe", bpe_coding),
]

#: No SQL: the classifier and the join are not expressible in it. tests/llm compares with a one-by-one version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
