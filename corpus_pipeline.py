"""From raw documents to token ids: quality, exact duplicates, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its result is written as
Parquet and read again before the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.bpe import encode
from veilframe.llm.common import learnable, split_by_keys
from veilframe.llm.dedup import drop_duplicates
from veilframe.llm.jaccard import near_duplicates
from veilframe.llm.mixing import sample
from veilframe.llm.quality import scored, train
from veilframe.session import materialize

#: Below this score a document is rejected, as in the registered query of the classifier.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels outside the held-out fold."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable("doc_id", 5, 0))
    return docs.where(scored(F.col("text"), model) >= LEAST_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles the document with the smallest doc_id.

    Rows without an id can't be compared with others by it; they all stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    others = materialize(found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "others")
    may_go, stays = split_by_keys(docs, others, "doc_id")
    return stays.unionByName(may_go.join(others, "doc_id", "left_anti").select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of 80 percent of the tokens in which source, language and topic have flattened weights, whatever the rarest of them is."""
    return sample(docs, fraction=0.8, flatten=0.9, hold=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The classifier and the encoder have no SQL; tests/llm tests the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
