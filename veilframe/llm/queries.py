"""One registered query for each operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilframe.llm.ann import nearest
from veilframe.llm.bpe import Tokenizer, map_encoded, texts_of
from veilframe.llm.classlm import score as score_texts
from veilframe.llm.classlm import train as train_classes
from veilframe.llm.common import held_out, learnable
from veilframe.llm.decontaminate import contamination, hit_words
from veilframe.llm.dedup import duplicate_groups
from veilframe.llm.jaccard import near_duplicates
from veilframe.llm.langid import predicted
from veilframe.llm.langid import train as train_languages
from veilframe.llm.mixing import mix
from veilframe.llm.urls import ALLOW, BLOCK, judge
from veilframe.llm.variants import misspelled, runs, variants, vocabulary
from veilframe.llm.warc import archive, find_captures, read_records, url_key
from veilframe.llm.whitening import whiten
from veilframe.llm.quality import scored, train

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of ``documents``; the largest doc_id of each group stays."""
    return duplicate_groups(table(spark, sf_dir, "documents")).withColumnsRenamed({"id": "doc_id", "sha256": "text_sha256"})


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of ``documents`` and the text they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    made = StructType(
        [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_encoded(docs, path, "text", _digests, made).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _digests(tokenizer: Tokenizer, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Number and digest of each text's ids, and the digest of what they decode to."""
    numbers = np.array([*map(str, range(tokenizer.size))], dtype=object)[ids].tolist()
    ends = np.cumsum(counts)
    joined = [" ".join(numbers[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    digest = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
    return [pa.array(counts, pa.int64()), digest(joined), digest(texts_of(tokenizer, ids, counts))]


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text of ``documents``, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learnable("doc_id", 5, 0))
    out = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    samples = train_languages(docs, learnable("doc_id", 5, 0))
    out = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), predicted(F.col("text"), samples).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector of ``embeddings``, by inner product."""
    found = nearest(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``pages`` as WARC records, look all their URLs up in the index, and read the records back."""
    pages = table(spark, sf_dir, "pages")
    index, folder = archive(spark, pages)
    found = find_captures(index, folder, pages.select(url_key(F.col("url")).alias("key")))
    records = read_records(found, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic, calibrated rate and fate of every document, with flattened source, language and topic marginals as targets; half of the tokens stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    m = F.col("mixing")
    return mix(docs, fraction=0.5, hold=True).select(
        "doc_id", m.topic.alias("topic"), m.tokens.alias("n_tokens"), F.round(m.rate, 6).alias("rate"),
        F.round(m.probability, 6).alias("probability"), m.kept.alias("kept"),
    )


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under links of 90 percent common three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90).withColumnRenamed("id", "doc_id")


def class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text of ``documents``, learned from rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out"))
    model = train_classes(docs, learnable("doc_id", 7, 2))
    scored = score_texts(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


URL_RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages``; the trees learn from the URLs that a rule decides."""
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors of ``embeddings``, whitened; a deviation that no long holds is null."""
    found = whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every text of ``documents`` that windows of ``benchmark`` cover, and the items that have them."""
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the frequent words of ``documents``; one of 199 words per document loses a letter first."""
    found = runs(table(spark, sf_dir, "documents"))
    return variants(vocabulary(found.select(misspelled(found, 199).alias("word")), 6, 5))


QUERIES: dict[str, Query] = {
    "op1_neighbours": neighbours,
    "op2_language_id": language,
    "op3_class_model": class_model,
    "op4_exact_dedup": exact_dedup,
    "op5_bpe": bpe,
    "op6_mixing": mixing,
    "op7_quality": quality,
    "op8_jaccard": jaccard,
    "op9_urls": urls,
    "op10_warc": warc,
    "op11_whitening": whitening,
    "op12_decontamination": decontamination,
    "op13_variants": spelling,
}
