"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

1. language_id: documents that language identification rejects (no letters, or
   unlike any learned language) go.
2. near_duplicates: of the documents that reach 0.8 Jaccard similarity of
   five-word shingles, directly or through others, the one of the smallest id stays.
3. pii: personal data and credentials are masked in the text (n_chars follows).
4. mix: sources are repeated or thinned to their target weights.
5. packing: what is left becomes sequences, power-of-two pieces of documents.

All stages but the last return the columns of `documents`, and further columns
of any name that the input has.

Null, empty and letterless texts go in stage 1. Repeated rows are copies: one of
them stays in stage 2 (rows without an id all stay). Ties go to the smallest id.
Texts of any length are taken whole by every stage. Null sources are a source
of their own, last in order. An empty table yields an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed.llm import jaccard_join, language_id, mixing, packing, pii
from gapfeed.llm._common import load, materialize, ship
from gapfeed.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.keep_one(docs, k=5, similarity=jaccard_join.Similarity(4, 5))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    masked = pii.mask(docs, fit_spans=20_000)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs, weights=[5, 2, 1], share=1.5, most=2.0, seed=17)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer_path(), longest=4096, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Models and tokenizers have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
