"""A training corpus from raw documents, in five stages, each one operator of ``metrosift.llm``.

Every stage takes what the one before kept, as Parquet, and its decisions take effect:
documents without a recognizable language go, one document of each group of near copies
stays, passages that occurred before are cut out, sources are drawn towards their target
weights, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm import language_id, mixing, packing, simhash, suffix_dedup
from metrosift.session import stage

#: Documents whose predicted language is less likely than this are rejected.
LEAST_SCORE = 0.5
#: Near copies: the least resemblance of the sets of five-word shingles.
SHINGLE, RESEMBLANCE = 5, 0.8


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null, empty and letterless texts go. The model is fitted on the rows' own labels."""
    model = language_id.fit(docs)
    return language_id.predict(docs, model).where(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, then the smallest text; a row without an id only if all are."""
    return simhash.one_per_group(docs, shingle=SHINGLE, resemblance=RESEMBLANCE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows without bytes of passages that started earlier in the corpus; n_chars follows."""
    left = suffix_dedup.remove_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn towards the source weights, as many words in all as before; a row for each draw."""
    return mixing.mix_documents(docs, share=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all drawn documents, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Fingerprints, trained weights and tokenizers are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
