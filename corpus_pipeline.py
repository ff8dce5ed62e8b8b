"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

language: documents whose language is not recognised go. near_duplicates: one document of each group
stays (five-word shingles, Jaccard 0.8). pii: personal data is replaced by its kind. mixing: documents
are dropped or repeated until the sources meet their weights. packing: the pieces and their sequences.
Every stage keeps the columns of its input, the last one returns pieces. Nulls, empty texts, repeated
rows, empty tables and extra columns behave as the operators' modules state.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.llm import jaccard, langid, mixing, packing, pii
from pairmeter.llm.common import read, stage

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_path(), hold=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mix_sources), ("packing", pack)]

#: Language ID and packing cannot be written in SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
