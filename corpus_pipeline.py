"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing. Each stage works on all that the last one kept.

Defined results: null texts and texts without a letter go in the first stage;
of copies the smallest doc_id stays, a null one counting as larger than all
others, and of rows that repeat doc_id and text the one that is first as JSON;
a null source is a source of its own; an empty table gives no rows; further
columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import exact_dedup, langid, mixing, ngram_join, packing
from strandmill.llm.common import bound_batches, materialize

#: Bytes of an Arrow batch: executors run the stages one after another and keep what any of them needed.
BATCH_BYTES = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognisable language (null, or no letter) go."""
    bound_batches(spark, BATCH_BYTES)
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their 5-word shingles, the smallest doc_id stays."""
    bound_batches(spark, BATCH_BYTES)
    return ngram_join.drop_near_copies(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per draw of the mix, dealt to shards and shuffled within them; sources of size 0 are not drawn."""
    return mixing.mix_rows(docs, shard_column=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each drawn document with its bin."""
    bound_batches(spark, BATCH_BYTES)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Packing is not expressible in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
