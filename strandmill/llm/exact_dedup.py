"""Exact deduplication by a log-structured merge index of text digests.

* Memtable flush: every input partition becomes one run, its entries sorted by
  digest; the Parquet files carry min/max statistics and Bloom filters of the
  digest, so later point lookups skip runs.
* Compaction: runs are merged into one level that keeps, per digest, the
  smallest identifier and the number of entries (partial aggregation first, so
  a digest of a third of all rows costs one row a task).
* Hits, i.e. digests met more than once, are verified byte by byte: a Bloom
  filter of the hits (a bounded table of 64-bit words) passes only texts that
  may be hits, and the texts of a digest are identical exactly when the
  smallest and the largest of them are. Digests whose texts differ are split by
  the text itself.

Only DataFrame functions are used.

Defined results: null text counts as the empty text and is compared like any
other; a null doc_id counts as larger than all others; rows that repeat both
doc_id and text are copies of each other, and exactly one of them is kept;
other columns are ignored by the index and kept by drop_copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import keep_rows, materialize, norm_space, skew_safe_join, text_key

#: log2 of the number of 64-bit words of the hit filter: at most 2**17 words, 2 MB as rows.
FILTER_WORDS_LOG2 = 17


def digest_of(text, bits: int = 256):
    return F.unhex(F.sha2(text.cast("binary"), bits))


def flush_runs(docs: DataFrame, digest=digest_of) -> DataFrame:
    """One sorted run a partition: doc_id, th (hash of the text as it is), __seq (tells repeated rows apart), digest, filter hash."""
    text = norm_space(F.col("text"))
    runs = docs.select("doc_id", text.alias("__t"), text_key().alias("th")).select("doc_id", "th", F.monotonically_increasing_id().alias("__seq"), digest(F.col("__t")).alias("digest")).withColumn("__h", F.xxhash64("digest"))
    return materialize(runs.sortWithinPartitions("digest"), "runs", **{"parquet.bloom.filter.enabled#digest": "true"})


def compact(runs: DataFrame, key: str = "digest") -> DataFrame:
    """Runs merged: one entry a digest with the smallest identifier, its row and the number of entries."""
    entry = F.struct(F.col("doc_id").isNull().alias("__null"), "doc_id", "__seq")
    level = runs.groupBy(key).agg(F.min(entry).alias("__first"), F.count(F.lit(1)).alias("group_size"), F.first("__h").alias("__h"))
    return level.select(key, F.col("__first.doc_id").alias("keep_id"), F.col("__first.__seq").alias("__keep_seq"), "group_size", "__h")


def hit_filter(hits: DataFrame) -> DataFrame:
    """A Bloom filter as rows (word, bits): at most 2**FILTER_WORDS_LOG2 of them, whatever the number of hits."""
    h = F.col("__h")
    word = F.shiftrightunsigned(h, 64 - FILTER_WORDS_LOG2)
    return hits.select(word.alias("__word"), F.expr("shiftleft(1L, cast(__h & 63 as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def verify_hits(docs: DataFrame, hits: DataFrame, digest=digest_of) -> DataFrame:
    """Digests of hits whose texts are not all the same bytes."""
    probed = docs.select(norm_space(F.col("text")).alias("__t")).withColumn("digest", digest(F.col("__t"))).withColumn("__h", F.xxhash64("digest")).withColumn("__word", F.shiftrightunsigned("__h", 64 - FILTER_WORDS_LOG2))
    passed = probed.join(F.broadcast(hit_filter(hits)), "__word").where(F.expr("shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1 = 1"))
    same = passed.select("digest", "__t").groupBy("digest").agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    return same.where(F.col("__lo") != F.col("__hi")).select("digest")


def exact_groups(docs: DataFrame, digest=digest_of, with_key: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and th with with_key."""
    runs = flush_runs(docs, digest)
    level = materialize(compact(runs).where("group_size > 1"), "level")
    clashes = materialize(verify_hits(docs, level, digest), "clashes")
    if clashes.isEmpty():
        rows = skew_safe_join(runs, level.drop("__h"), "digest", "group_size", total=runs.count())
        hexed = F.lower(F.hex("digest"))
    else:  # texts of one digest differ: the text joins the key of those rows
        text = norm_space(F.col("text"))
        full = docs.select("doc_id", text.alias("__t"), text_key().alias("th")).select("doc_id", "th", F.monotonically_increasing_id().alias("__seq"), digest(F.col("__t")).alias("digest"), "__t").withColumn("__h", F.xxhash64("digest"))
        clash = full.join(clashes, "digest", "left_semi")
        full = full.join(clashes, "digest", "left_anti").withColumn("__key", F.col("digest")).unionByName(clash.withColumn("__key", F.concat("digest", F.col("__t").cast("binary"))))
        runs = materialize(full.withColumn("__sha", F.sha2(F.col("__t").cast("binary"), 256)).drop("__t"), "split")
        level = materialize(compact(runs, "__key").where("group_size > 1"), "level")
        rows = skew_safe_join(runs, level.drop("__h"), "__key", "group_size", total=runs.count())
        hexed = F.col("__sha")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__seq") == F.col("__keep_seq"))).alias("kept"),
        hexed.alias("text_sha256"),
        *(["th"] if with_key else []),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without its exact copies: of equal texts the row with the smallest doc_id stays, all columns as they were."""
    return keep_rows(docs, materialize(exact_groups(docs, with_key=True).select("doc_id", "th", "kept"), "groups"))
