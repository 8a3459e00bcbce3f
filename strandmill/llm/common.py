"""Helpers shared by the training-data operators: scratch tables, skew-safe joins, word sizes, row sources."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java character class, and a word made of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A join key counts as heavy when it holds at least 1/HEAVY_SHARE of all rows, so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 1000
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one of our own, which only a local master may use."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """Folder of all scratch tables of this application."""
    return f"{shared_dir(spark)}/strandmill/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; results that weren't written elsewhere can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first variant of it that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a DataFrame over the files: lineage is cut, no executor's disk is relied on."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of this session hold at most so many bytes (a longer row is one by itself), so that tasks over long texts need as little memory as those over short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def give_back() -> None:
    """What this process has freed goes back to the system: a Python worker serves many tasks, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_batches(df: DataFrame, task: Callable, ddl) -> DataFrame:
    """df.mapInArrow(task, ddl), after each task of which the worker gives back its memory."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return df.mapInArrow(run, ddl)


def norm_space(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key's text modulo buckets; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets))


def held_out(key: Column, buckets: int) -> Column:
    """True where crc_bucket is 0; a null key is never held out."""
    return F.coalesce(crc_bucket(key, buckets) == 0, F.lit(False))


def skew_safe_join(rows: DataFrame, index: DataFrame, key: str, size: str, total: int | None = None, how: str = "left", share: int = HEAVY_SHARE) -> DataFrame:
    """rows joined to index, which has one row a key and the number of its rows in column size.

    Heavy keys (at least 1/share of all rows, so at most share of them: a proven
    bound) are broadcast and their rows never move; the others are shuffled,
    each of them holding less than 1/share of the rows. Both inputs should be
    written tables, since each is read twice.
    """
    if total is None:
        total = index.agg(F.sum(size)).first()[0] or 0
    limit = max(1024, total // share)
    heavy = index.where(F.col(size) >= limit)
    if index.agg(F.max(size)).first()[0] is None or heavy.isEmpty():
        return rows.join(index, key, how)
    hot = rows.join(F.broadcast(heavy), key, "inner")
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(index.where(F.col(size) < limit), key, how)
    return hot.unionByName(cold)


def text_bytes(column: pa.Array, step: int = 256):
    """UTF-8 bytes (or None) of a string column, made in slices so that few Python objects live at once."""
    raw = pc.cast(column, pa.large_binary()) if pa.types.is_large_string(column.type) else pc.cast(column, pa.binary())
    for start in range(0, len(raw), step):
        yield from raw.slice(start, step).to_pylist()


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words of the contracts: bytes.lower() folds A-Z only, and bytes.split() splits at the six ASCII white-space bytes only."""
    return text.lower().split() if text else []


def text_key() -> Column:
    """64-bit hash of the text as it is: with doc_id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_rows(docs: DataFrame, decided: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """docs without the rows that a decision drops, columns as they were.

    decided is a written table with a row per row of docs: doc_id, th
    (text_key), kept. The dropped keys are broadcast only if there are at most
    broadcast_rows of them. Of rows that agree in doc_id and text, of which one
    was kept, the one that is first as JSON stays.
    """
    lost = decided.where("not kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    kept = decided.where("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = (F.col("l.__id").eqNullSafe(F.col("k.__id"))) & (F.col("l.__th") == F.col("k.__th"))
    twins = materialize(lost.alias("l").join(kept.alias("k"), same, "left_semi"), "twins")
    send = F.broadcast if decided.where("not kept").count() <= broadcast_rows else (lambda x: x)
    key, row = fresh(docs, "__key"), fresh(docs, "__row")
    keyed = docs.withColumn(key, text_key())
    on = lambda side: keyed["doc_id"].eqNullSafe(side["__id"]) & (keyed[key] == side["__th"])
    gone = send(lost)
    rest = keyed.join(gone, on(gone), "left_anti").select(*docs.columns)
    if twins.isEmpty():
        return rest
    both = keyed.join(twins, on(twins), "left_semi")
    one = both.groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(row))
    return rest.unionByName(one.select(f"{row}.*"))
