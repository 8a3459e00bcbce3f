"""Caller tables (tab-separated, named columns) to alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.errors import EngineError, guard
from strandmill.operators.filters import as_fraction
from strandmill.operators.reference import lookup

NEEDED = ("REGION", "POS", "REF", "ALT")
PASSING = ("", ".", "TRUE", "PASS", "1", "YES")


def looks_like_ivar(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and set(NEEDED) <= set(first[0].value.split("\t"))


def read_ivar(spark: SparkSession, path: str, reference: DataFrame) -> DataFrame:
    """Alleles of the calls that pass, +SEQ and -SEQ anchored on the reference: contig, record_id, pos, ref, alt, odp, ofreq."""
    raw = spark.read.csv(path, sep="\t", header=True)
    if missing := [c for c in NEEDED if c not in raw.columns]:
        raise EngineError("caller table lacks columns", "E103", missing=missing)
    for c in ("TOTAL_DP", "REF_DP", "ALT_DP", "ALT_FREQ", "PASS"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    rows = raw.where(F.col("PASS").isNull() | F.upper("PASS").isin(*PASSING))
    rows = rows.select(F.col("REGION").alias("contig"), F.col("POS").cast("long").alias("pos"), F.upper("REF").alias("ref"), F.upper("ALT").alias("alt"), "TOTAL_DP", "REF_DP", "ALT_DP", "ALT_FREQ").where("ref <> alt")
    total = F.coalesce(F.col("TOTAL_DP").try_cast("long"), F.col("REF_DP").try_cast("long") + F.col("ALT_DP").try_cast("long"))
    rows = rows.withColumn("odp", total).withColumn("ofreq", F.coalesce(as_fraction(F.col("ALT_FREQ")), F.col("ALT_DP").try_cast("double") / total)).drop("TOTAL_DP", "REF_DP", "ALT_DP", "ALT_FREQ")
    sign, body = F.substring("alt", 1, 1), F.substr("alt", F.lit(2))
    seen = lookup(rows, reference, {"_a": (F.col("pos"), F.lit(1)), "_d": (F.col("pos"), F.length("alt"))})
    guard(seen.where((sign == "-") & (F.substr("_d", F.lit(2)) != body)).select("contig", "pos", "alt"), "deleted bases differ from the reference", "E103")
    seen = seen.withColumn("ref", F.when(sign == "-", F.concat("_a", body)).when(sign == "+", F.col("_a")).otherwise(F.col("ref"))).withColumn("alt", F.when(sign == "-", F.col("_a")).when(sign == "+", F.concat("_a", body)).otherwise(F.col("alt")))
    return seen.drop("_a", "_d").distinct().withColumn("record_id", F.xxhash64("contig", "pos", "ref", "alt"))
