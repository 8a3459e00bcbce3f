"""An extension, not a feature of the engine's model: VCF files dropped into a folder are annotated as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "value string"


def watch_vcf(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Calls handle(alleles, batch) for the new files of each trigger; alleles: contig, pos, ref, alt. The query is returned."""
    lines = spark.readStream.format("text").schema(LINE).load(folder)
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f[0].alias("contig"), f[1].cast("long").alias("pos"), f[3].alias("ref"), F.explode(F.split(f[4], ",")).alias("alt"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
