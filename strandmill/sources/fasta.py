"""FASTA to the reference chunk table.

Lines are placed by running sums within a file split and a carry from split to
split, so a contig is never one row, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.errors import guard, guards
from strandmill.operators.reference import CHUNK, OVERLAP

ALPHABET = "^[ACGTURYKMSWBDHVN]*$"
#: Bases of a piece: longer lines are cut.
PIECE = 4096


def base_lines(spark: SparkSession, path: str) -> DataFrame:
    """contig, at (0-based place of the line's first base), seq and name (of header lines, else null).

    The contig is the first word of the header, white space goes, bases are upper case.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    head = F.col("value").startswith(">")
    rows = raw.select("f", "b", "i", F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(head, "").otherwise(F.upper(F.regexp_replace("value", r"\s+", ""))).alias("seq"))
    split = Window.partitionBy("f", "b").orderBy("i")
    n = F.length("seq")
    rows = rows.withColumn("own", F.last("name", True).over(split)).withColumn("total", F.sum(n).over(split))
    rows = rows.withColumn("head", F.last(F.when(F.col("name").isNotNull(), F.col("total")), True).over(split))
    # per split: the contig that goes on behind it, and its bases so far
    ends = rows.groupBy("f", "b").agg(F.max_by("own", "i").alias("last"), (F.max("total") - F.coalesce(F.max("head"), F.lit(0))).alias("tail"))
    by = Window.partitionBy("f").orderBy("b")
    ends = ends.withColumn("part", F.count("last").over(by))
    ends = ends.withColumn("sum", F.sum("tail").over(Window.partitionBy("f", "part").orderBy("b")))
    carry = ends.select("f", "b", F.lag("sum", 1, 0).over(by).alias("carry"), F.last("last", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("from"))
    at = F.col("total") - n - F.coalesce("head", F.lit(0)) + F.when(F.col("own").isNull(), F.col("carry")).otherwise(0)
    return rows.join(carry, ["f", "b"]).select(F.coalesce("own", "from").alias("contig"), at.cast("long").alias("at"), "seq", "name")


def read_fasta(spark: SparkSession, path: str, contigs: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """contig, chunk_id, chunk_start, seq: chunks of a fixed size, each with the first bases of the next. Contigs may be selected."""
    lines = base_lines(spark, path)
    if contigs:
        lines = lines.where(F.col("contig").isin(*contigs))
    guards(lines, [(~F.col("seq").rlike(ALPHABET), "FASTA holds letters that are no IUPAC bases", "E101"), (F.col("contig").isNull() & (F.col("seq") != ""), "FASTA has bases before its first header", "E101")], ["contig", "at"])
    guard(lines.where("name is not null").groupBy("name").count().where("count > 1").select("name"), "FASTA names a contig twice", "E101")
    piece = lines.where(F.col("seq") != "").select("contig", "at", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{PIECE}}}"), F.lit(0))).alias("k", "s"))
    piece = piece.select("contig", (F.col("at") + F.col("k") * PIECE).alias("a"), "s").withColumn("z", F.col("a") + F.length("s"))
    first, last = F.greatest(F.floor((F.col("a") - chunk - overlap) / chunk) + 1, F.lit(0)), F.floor((F.col("z") - 1) / chunk)
    dealt = piece.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("a", F.col("chunk_id") * chunk), F.least("z", F.col("chunk_id") * chunk + chunk + overlap)
    part = F.struct(lo.alias("lo"), F.substr("s", (lo - F.col("a") + 1).cast("int"), (hi - lo).cast("int")).alias("p"))
    rows = dealt.groupBy("contig", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]), "").alias("seq"))
    return rows.select("contig", "chunk_id", (F.col("chunk_id") * chunk + 1).alias("chunk_start"), "seq")


def index(spark: SparkSession, path: str) -> DataFrame:
    """name, length and bases of the first line of each contig."""
    lines = base_lines(spark, path).where("contig is not null")
    return lines.groupBy(F.col("contig").alias("name")).agg(F.sum(F.length("seq")).cast("long").alias("length"), F.coalesce(F.min_by(F.length("seq"), F.when(F.col("seq") != "", F.col("at"))), F.lit(0)).cast("int").alias("line_bases"))
