"""The reference genome as a chunk table, and slices of it by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a chunk, and bases of the next chunk that each carries, so that a slice of up to OVERLAP + 1 bases is in one row.
CHUNK, OVERLAP = 16384, 64
#: Bases of the pieces that short slices are cut from: substr walks through its text, so a slice of a whole chunk costs thousands of steps.
PIECE = 1024


def chunk_sequences(whole: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """contig, chunk_id, chunk_start (1-based), seq from rows (contig, seq)."""
    n = F.ceil(F.length("seq") / chunk).cast("int")
    rows = whole.where(F.length("seq") > 0).select("contig", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_id"))
    return rows.select("contig", F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("chunk_id").cast("long") * chunk + 1).alias("chunk_start"), F.substr("seq", F.col("chunk_id") * chunk + 1, F.lit(chunk + overlap)).alias("seq"))


def slice_of(start: Column, length: Column) -> Column:
    return F.substr(F.col("_seq"), (start - F.col("_start") + 1).cast("int"), length.cast("int"))


def lookup(df: DataFrame, reference: DataFrame, slices: dict[str, tuple[Column, Column]], contig: str = "contig", chunk: int = CHUNK, reach: int | None = None) -> DataFrame:
    """df with a column per slice (start, length): all slices start in the chunk of the first one's start.

    Where all slices are known to lie in the reach bases from the first one's
    start on (at most one more than chunks overlap), rows meet a piece of the
    chunk rather than all of it.
    """
    first = next(iter(slices.values()))[0]
    ref = reference.select(F.col("contig").alias("_contig"), F.col("chunk_id").alias("_chunk"), F.col("chunk_start").alias("_start"), F.col("seq").alias("_seq"))
    at, on = df.withColumn("_at", F.floor((first - 1) / chunk)), (F.col(contig) == F.col("_contig")) & (F.col("_at") == F.col("_chunk"))
    if reach is not None and chunk > PIECE:
        ref = ref.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit((chunk - 1) // PIECE))))
        ref = ref.withColumn("_seq", F.substr("_seq", F.col("_piece") * PIECE + 1, F.lit(PIECE + reach - 1))).withColumn("_start", F.col("_start") + F.col("_piece") * PIECE)
        at, on = at.withColumn("_of", F.floor((first - 1 - F.col("_at") * chunk) / PIECE).cast("int")), on & (F.col("_of") == F.col("_piece"))
    joined = at.join(ref, on, "left")
    for name, (start, length) in slices.items():
        joined = joined.withColumn(name, slice_of(start, length))
    return joined.drop("_at", "_of", "_contig", "_chunk", "_piece", "_start", "_seq")


def intervals_sequence(df: DataFrame, reference: DataFrame, keys: list[str], start: str, end: str, contig: str = "contig", chunk: int = CHUNK) -> DataFrame:
    """keys and seq of each interval, assembled from the chunks it touches (intervals are gene-sized)."""
    ref = reference.select(F.col("contig").alias("_contig"), F.col("chunk_id").alias("_chunk"), F.col("chunk_start").alias("_start"), F.col("seq").alias("_seq"))
    parts = df.withColumn("_at", F.explode(F.sequence(F.floor((F.col(start) - 1) / chunk), F.floor((F.col(end) - 1) / chunk))))
    joined = parts.join(ref, (F.col(contig) == F.col("_contig")) & (F.col("_at") == F.col("_chunk")))
    lo, hi = F.greatest(F.col(start), F.col("_start")), F.least(F.col(end), F.col("_start") + chunk - 1)
    piece = joined.select(*keys, "_at", slice_of(lo, hi - lo + 1).alias("_p"))
    return piece.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_p"))), lambda x: x["_p"]), "").alias("seq"))


def reference_mismatches(alleles: DataFrame, reference: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Alleles whose REF differs from the reference or runs off it: the guard of every load (case is ignored, N matches nothing else).

    A REF longer than a chunk's overlap is tested part by part, each part in its own chunk.
    """
    step = overlap + 1
    parts = F.expr(f"transform(sequence(0, cast(floor((length(ref) - 1) / {step}) as int)), i -> struct(pos + i * {step} as p, substr(ref, i * {step} + 1, {step}) as r))")
    long_ = F.length("ref") > step
    seen = lookup(alleles.where(~long_), reference, {"_ref": (F.col("pos"), F.length("ref"))}, chunk=chunk, reach=step)
    out = seen.where(F.coalesce(F.upper("_ref") != F.upper("ref"), F.lit(True))).drop("_ref")
    cut = alleles.where(long_).withColumn("_part", F.explode(parts))
    far = lookup(cut, reference, {"_ref": (F.col("_part.p"), F.length("_part.r"))}, chunk=chunk, reach=step)
    bad = far.where(F.coalesce(F.upper("_ref") != F.upper("_part.r"), F.lit(True))).select(*alleles.columns)
    return out.unionByName(bad.dropDuplicates(["contig", "pos", "ref", *(["alt"] if "alt" in alleles.columns else [])]))


def anchor_insertions(alleles: DataFrame, reference: DataFrame) -> DataFrame:
    """Insertions written before their record's position are rewritten onto the base before it."""
    c = F.col("components")
    right = (F.size(c) == 1) & (c[0]["kind"] == "INS") & (c[0]["pos"] < F.col("pos")) & (F.col("pos") > 1)
    seen = lookup(alleles.withColumn("_right", right), reference, {"_base": (F.col("pos") - 1, F.lit(1))}, reach=1)
    new_alt = F.concat("_base", c[0]["alt"])
    return seen.withColumn("alt", F.when(F.col("_right"), new_alt).otherwise(F.col("alt"))).withColumn("ref", F.when(F.col("_right"), F.col("_base")).otherwise(F.col("ref"))).withColumn("pos", F.when(F.col("_right"), F.col("pos") - 1).otherwise(F.col("pos"))).drop("_right", "_base")
