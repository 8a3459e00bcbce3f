"""Spliced transcripts: offsets, introns, splice classes, coding sequences, protein offsets.

segments: gene_id, contig, strand, seg_idx (transcript order from 0), start, end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.alleles import changed_positions
from strandmill.functions.consequence import splice_class
from strandmill.functions.dna import oriented
from strandmill.operators.intervals import interval_join
from strandmill.operators.reference import intervals_sequence

def _order():
    return Window.partitionBy("gene_id").orderBy("seg_idx")


def order_segments(rows: DataFrame) -> DataFrame:
    """CDS rows (gene_id, contig, strand, start, end) to segments: equal ones once, in transcript order."""
    key = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    distinct = rows.select("gene_id", "contig", "strand", "start", "end").distinct()
    return distinct.withColumn("seg_idx", F.row_number().over(Window.partitionBy("gene_id").orderBy(key, "end")) - 1)


def build_transcripts(cds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, loose): CDS rows grouped by transcript into models, and rows kept as single features.

    Loose are transcripts of mixed strands and those whose first row in
    transcript order has a phase other than 0.
    """
    key = ["contig", "transcript_id"]
    first = F.min_by("phase", F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))).alias("p0")
    kind = cds.groupBy(*key).agg(F.countDistinct("strand").alias("strands"), first)
    good = kind.where("strands = 1 and coalesce(p0, 0) = 0").select(*key)
    models = cds.join(good, key, "left_semi").withColumn("gene_id", F.concat_ws(":", *key))
    return order_segments(models), cds.join(good, key, "left_anti")


def with_offsets(segments: DataFrame) -> DataFrame:
    """segments with offset0: bases of the transcript before the segment (a running sum)."""
    before = F.sum(F.col("end") - F.col("start") + 1).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("offset0", F.coalesce(before, F.lit(0)).cast("long"))


def transcript_offsets(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """A row per position and segment that holds it, with offset (0-based in the transcript); a base shared by two segments gets two."""
    segs = with_offsets(segments).withColumnRenamed("start", "s_start").withColumnRenamed("end", "s_end")
    rows = interval_join(positions.withColumn("_p", F.col("pos")), segs, "contig", "pos", "_p", "s_start", "s_end").drop("_p")
    return rows.withColumn("offset", F.col("offset0") + F.when(F.col("strand") == "-", F.col("s_end") - F.col("pos")).otherwise(F.col("pos") - F.col("s_start")))


def introns(segments: DataFrame) -> DataFrame:
    """gene_id, contig, strand, intron (number from 1), start, end, where a real gap separates neighbouring segments."""
    plus = F.col("strand") == "+"
    nxt = F.struct(F.lead("start").over(_order()).alias("s"), F.lead("end").over(_order()).alias("e"))
    rows = segments.withColumn("_n", nxt).where("_n.s is not null")
    rows = rows.withColumn("i_start", F.when(plus, F.col("end") + 1).otherwise(F.col("_n.e") + 1)).withColumn("i_end", F.when(plus, F.col("_n.s") - 1).otherwise(F.col("start") - 1))
    return rows.where("i_start <= i_end").select("gene_id", "contig", "strand", (F.col("seg_idx") + 1).cast("int").alias("intron"), F.col("i_start").alias("start"), F.col("i_end").alias("end"))


def last_junctions(segments: DataFrame) -> DataFrame:
    """gene_id, last_junction: transcript offset behind the last real intron; genes without one have no row."""
    gaps = introns(segments).groupBy("gene_id").agg(F.max("intron").alias("seg_idx"))
    return with_offsets(segments).join(gaps, ["gene_id", "seg_idx"]).select("gene_id", F.col("offset0").alias("last_junction"))


def splice_hits(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """gene_id and the most severe splice class of each position near a real junction (columns of positions kept)."""
    gaps = introns(segments).withColumn("w_start", F.least(F.col("start") - 3, F.col("end") - 7)).withColumn("w_end", F.greatest(F.col("end") + 3, F.col("start") + 7)).withColumnRenamed("start", "i_start").withColumnRenamed("end", "i_end")
    near = interval_join(positions.withColumn("_p", F.col("pos")), gaps, "contig", "pos", "_p", "w_start", "w_end").drop("_p")
    low, high = F.col("pos") - F.col("i_start") + 1, F.col("i_end") - F.col("pos") + 1  # distance into the intron from either side
    plus = F.col("strand") == "+"
    donor = splice_class(F.when(plus, low).otherwise(high), "donor")
    acceptor = splice_class(F.when(plus, high).otherwise(low), "acceptor")
    rank = lambda c: F.when(c == "splice_region_variant", 1).when(c.isNotNull(), 2).otherwise(0)
    best = F.when(rank(donor) >= rank(acceptor), donor).otherwise(acceptor)
    rows = near.withColumn("splice", best).where("splice is not null")
    keys = [*positions.columns, "gene_id"]
    return rows.groupBy(*keys).agg(F.min_by("splice", F.struct(-rank(F.col("splice")), "intron")).alias("splice"))


def touched_offsets(alleles: DataFrame, segments: DataFrame) -> DataFrame:
    """Per allele (contig, pos, ref, alt, components) and gene: touched, the sorted transcript offsets of its REF bases, and first_changed.

    A substitution or deletion changes its own bases; an insertion, on the plus
    strand, the base behind its anchor.
    """
    p = F.sequence(F.col("pos"), F.col("pos") + F.length("ref") - 1)
    inside = lambda c, x: (c["kind"] != "INS") & x.between(c["pos"], c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0)))
    each = F.transform(p, lambda x: F.struct(x.alias("p"), F.exists("components", lambda c: inside(c, x)).alias("changed"), F.exists("components", lambda c: (c["kind"] == "INS") & (c["pos"] == x)).alias("put")))
    rows = alleles.select("contig", F.col("pos").alias("_at"), "ref", "alt", F.explode(each).alias("e")).select("contig", F.col("e.p").alias("pos"), "_at", "ref", "alt", "e.changed", "e.put")
    offs = transcript_offsets(rows, segments)
    own = F.least(F.when(F.col("changed"), F.col("offset")), F.when(F.col("put"), F.col("offset") + F.when(F.col("strand") == "+", 1).otherwise(0)))
    out = offs.groupBy("gene_id", "contig", F.col("_at").alias("pos"), "ref", "alt").agg(F.array_sort(F.collect_set("offset")).alias("touched"), F.min(own).alias("first_changed"))
    return out


def allele_splice(alleles: DataFrame, segments: DataFrame) -> DataFrame:
    """gene_id, contig, pos, ref, alt and the most severe splice class over the positions that the allele changes."""
    rows = alleles.select("contig", F.col("pos").alias("_at"), "ref", "alt", F.explode(changed_positions(F.col("components"), F.col("pos"))).alias("pos"))
    hits = splice_hits(rows, segments)
    severe = F.max(F.when(F.col("splice") != "splice_region_variant", F.col("splice")))
    return hits.groupBy("gene_id", "contig", F.col("_at").alias("pos"), "ref", "alt").agg(F.coalesce(severe, F.lit("splice_region_variant")).alias("splice"))


def coding_sequences(segments: DataFrame, reference: DataFrame) -> DataFrame:
    """gene_id, cds: segments joined in transcript order, each on the coding strand."""
    seqs = intervals_sequence(segments, reference, ["gene_id", "strand", "seg_idx"], "start", "end")
    part = F.struct("seg_idx", oriented(F.col("seq"), F.col("strand")).alias("s"))
    return seqs.groupBy("gene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("cds"))


def protein_offsets(segments: DataFrame) -> DataFrame:
    """segments with protein_offset: residues before a CDS row's own first codon, (bases before + phase) / 3."""
    return with_offsets(segments).withColumn("protein_offset", F.floor((F.col("offset0") + F.coalesce("phase", F.lit(0))) / 3).cast("long"))


def internal_junctions(insertions: DataFrame, segments: DataFrame) -> DataFrame:
    """Insertions anchored on the last genomic base of a segment that is not the transcript's last: inside the transcript, between exons."""
    last = F.max("seg_idx").over(Window.partitionBy("gene_id"))
    first_high = F.when(F.col("strand") == "+", F.col("seg_idx") < last).otherwise(F.col("seg_idx") > 0)
    ends = segments.withColumn("_in", first_high).where("_in").select("gene_id", F.col("contig").alias("_c"), F.col("end").alias("_e"))
    return insertions.join(ends, (F.col("contig") == F.col("_c")) & (F.col("pos") == F.col("_e"))).drop("_c", "_e")
