"""Frames of spliced transcripts under indels, on one axis: offsets in the joined coding sequence.

What an indel touches is kept as ranges of offsets, one for each component and
segment, so a deletion of a whole exon is as small a row as one of a base.
Shifts are running sums over a transcript's indels and codons in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.indels import passes_gate
from strandmill.operators.intervals import interval_join
from strandmill.operators.transcripts import with_offsets

ALLELE = ["contig", "pos", "ref", "alt"]


def touched_ranges(indels: DataFrame, segments: DataFrame) -> DataFrame:
    """gene_id, strand, ALLELE, only_ins, kind, lo, hi: offsets of the bases that each component of an indel occupies in each segment.

    An insertion occupies its anchor, if it lies inside a segment or, on a
    segment's last genomic base, if the transcript goes on there; a deletion its
    deleted bases. A base that two segments share has two offsets.
    """
    last = F.max("seg_idx").over(Window.partitionBy("gene_id"))
    inner = F.when(F.col("strand") == "+", F.col("seg_idx") < last).otherwise(F.col("seg_idx") > 0)
    segs = with_offsets(segments).withColumn("inner", inner).select("gene_id", "contig", "strand", "offset0", "inner", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    parts = indels.select(*ALLELE, F.forall("components", lambda c: c["kind"] == "INS").alias("only_ins"), F.posexplode("components").alias("part", "c"))
    parts = parts.withColumn("_lo", F.col("c.pos")).withColumn("_hi", F.col("c.pos") + F.greatest(F.length("c.ref") - 1, F.lit(0)))
    rows = interval_join(parts, segs, "contig", "_lo", "_hi", "s_start", "s_end")
    anchored = F.max(F.when((F.col("_lo") < F.col("s_end")) | F.col("inner"), True).otherwise(False)).over(Window.partitionBy("gene_id", *ALLELE, "part"))
    rows = rows.withColumn("_in", (F.col("c.kind") != "INS") | anchored).where("_in")
    lo, hi, plus = F.greatest("_lo", "s_start"), F.least("_hi", "s_end"), F.col("strand") == "+"
    first = F.col("offset0") + F.when(plus, lo - F.col("s_start")).otherwise(F.col("s_end") - hi)
    return rows.select("gene_id", "strand", *ALLELE, "only_ins", F.col("c.kind").alias("kind"), first.alias("lo"), (first + hi - lo).alias("hi"))


def first_offsets(ranges: DataFrame) -> DataFrame:
    """gene_id, strand, ALLELE, first_touched, first_changed, effective: per indel of a transcript.

    An insertion's bases lie behind its anchor along the genome, so in transcript
    order behind it on the plus strand and before it on the minus strand:
    first_changed is one on, and effective, which must lie before a codon for the
    indel to be upstream of it, one back.
    """
    rows = ranges.groupBy("gene_id", "strand", *ALLELE, "only_ins").agg(F.min("lo").alias("first_touched"))
    plus = F.col("strand") == "+"
    changed = F.col("first_touched") + F.when(F.col("only_ins") & plus, 1).otherwise(0)
    effective = F.greatest(F.col("first_touched") - F.when(F.col("only_ins") & ~plus, 1).otherwise(0), F.lit(0))
    return rows.withColumn("first_changed", changed).withColumn("effective", effective).drop("only_ins")


def disturbed_codons(ranges: DataFrame) -> DataFrame:
    """gene_id, k0, k1: ranges of codons whose bases an indel takes, or puts bases between."""
    k = lambda c: F.floor(F.col(c) / 3).cast("long")
    within = F.when(F.col("strand") == "+", F.col("lo") % 3 != 2).otherwise(F.col("lo") % 3 != 0)
    return ranges.where((F.col("kind") != "INS") | within).select("gene_id", k("lo").alias("k0"), k("hi").alias("k1"))


def frame_states(codons: DataFrame, effects: DataFrame, ranges: DataFrame, least: float = 0.5, trans: DataFrame | None = None) -> DataFrame:
    """Per codon (gene_id, codon_start: its number from 0): shift, frameshift, overlap.

    effects: per indel and transcript gene_id, effective, delta (null: unknown),
    af, and observed where reads tell. Indels below the gate shift nothing; one
    whose length is unknown makes the codons behind it as unknown as one that an
    indel lies in. trans: gene_id, codon_start, delta of upstream indels that the
    reads put on other molecules.
    """
    seen = F.col("observed") if "observed" in effects.columns else F.lit(None).cast("double")
    passing = effects.where(passes_gate(seen, F.col("af"), least))
    events = passing.select("gene_id", F.lit(None).cast("long").alias("codon_start"), F.col("effective").cast("long").alias("_o"), F.coalesce(F.col("delta"), F.lit(0)).cast("long").alias("_d"), F.col("delta").isNull().cast("int").alias("_u"))
    rows = codons.select("gene_id", F.col("codon_start").cast("long").alias("codon_start")).distinct()
    every = rows.withColumn("_o", F.col("codon_start") * 3).withColumn("_d", F.lit(0).cast("long")).withColumn("_u", F.lit(0)).unionByName(events)
    before = Window.partitionBy("gene_id").orderBy("_o").rangeBetween(Window.unboundedPreceding, -1)
    out = every.withColumn("shift", F.coalesce(F.sum("_d").over(before), F.lit(0))).withColumn("unknown", F.coalesce(F.max("_u").over(before), F.lit(0)) > 0).where("codon_start is not null")
    if trans is not None:
        gone = trans.groupBy("gene_id", "codon_start").agg(F.sum("delta").alias("_gone"))
        out = out.join(gone, ["gene_id", "codon_start"], "left").withColumn("shift", F.col("shift") - F.coalesce("_gone", F.lit(0)))
    spans = rows.withColumn("_k", F.col("codon_start"))
    hit = interval_join(spans, disturbed_codons(ranges), "gene_id", "codon_start", "_k", "k0", "k1").select("gene_id", "codon_start").distinct().withColumn("_over", F.lit(True))
    out = out.join(hit, ["gene_id", "codon_start"], "left").withColumn("overlap", F.coalesce("_over", F.lit(False)) | F.col("unknown"))
    return out.select("gene_id", "codon_start", "shift", "overlap").withColumn("frameshift", F.pmod("shift", F.lit(3)) != 0)


def altered_nmd(effects: DataFrame, junctions: DataFrame, margin: int = 50) -> DataFrame:
    """effects with nmd: the 50-base rule for stops that indels bring, in altered coordinates; null without a real intron or a stop before the reference's own.

    effects: spliced_effects with first_changed. junctions: last_junctions. A
    stop behind the indel is moved back by its delta before it is compared with
    the reference's; what lies behind the last junction keeps its length, so an
    indel before it moves the junction with the sequence's end.
    """
    df = effects.join(junctions, "gene_id", "left")
    stop = (F.col("alt_stop") - 1) * 3
    grown = F.length("alt_cds") - F.length("ref_cds")
    back = F.when(stop >= F.col("first_changed"), stop - grown).otherwise(stop)
    own = F.coalesce((F.col("ref_stop") - 1) * 3, F.floor(F.length("ref_cds") / 3) * 3)
    junction = F.when(F.col("first_changed") < F.col("last_junction"), F.col("last_junction") + grown).otherwise(F.col("last_junction"))
    early = (back >= 0) & (back < own) & F.col("last_junction").isNotNull()
    return df.withColumn("nmd", F.when(early, F.when(junction - stop > margin, "NMD-triggering").otherwise("NMD-escaping"))).drop("last_junction")

