"""Rows for records that no codon speaks for: splice, intron, inside a gene, intergenic, and the per-gene second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.intervals import interval_join
from strandmill.operators.transcripts import introns, splice_hits

#: Order in which classes claim a position.
PRIORITY = {"splice": 1, "intron": 2, "gene": 3, "intergenic": 4}


def unspoken(components: DataFrame, spoken: DataFrame) -> DataFrame:
    """Components (contig, label) that no produced row carries: by label, not by position."""
    return components.join(spoken.select("contig", "label").distinct(), ["contig", "label"], "left_anti")


def gene_claims(positions: DataFrame, genes: DataFrame, segments: DataFrame) -> DataFrame:
    """Every claim of every gene on a position: columns of positions, gene_id, term, priority."""
    cols = positions.columns
    spans = genes.select("gene_id", "contig", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    p = positions.withColumn("_p", F.col("pos"))
    inside = interval_join(p, spans, "contig", "pos", "_p", "g_start", "g_end").select(*cols, "gene_id", F.lit("coding_sequence_variant").alias("term"), F.lit(PRIORITY["gene"]).alias("priority"))
    splice = splice_hits(positions, segments).select(*cols, "gene_id", F.col("splice").alias("term"), F.lit(PRIORITY["splice"]).alias("priority"))
    gaps = introns(segments).select(F.col("gene_id"), "contig", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    intron = interval_join(p, gaps, "contig", "pos", "_p", "g_start", "g_end").select(*cols, "gene_id", F.lit("intron_variant").alias("term"), F.lit(PRIORITY["intron"]).alias("priority"))
    return inside.unionByName(splice).unionByName(intron)


def classify(positions: DataFrame, genes: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a position: the claim of highest priority (ties: the first gene), else intergenic."""
    claims = gene_claims(positions, genes, segments)
    best = claims.groupBy(*positions.columns).agg(F.min(F.struct("priority", "gene_id", "term")).alias("b"))
    keys = positions.columns
    out = positions.join(best, keys, "left")
    return out.select(*keys, F.col("b.gene_id").alias("gene_id"), F.coalesce("b.term", F.lit("intergenic_variant")).alias("term"))


def second_pass(positions: DataFrame, genes: DataFrame, segments: DataFrame, said: DataFrame) -> DataFrame:
    """Claims of overlapping genes that were not said: not the same (gene, label, term), and nothing else of (gene, label) coded.

    said: gene_id, label, term, coded.
    """
    claims = gene_claims(positions, genes, segments)
    best = claims.groupBy(*positions.columns, "gene_id").agg(F.min(F.struct("priority", "term")).alias("b")).select(*positions.columns, "gene_id", "b.term")
    rest = best.join(said.select("gene_id", "label", "term"), ["gene_id", "label", "term"], "left_anti")
    return rest.join(said.where("coded").select("gene_id", "label").distinct(), ["gene_id", "label"], "left_anti")
