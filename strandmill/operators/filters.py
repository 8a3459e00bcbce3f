"""Support filters of rows and records, genotype carriage, depth and frequency, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def keep_row(variant_type: Column, snp_ok: Column, mnv_ok: Column) -> Column:
    """Table rows: SNPs by their own side, SNP/MNV rows by either side, others by the haplotype side."""
    return F.when(variant_type == "SNP", snp_ok).when(variant_type == "SNP/MNV", snp_ok | mnv_ok).otherwise(mnv_ok)


def support_ok(reads: Column, depth: Column, forward: Column, reverse: Column, min_reads: int, min_freq: float, min_strand: int) -> Column:
    return (reads >= min_reads) & (ratio(reads, depth) >= min_freq) & (forward >= min_strand) & (reverse >= min_strand)


def vcf_filter(reads: Column, depth: Column, forward: Column, reverse: Column, p: Column, min_reads: int, min_freq: float, min_strand: int, min_p: float) -> Column:
    """FILTER text: tags in fixed order, PASS without any."""
    tags = F.array_compact(
        F.array(
            F.when(reads < min_reads, "LowSupport"),
            F.when((F.lit(min_freq) > 0) & (ratio(reads, depth) < min_freq), "LowFrequency"),
            F.when((forward < min_strand) | (reverse < min_strand), "StrandSupport"),
            F.when((F.lit(min_p) > 0) & (p < min_p), "StrandBias"),
        )
    )
    return F.when(F.size(tags) == 0, "PASS").otherwise(F.array_join(tags, ";"))


def carried(genotype: Column, alt_index: Column) -> Column:
    """A fully called genotype without the allele drops it; missing, partial or unreadable ones keep it."""
    alleles = F.split(genotype, r"[/|]")
    called = genotype.rlike(r"^\d+([/|]\d+)*$")
    return F.when(F.coalesce(called, F.lit(False)), F.exists(alleles, lambda a: a == alt_index.cast("string"))).otherwise(F.lit(True))


def as_fraction(text: Column) -> Column:
    """Frequency from text: percents, and numbers above 1 up to 100, are divided by 100."""
    percent = text.endswith("%")
    x = F.regexp_replace(text, "%$", "").try_cast("double")
    return F.when(percent | ((x > 1) & (x <= 100)), x / 100).otherwise(x)


def split_alternates(records: DataFrame) -> DataFrame:
    """A row per ALT of records whose alt is a comma list; alt_index counts from 1."""
    return records.select("*", F.posexplode(F.split("alt", ",")).alias("_i", "_alt")).withColumn("alt", F.col("_alt")).withColumn("alt_index", F.col("_i") + 1).drop("_i", "_alt")


def contig_summary(rows: DataFrame) -> DataFrame:
    """Counts by contig and over all (contig null): rows, by type, intergenic apart. rows: contig, variant_type, gene (null: intergenic)."""
    n = lambda c: F.count(F.when(c, 1))
    inside = F.col("gene").isNotNull()
    return rows.rollup("contig").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(n(inside & (F.col("variant_type") == t)).alias(a) for t, a in (("SNP", "n_snp"), ("MNV", "n_mnv"), ("SNP/MNV", "n_snp_mnv"), ("INDEL", "n_indel"))),
        n(~inside).alias("n_intergenic"),
    )


def mean_depth(depths: Column) -> Column:
    """Integer mean of an array of depths."""
    return F.when(F.size(depths) > 0, F.floor(F.aggregate(depths, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(depths)))


def strict_metrics(alleles: DataFrame, limit: int = 5) -> list:
    """Up to limit alleles without depth or frequency, for an error message."""
    return alleles.where("odp is null or ofreq is null").orderBy("contig", "pos", "alt").limit(limit).collect()
