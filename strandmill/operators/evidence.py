"""All read support of annotated rows, attached once: SNV sites, haplotypes, linkage, and indels.

A row is known by what it states (contig and components), so rows of several
genes that state the same share one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import alleles as al
from strandmill.functions.text import fixed, power
from strandmill.operators import reads
from strandmill.operators.filters import ratio
from strandmill.scratch import materialize

ALLELE = ["contig", "pos", "ref", "alt"]
#: What attach_support adds: arrays over a row's sites (snp_freq as text), counts of its haplotype, linkage, and counts of an indel.
SITE_COLUMNS = ("snp_reads", "snp_forward", "snp_reverse", "site_depth", "snp_freq")
ROW_COLUMNS = ("mnv_reads", "mnv_forward", "mnv_reverse", "mnv_depth", "phasing_reads", "phasing_support", "ld", "ld_p")
EVENT_COLUMNS = ("event_reads", "event_forward", "event_reverse", "event_depth")


def substitution_support(rows: DataFrame, aligned: DataFrame, quality: int = 20, min_mapq: int = 0, pair_aware: bool = True) -> DataFrame:
    """contig, components, SITE_COLUMNS, ROW_COLUMNS of each distinct substitution row (contig, components, positions, alt_bases).

    At a site of a row of several, molecules that carry the whole haplotype
    count for it and not for the site. Molecules are merged and written once;
    everything else is read from them.
    """
    key = ["contig", "components"]
    distinct = materialize(rows.select(*key, "positions", "alt_bases").dropDuplicates(key), "substitutions")
    sites = F.posexplode(F.arrays_zip("positions", "alt_bases")).alias("idx", "m")
    members = distinct.select(*key, F.size("positions").alias("n"), sites).select(*key, "n", "idx", F.col("m.positions").alias("pos"), F.col("m.alt_bases").alias("alt"))
    use = reads.usable(aligned, min_mapq)
    merged = materialize(reads.merge_molecules(reads.observe_sites(use, members.select("contig", "pos").distinct(), pair_aware)), "molecules")
    # the key holds the contig, which molecules are joined by: haplotypes are told apart by a struct of it
    own = members.withColumn("row", F.struct(*key))
    patterns = materialize(reads.molecule_patterns(merged, own.drop("components"), ["row"], quality).select("row.*", "*").drop("row"), "patterns")
    n = lambda c: F.count(F.when(c, 1))
    many = F.col("n") > 1
    whole = patterns.groupBy(*key).agg(
        n(many & F.col("carries")).alias("mnv_reads"), n(many & F.col("carries_fwd")).alias("mnv_forward"), n(many & F.col("carries_rev")).alias("mnv_reverse"), n(F.col("spans")).alias("mnv_depth")
    )
    shown = patterns.where((F.col("n") == 1) | ~F.col("carries")).select(*key, "spans", F.explode("sites").alias("s")).where("s.hit = 1")
    alone = shown.groupBy(*key, F.col("s.idx").alias("idx")).agg(F.count(F.lit(1)).alias("snp_reads"), n(F.col("s.fwd") == 1).alias("snp_forward"), n(F.col("s.rev") == 1).alias("snp_reverse"), n(F.col("spans")).alias("informative"))
    depth = merged.where(F.col("quality") >= quality).groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("site_depth"))
    at = members.join(alone, [*key, "idx"], "left").join(depth, ["contig", "pos"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    at = at.select(*key, "n", "idx", *(zero(c).alias(c) for c in (*SITE_COLUMNS[:4], "informative")))
    at = at.withColumn("snp_freq", fixed(ratio(F.col("snp_reads"), F.col("site_depth"))))
    listed = F.array_sort(F.collect_list(F.struct("idx", *SITE_COLUMNS, "informative")))
    lists = at.groupBy(*key, "n").agg(listed.alias("l"))
    field = lambda c: F.transform("l", lambda x: x[c]).alias(c)
    lists = lists.select(*key, "n", *map(field, SITE_COLUMNS), F.array_min(F.transform("l", lambda x: x["informative"])).alias("least"))
    linked = reads.codon_linkage(reads.pattern_counts(patterns, key), key).select(*key, F.col("d_prime").alias("ld"), F.col("p").alias("ld_p"))
    out = lists.join(whole, key, "left").join(linked, key, "left")
    out = out.select(*key, "n", *SITE_COLUMNS, *(zero(c).alias(c) for c in ROW_COLUMNS[:4]), "least", "ld", "ld_p")
    told = F.when(F.col("n") > 1, F.nullif(F.col("mnv_reads") + F.col("least"), F.lit(0)))
    out = out.withColumn("phasing_reads", told).withColumn("phasing_support", F.col("mnv_reads") / F.col("phasing_reads"))
    return out.select(*key, *SITE_COLUMNS, *ROW_COLUMNS)


def indel_row_support(events: DataFrame, aligned: DataFrame, quality: int = 20, min_mapq: int = 0, pair_aware: bool = True, anchor_depth: bool = True) -> DataFrame:
    """contig, components (as text), EVENT_COLUMNS of each indel (ALLELE, components); of records that state the same the first counts."""
    spelled = events.where(~F.col("alt").startswith("<")).select(*ALLELE, "components").dropDuplicates(ALLELE)
    views = reads.observe_alleles(reads.usable(aligned, min_mapq), spelled, pair_aware)
    counted = reads.indel_support(views, ALLELE, quality, anchor_depth).select(*ALLELE, *EVENT_COLUMNS)
    rows = spelled.join(counted, ALLELE).withColumn("components", al.labels(F.col("components")))
    return rows.groupBy("contig", "components").agg(F.min_by(F.struct(*EVENT_COLUMNS), F.struct("pos", "ref", "alt")).alias("e")).select("contig", "components", "e.*")


def attach_support(rows: DataFrame, events: DataFrame, aligned: DataFrame, quality: int = 20, min_mapq: int = 0, pair_aware: bool = True, anchor_depth: bool = True) -> DataFrame:
    """rows (of annotate) with SITE_COLUMNS, ROW_COLUMNS and EVENT_COLUMNS: null where a row is of the other kind; an indel without reads has zeros."""
    indel = F.col("variant_type") == "INDEL"
    subs = substitution_support(rows.where(~indel), aligned, quality, min_mapq, pair_aware)
    own = indel_row_support(events, aligned, quality, min_mapq, pair_aware, anchor_depth)
    out = rows.drop("phasing_support").join(subs, ["contig", "components"], "left").join(own, ["contig", "components"], "left")
    for c in EVENT_COLUMNS:
        out = out.withColumn(c, F.when(indel, F.coalesce(c, F.lit(0)).cast("long")))
    return out


def read_cells(rows: DataFrame) -> dict:
    """The cells that reads give, by title of the result table, as text; a dash where a row has no such count."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    sites = lambda c: dash(F.array_join(F.transform(c, lambda x: x.cast("string")), ", "))
    one = lambda c: dash(F.col(c).cast("string"))
    counted = F.col("snp_reads").isNotNull()
    mean = F.floor(F.aggregate("site_depth", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("site_depth"))
    # a row of one site has the site's depth behind both of its frequencies
    depth = F.when(F.size("site_depth") == 1, F.get("site_depth", F.lit(0))).otherwise(F.col("mnv_depth"))
    total = F.when(F.col("variant_type") == "SNP", mean).otherwise(depth)
    return {
        "SNP Reads": sites("snp_reads"), "SNP Forward Reads": sites("snp_forward"), "SNP Reverse Reads": sites("snp_reverse"),
        "MNV Reads": one("mnv_reads"), "MNV Forward Reads": one("mnv_forward"), "MNV Reverse Reads": one("mnv_reverse"),
        "Total Reads": dash(total.cast("string")), "SNP Frequencies": dash(F.array_join("snp_freq", ", ")), "MNV Frequencies": dash(F.when(counted, fixed(ratio(F.col("mnv_reads"), depth)))),
        "Event Reads": one("event_reads"), "Event Forward Reads": one("event_forward"), "Event Reverse Reads": one("event_reverse"), "Event Depth": one("event_depth"),
        "Event Frequency": dash(F.when(F.col("event_depth").isNotNull(), fixed(ratio(F.col("event_reads"), F.col("event_depth"))))),
        "MNV Phasing Support": dash(fixed(F.least(F.col("phasing_support"), F.lit(1.0)))), "Haplotype LD": dash(fixed(F.col("ld"))), "Haplotype LD p": dash(power(F.col("ld_p"))), "MNV Phasing Reads": one("phasing_reads"),
    }


def passes_support(min_snp_reads: int = 0, min_snp_freq: float = 0.0, min_snp_strand: int = 0, min_mnv_reads: int = 0, min_mnv_freq: float = 0.0, min_mnv_strand: int = 0):
    """Whether a row of attach_support stays in the table: SNPs by all of their sites, haplotypes by their own counts, SNP/MNV rows by either, indels by theirs; a row that nothing counted stays unless a haplotype filter asks and it lies outside of genes."""
    site = F.forall(F.arrays_zip(*SITE_COLUMNS), lambda x: (x["snp_reads"] >= min_snp_reads) & (ratio(x["snp_reads"], x["site_depth"]) >= min_snp_freq) & (x["snp_forward"] >= min_snp_strand) & (x["snp_reverse"] >= min_snp_strand))
    side = lambda n, d, f, r: (F.col(n) >= min_mnv_reads) & (ratio(F.col(n), d) >= min_mnv_freq) & (F.col(f) >= min_mnv_strand) & (F.col(r) >= min_mnv_strand)
    depth = F.when(F.size("site_depth") == 1, F.get("site_depth", F.lit(0))).otherwise(F.col("mnv_depth"))
    mnv, event = side("mnv_reads", depth, "mnv_forward", "mnv_reverse"), side("event_reads", F.col("event_depth"), "event_forward", "event_reverse")
    asks = F.lit(min_mnv_reads > 0 or min_mnv_freq > 0 or min_mnv_strand > 0)
    kind = F.col("variant_type")
    uncounted = F.col("snp_reads").isNull() & F.col("event_depth").isNull()
    verdict = F.when(uncounted, (F.col("gene_id") != "intergenic") | ~asks).when(kind == "INDEL", event).when(kind == "SNP", site).when(kind == "SNP/MNV", site | mnv).otherwise(mnv)
    return F.lit(True) if not any((min_snp_reads, min_snp_freq, min_snp_strand, min_mnv_reads, min_mnv_freq, min_mnv_strand)) else F.coalesce(verdict, F.lit(True))
