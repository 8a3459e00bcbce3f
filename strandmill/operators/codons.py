"""Codon grouping: substitutions of one codon translated together.

genes: gene_id, contig, start, end, strand, phase. snvs: contig, pos, ref, alt.
A codon is one group of a shuffled aggregate on (gene_id, codon_start); its
alternatives are the product of the alleles of its positions, at most 27.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import aa, consequence, dna
from strandmill.operators.intervals import interval_join
from strandmill.operators.reference import lookup
from strandmill.operators.transcripts import coding_sequences, transcript_offsets


def with_bounds(genes: DataFrame) -> DataFrame:
    """genes with eff_start and eff_end: the phase is skipped at the transcript's start."""
    plus = F.col("strand") == "+"
    phase = F.coalesce("phase", F.lit(0)).cast("long")
    return genes.withColumn("eff_start", F.when(plus, F.col("start") + phase).otherwise(F.col("start"))).withColumn("eff_end", F.when(plus, F.col("end")).otherwise(F.col("end") - phase))


def codon_columns(pos: Column) -> tuple[Column, Column, Column]:
    """(codon_start, aa_local, cds_local) of a position in a bounded gene; codon_start is null where the codon is incomplete."""
    plus = F.col("strand") == "+"
    local = F.when(plus, pos - F.col("eff_start")).otherwise(F.col("eff_end") - pos)
    k = F.floor(local / 3)
    low = F.when(plus, F.col("eff_start") + k * 3).otherwise(F.col("eff_end") - k * 3 - 2)
    whole = (local >= 0) & (low >= F.col("eff_start")) & (low + 2 <= F.col("eff_end"))
    return F.when(whole, low).cast("long"), F.when(whole, k + 1).cast("long"), F.when(whole, local + 1).cast("long")


def place_snvs(snvs: DataFrame, genes: DataFrame) -> DataFrame:
    """A row per SNV and gene that holds it, with codon_start, aa_local, cds_local."""
    spans = with_bounds(genes).withColumnRenamed("start", "g_start").withColumnRenamed("end", "g_end")
    rows = interval_join(snvs.withColumn("_p", F.col("pos")), spans, "contig", "pos", "_p", "g_start", "g_end").drop("_p")
    low, aa_local, cds_local = codon_columns(F.col("pos"))
    return rows.withColumn("codon_start", low).withColumn("aa_local", aa_local).withColumn("cds_local", cds_local)


def codon_groups(placed: DataFrame) -> DataFrame:
    """One row a codon: gene columns and sites, an array of (pos, ref, cds, alts), both levels sorted."""
    keys = ["gene_id", "contig", "strand", "codon_start", "aa_local"]
    rows = placed.where("codon_start is not null")
    site = rows.groupBy(*keys, "pos", "ref", "cds_local").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    return site.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", F.col("cds_local").alias("cds"), "alts"))).alias("sites"))


def representative_info(placed: DataFrame) -> DataFrame:
    """gene_id, codon_start, oinfo: the first INFO, by position and allele, that any record of the codon has."""
    rows = placed.where("codon_start is not null")
    return rows.groupBy("gene_id", "codon_start").agg(F.min_by("oinfo", F.when(F.col("oinfo").isNotNull(), F.struct("pos", "alt"))).alias("oinfo"))


def alternatives(groups: DataFrame) -> DataFrame:
    """A row per combination of alleles: snvs, an array of (pos, ref, alt, cds) by position."""
    grow = lambda acc, s: F.flatten(F.transform(acc, lambda a: F.transform(s["alts"], lambda x: F.concat(a, F.array(F.struct(s["pos"].alias("pos"), s["ref"].alias("ref"), x.alias("alt"), s["cds"].alias("cds")))))))
    empty = F.expr("cast(array(array()) as array<array<struct<pos:bigint,ref:string,alt:string,cds:bigint>>>)")
    return groups.withColumn("snvs", F.explode(F.aggregate("sites", empty, grow))).drop("sites")


def _mutated(low: Column, codon: Column, snvs: Column) -> Column:
    """Reference-strand codon with the bases of snvs put in."""
    return F.aggregate(snvs, codon, lambda c, s: F.overlay(c, s["alt"], (s["pos"] - low + 1).cast("int"), F.lit(1)))


def annotate_codons(combos: DataFrame, reference: DataFrame, table: int = 11, protein_offset: Column | None = None) -> DataFrame:
    """Full annotation of each codon alternative: codons, residues, change types, shift, Grantham, doublet class, HGVS, SO term."""
    offset = F.lit(0) if protein_offset is None else protein_offset
    df = lookup(combos, reference, {"ref_seq": (F.col("codon_start"), F.lit(3))}, reach=3)
    low, strand, snvs = F.col("codon_start"), F.col("strand"), F.col("snvs")
    df = dna.once(df, _ref=F.col("ref_seq"))
    single = F.transform(snvs, lambda s: dna.oriented(F.overlay(F.col("_ref"), s["alt"], (s["pos"] - low + 1).cast("int"), F.lit(1)), strand))
    df = dna.once(df, ref_codon=dna.oriented(F.col("_ref"), strand), alt_codon=dna.oriented(_mutated(low, F.col("_ref"), snvs), strand), single_codons=single)
    return describe_codons(df.drop("ref_seq", "_ref"), table, offset)


def describe_codons(df: DataFrame, table: int, offset: Column) -> DataFrame:
    """What follows from ref_codon, alt_codon, single_codons, snvs, strand and aa_local."""
    strand, snvs = F.col("strand"), F.col("snvs")
    df = dna.once(df, ref_aa=dna.codon_residue(F.col("ref_codon"), table), alt_aa=dna.codon_residue(F.col("alt_codon"), table), aa_pos=F.col("aa_local") + offset)
    df = dna.once(df, single_aas=F.transform("single_codons", lambda c: dna.codon_residue(c, table)))
    n = F.size(snvs)
    df = df.withColumn("variant_type", F.when(n == 1, "SNP").otherwise("SNP/MNV"))
    df = dna.once(df, change_type=consequence.change_type(F.col("ref_aa"), F.col("alt_aa"), F.col("aa_pos")))
    df = df.withColumn("aa_change", aa.aa_change(F.col("ref_aa"), F.col("aa_pos"), F.col("alt_aa")))
    df = df.withColumn("snp_aa_changes", F.array_join(F.transform("single_aas", lambda x: aa.aa_change(F.col("ref_aa"), F.col("aa_pos"), x)), ", "))
    df = df.withColumn("local_aa_change", aa.aa_change(F.col("ref_aa"), F.col("aa_local"), F.col("alt_aa")))
    df = df.withColumn("local_snp_aa_changes", F.array_join(F.transform("single_aas", lambda x: aa.aa_change(F.col("ref_aa"), F.col("aa_local"), x)), ", "))
    df = df.withColumn("shift", consequence.consequence_shift(F.col("ref_aa"), F.col("alt_aa"), F.col("single_aas")))
    df = dna.once(df, grantham=F.when(F.col("change_type") == "Non-synonymous", aa.grantham(F.col("ref_aa"), F.col("alt_aa"))))
    adjacent = (n == 2) & (F.get(snvs, F.lit(1))["pos"] == F.get(snvs, F.lit(0))["pos"] + 1)
    two = lambda f: F.concat(F.get(snvs, F.lit(0))[f], F.get(snvs, F.lit(1))[f])
    df = df.withColumn("dbs_class", F.when(adjacent, aa.dbs_class(two("ref"), two("alt"))))
    df = df.withColumn("hgvs_g", consequence.hgvs_substitution(F.transform(snvs, lambda s: F.struct(s["pos"].alias("pos"), s["ref"].alias("ref"), s["alt"].alias("alt"))), "g."))
    base = lambda x: F.when(strand == "-", dna.complement(x)).otherwise(x)
    df = df.withColumn("hgvs_c", consequence.hgvs_substitution(F.transform(snvs, lambda s: F.struct((s["cds"] + offset * 3).alias("pos"), F.upper(base(s["ref"])).alias("ref"), F.upper(base(s["alt"])).alias("alt"))), "c."))
    no = F.lit(False), F.lit(None).cast("string")
    return df.withColumn("so_term", consequence.so_term(F.col("change_type"), *no, F.lit(1), F.lit(1))).withColumn("impact", consequence.so_impact(F.col("change_type"), *no)).withColumn("snp_codons", F.array_join("single_codons", ", ")).drop("single_codons")


def place_on_transcripts(snvs: DataFrame, segments: DataFrame) -> DataFrame:
    """A row per SNV and codon of a spliced transcript it lies in: codon_start holds the codon's number; a base two segments share lies in two."""
    rows = transcript_offsets(snvs, segments)
    k = F.floor(F.col("offset") / 3).cast("long")
    return rows.withColumn("codon_start", k).withColumn("aa_local", k + 1).withColumn("cds_local", F.col("offset") + 1)


def transcript_mnv(snvs: DataFrame, segments: DataFrame, reference: DataFrame, table: int = 11) -> DataFrame:
    """codon_mnv for spliced transcripts: codons are cut from the joined coding sequence, so they may cross junctions."""
    combos = alternatives(codon_groups(place_on_transcripts(snvs, segments)))
    df = combos.join(coding_sequences(segments, reference), "gene_id")
    at, strand = F.col("codon_start") * 3, F.col("strand")
    base = lambda x: F.when(strand == "-", dna.complement(x)).otherwise(x)
    put = lambda c, s: F.overlay(c, base(s["alt"]), (s["cds"] - at).cast("int"), F.lit(1))
    df = df.withColumn("ref_codon", F.substr("cds", (at + 1).cast("int"), F.lit(3))).where(F.length("ref_codon") == 3).drop("cds")
    df = df.withColumn("alt_codon", F.aggregate("snvs", F.col("ref_codon"), put)).withColumn("single_codons", F.transform("snvs", lambda s: put(F.col("ref_codon"), s)))
    return describe_codons(df, table, F.lit(0))


def codon_mnv(snvs: DataFrame, genes: DataFrame, reference: DataFrame, table: int = 11) -> DataFrame:
    """The kernel: SNVs to annotated codon alternatives."""
    return annotate_codons(alternatives(codon_groups(place_snvs(snvs, genes))), reference, table)
