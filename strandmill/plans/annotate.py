"""The whole plan: alleles, genes and reference (and reads) to one annotated table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.errors import guard
from strandmill.functions import alleles as al
from strandmill.functions import consequence
from strandmill.operators import codons, fallback, frames, indels, linkage, reads, transcripts
from strandmill.operators.reference import anchor_insertions, intervals_sequence, reference_mismatches
from strandmill.scratch import materialize
from strandmill.sources.vcf import missing_contigs


@dataclass(frozen=True)
class Params:
    """Query parameters and their defaults."""

    quality: int = 20
    min_mapq: int = 0
    frameshift_min_freq: float = 0.5
    pair_aware: bool = True
    translation_table: int = 11


COLUMNS = "contig gene_id positions ref_bases alt_bases aa_change snp_aa_changes local_aa_change local_snp_aa_changes variant_type change_type ref_codon snp_codons alt_codon event_class components so_term impact grantham shift dbs_class frameshift_phasing nmd hgvs_g hgvs_c".split()
ALLELE = ["contig", "pos", "ref", "alt"]


def _none() -> Column:
    return F.lit(None).cast("string")


def _shape(df: DataFrame) -> DataFrame:
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("int" if c == "grantham" else "array<bigint>" if c == "positions" else "array<string>" if c in ("ref_bases", "alt_bases") else "string"))
    return df.withColumn("gene_id", F.col("gene_id").cast("string")).select(*COLUMNS)


def _codon_rows(rows: DataFrame) -> DataFrame:
    part = lambda f: F.transform("snvs", lambda s: s[f])
    comps = F.transform("snvs", lambda s: al.component("SNV", s["pos"], s["ref"], s["alt"]))
    return rows.withColumn("positions", part("pos")).withColumn("ref_bases", part("ref")).withColumn("alt_bases", part("alt")).withColumn("components", al.labels(comps)).withColumn("event_class", F.when(F.size("snvs") > 1, "mnv").otherwise("snp"))


def _with_term(rows: DataFrame) -> DataFrame:
    """so_term and impact of the change type, with the splice class beside it where the row has one."""
    lengths = (F.length("ref"), F.length("alt")) if "ref" in rows.columns else (F.lit(1), F.lit(1))
    none = F.lit(False), _none()
    rows = rows.withColumn("so_term", consequence.so_term(F.col("change_type"), *none, *lengths)).withColumn("impact", consequence.so_impact(F.col("change_type"), *none))
    if "splice" not in rows.columns:
        return rows
    term, impact = consequence.with_splice(F.col("so_term"), F.col("impact"), F.col("splice"), F.lit(True))
    return rows.withColumn("_t", term).withColumn("_i", impact).withColumn("so_term", F.col("_t")).withColumn("impact", F.col("_i"))


def prepare(alleles: DataFrame, reference: DataFrame) -> DataFrame:
    """Checked alleles with their events: REF agrees with the reference, insertions are left-anchored, reference calls are gone."""
    guard(reference_mismatches(alleles, reference).select("contig", "pos", "ref"), "REF differs from the reference", "E106")
    events = al.with_event(alleles)
    moved = anchor_insertions(events, reference).drop("event_class", "components", "affected_start", "affected_end")
    return al.with_event(moved).where("event_class <> 'reference'")


def _linked(rows: DataFrame, place, upstream: DataFrame, evidence: linkage.Evidence | None) -> DataFrame:
    """rows with what the reads say of upstream indels: trans_shift and frameshift_phasing."""
    if evidence is None:
        return rows
    told = linkage.codon_linkage(rows.withColumn("place", place), upstream, evidence.pairs)
    return rows.join(told, ["gene_id", "codon_start", "snvs"], "left")


def _plain(snvs: DataFrame, ind: DataFrame, genes: DataFrame, reference: DataFrame, evidence: linkage.Evidence | None, p: Params) -> tuple[DataFrame, DataFrame]:
    """(codon rows, indel rows) of genes of one feature."""
    placed = indels.place_indels(ind, genes)
    rows = materialize(codons.codon_mnv(snvs, genes, reference, p.translation_table), "codon-rows")
    states = indels.frame_states(rows.select("gene_id", "strand", "codon_start").distinct(), placed, p.frameshift_min_freq)
    seqs = intervals_sequence(genes, reference, ["gene_id"], "start", "end")
    effect = materialize(indels.protein_effects(placed, seqs, p.translation_table, F.col("protein_offset") if "protein_offset" in genes.columns else None), "indel-effects")
    order = indels.upstream_key(F.col("components"), F.col("strand")).alias("order")
    upstream = effect.where(indels.passes_gate(F.col("observed"), F.col("af"), p.frameshift_min_freq)).select("gene_id", *ALLELE, order, "delta")
    rows = _linked(rows, indels.codon_key(F.col("strand"), F.col("codon_start")), upstream, evidence)
    rows = indels.relabel_rows(rows, states, indels.premature_stops(effect, p.frameshift_min_freq))
    return _shape(_codon_rows(_with_term(rows))), effect.withColumn("nmd", _none()).withColumn("splice", _none())


def _spliced(snvs: DataFrame, ind: DataFrame, models: DataFrame, reference: DataFrame, evidence: linkage.Evidence | None, p: Params) -> tuple[DataFrame, DataFrame]:
    """(codon rows, indel rows) of transcripts of several segments, on transcript offsets."""
    ranges = materialize(frames.touched_ranges(ind, models), "touched-ranges")
    effect = indels.spliced_effects(ind, models, reference, p.translation_table)
    effect = effect.join(frames.first_offsets(ranges).drop("strand"), ["gene_id", *ALLELE], "left").join(ind.select(*ALLELE, "af", "observed").dropDuplicates(ALLELE), ALLELE)
    effect = materialize(effect.withColumn("delta", F.when(F.col("alt_cds").isNotNull(), F.col("delta"))), "spliced-effects")
    last = transcripts.last_junctions(models)
    rows = materialize(codons.transcript_mnv(snvs, models, reference, p.translation_table), "spliced-rows")
    states = frames.frame_states(rows.select("gene_id", "codon_start"), effect, ranges, p.frameshift_min_freq)
    upstream = effect.where(indels.passes_gate(F.col("observed"), F.col("af"), p.frameshift_min_freq)).select("gene_id", *ALLELE, F.col("effective").alias("order"), "delta")
    rows = _linked(rows, F.col("codon_start") * 3, upstream, evidence)
    rows = indels.relabel_rows(rows, states, indels.premature_stops(effect, p.frameshift_min_freq))
    rows = rows.join(last, "gene_id", "left").withColumn("nmd", F.when(F.col("change_type") == "Stop gained", indels.nmd(F.col("codon_start") * 3, F.col("last_junction"))))
    hits = transcripts.splice_hits(snvs.select("contig", "pos").distinct(), models).select("gene_id", "pos", "splice")
    touched = rows.select("gene_id", "codon_start", "snvs", F.explode(F.transform("snvs", lambda s: s["pos"])).alias("pos")).join(hits, ["gene_id", "pos"])
    worst = touched.groupBy("gene_id", "codon_start", "snvs").agg(F.coalesce(F.max(F.when(F.col("splice") != "splice_region_variant", F.col("splice"))), F.max("splice")).alias("splice"))
    rows = rows.join(worst, ["gene_id", "codon_start", "snvs"], "left")
    effect = indels.with_codons(frames.altered_nmd(effect, last), F.col("first_touched"))
    return _shape(_codon_rows(_with_term(rows))), effect.join(transcripts.allele_splice(ind, models), ["gene_id", *ALLELE], "left")


def _fallback_rows(classed: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of classified components (contig, pos, ref, alt, kind, label, gene_id, term)."""
    if "coding" in genes.columns:
        quiet = genes.where("not coding").select("gene_id", F.lit(True).alias("_nc"))
        classed = classed.join(quiet, "gene_id", "left").withColumn("term", F.when(F.col("_nc") & (F.col("term") == "coding_sequence_variant"), "non_coding_transcript_exon_variant").otherwise(F.col("term")))
    splice = F.col("term").isin(*consequence.SPLICE_IMPACT)
    loss = F.when(splice & (F.col("term") == "splice_region_variant"), "LOW").when(splice, "HIGH").otherwise("MODIFIER")
    out = classed.withColumn("positions", F.array("pos")).withColumn("ref_bases", F.array("ref")).withColumn("alt_bases", F.array("alt")).withColumn("variant_type", F.when(F.col("kind") == "SNV", "SNP").otherwise("INDEL")).withColumn("change_type", F.lit("Unknown"))
    return _shape(out.withColumn("so_term", F.col("term")).withColumn("impact", loss).withColumn("hgvs_g", consequence.hgvs_component(F.col("kind"), F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("components", F.col("label")).withColumn("gene_id", F.coalesce(F.col("gene_id").cast("string"), F.lit("intergenic"))))


def annotate(alleles: DataFrame, genes: DataFrame, reference: DataFrame, segments: DataFrame | None = None, params: Params = Params(), aligned: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """COLUMNS of every row: codon rows of plain and spliced genes, indel rows, fallback rows for what no codon speaks for, and what further genes say of it.

    genes: gene_id, contig, start, end, strand, phase, coding. segments: of the
    spliced genes among them (seg_idx in transcript order). aligned: reads; they
    give indels their observed frequency, and keep an upstream indel that lies
    on other molecules than a codon's SNVs from shifting its frame.
    """
    missing = missing_contigs(alleles, reference).where("source = 'reference'")
    guard(missing.select("contig"), "contigs of the alleles are not in the reference", "E106")
    events = materialize(prepare(alleles, reference), "events")  # what several branches read is written once
    is_snv = F.forall("components", lambda c: c["kind"] == "SNV")
    af = F.col("ofreq") if "ofreq" in events.columns else F.lit(None).cast("double")
    snvs = events.select("contig", F.explode(al.substitution_components(F.col("components"))).alias("c")).select("contig", "c.pos", "c.ref", "c.alt").distinct()
    coding = genes.where("coding") if "coding" in genes.columns else genes
    spliced = segments.groupBy("gene_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gene_id") if segments is not None else None
    plain = coding if spliced is None else coding.join(spliced, "gene_id", "left_anti")

    # an allele that several records hold is one, at the highest of their frequencies
    ind = events.where(~is_snv).groupBy(*ALLELE, "components", "event_class", "affected_start", "affected_end").agg(F.max(af).alias("af"))
    evidence = None
    if aligned is not None:
        evidence = linkage.indel_evidence(ind, snvs, aligned, params.quality, params.min_mapq, params.pair_aware)
        ind = ind.join(evidence.observed, ALLELE, "left")
    else:
        ind = ind.withColumn("observed", F.lit(None).cast("double"))
    out, effect = _plain(snvs, ind, plain, reference, evidence, params)
    cols = ["gene_id", *ALLELE, "components", "change_type", "protein_change", "local_change", "ref_codon", "alt_codon", "nmd", "splice"]
    told = effect.select(*cols)
    if spliced is not None:
        models = segments.join(spliced, "gene_id", "left_semi")
        rows, effect = _spliced(snvs, ind, models, reference, evidence, params)
        out, told = out.unionByName(rows), told.unionByName(effect.select(*cols))
    told = told.join(ind.select(*ALLELE, "event_class").distinct(), ALLELE)
    told = _with_term(told).withColumn("positions", F.array("pos")).withColumn("ref_bases", F.array("ref")).withColumn("alt_bases", F.array("alt")).withColumn("variant_type", F.lit("INDEL"))
    told = told.withColumn("aa_change", F.col("protein_change")).withColumn("local_aa_change", F.col("local_change")).withColumn("hgvs_g", consequence.hgvs_indel(F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("components", al.labels(F.col("components")))
    out = materialize(out.unionByName(_shape(told)), "coded")

    # what no row carries, by label: the best claim of any gene, else intergenic; then what every gene adds
    every = events.select("contig", F.explode("components").alias("c")).select("contig", F.col("c.pos").alias("pos"), "c.ref", "c.alt", "c.kind", al.label(F.col("c")).alias("label")).distinct()
    spoken = out.select("contig", "gene_id", F.explode(F.split("components", r" \| ")).alias("label"))
    segs = segments if segments is not None else coding.select("gene_id", "contig", "strand", F.lit(0).alias("seg_idx"), "start", "end")
    spans, segs = (x.withColumn("gene_id", F.col("gene_id").cast("string")) for x in (genes.select("gene_id", "contig", "start", "end"), segs))
    first = materialize(fallback.classify(fallback.unspoken(every, spoken), spans, segs), "fallback")
    said = first.where("gene_id is not null").select("gene_id", "label", "term", F.lit(False).alias("coded")).unionByName(spoken.select("gene_id", "label", _none().alias("term"), F.lit(True).alias("coded")))
    more = fallback.second_pass(every, spans, segs, said).select(*first.columns)
    return out.unionByName(_fallback_rows(first.unionByName(more), genes.withColumn("gene_id", F.col("gene_id").cast("string"))))


def row_order() -> list:
    """Order of rows within a contig: first position, positions, type, gene."""
    rank = F.when(F.col("variant_type") == "SNP", 0).when(F.col("variant_type") == "MNV", 1).when(F.col("variant_type") == "SNP/MNV", 2).otherwise(3)
    return [F.array_min("positions"), F.col("positions"), rank, F.col("gene_id").cast("string")]


def record_order() -> list:
    """Order of VCF records within a contig: position, then their text."""
    return [F.col("pos"), F.col("ref"), F.col("alt")]


def ordered(rows: DataFrame) -> DataFrame:
    """Final order: contig, first position, positions, type, gene."""
    return rows.orderBy("contig", *row_order())


def read_support(rows: DataFrame, aligned: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """Substitution rows with haplotype and single-site read counts: mnv_reads, mnv_forward, mnv_reverse, mnv_depth, phasing_support, snp_reads.

    Reads meet only the sites of the rows, by bins; molecules are merged once
    and shared by all rows of a site.
    """
    keyed = rows.withColumn("row_id", F.struct("contig", "gene_id", "components"))
    subs = keyed.where("variant_type <> 'INDEL'")
    members = subs.select("row_id", "contig", F.posexplode(F.arrays_zip("positions", "alt_bases")).alias("idx", "m"), F.size("positions").alias("n")).select("row_id", "contig", "idx", "n", F.col("m.positions").alias("pos"), F.col("m.alt_bases").alias("alt"))
    use = reads.usable(aligned, params.min_mapq)
    merged = reads.merge_molecules(reads.observe_sites(use, members.select("contig", "pos").distinct(), params.pair_aware))
    patterns = reads.molecule_patterns(merged, members, ["row_id"], params.quality)
    support = reads.mnv_support(patterns, ["row_id"])
    phased = reads.phasing_support(patterns, members, ["row_id"]).select("row_id", "phasing_support")
    solo = members.select("row_id", "idx", "n").join(reads.solo_support(patterns, ["row_id"]), ["row_id", "idx"], "left")
    whole = patterns.where("carries and n = 1").groupBy("row_id").agg(F.count(F.lit(1)).alias("_one"))
    solo = solo.join(whole, "row_id", "left").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.when(F.col("n") == 1, F.coalesce("_one", F.lit(0))).otherwise(F.coalesce("solo_reads", F.lit(0))).alias("r")))), lambda x: x["r"]).alias("snp_reads"))
    return keyed.join(support, "row_id", "left").join(phased, "row_id", "left").join(solo, "row_id", "left").drop("row_id")
