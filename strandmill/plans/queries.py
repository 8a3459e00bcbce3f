"""Queries of the variant engine over the derived genome; each has SQL of the same name in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import aa, alleles, consequence, dna, stats
from strandmill.operators import codons, fallback, filters, indels, phase, reads, reference, transcripts
from strandmill.operators.intervals import interval_join
from strandmill.plans.fixture import Genome
from strandmill.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MIN_QUALITY = 20


def query(f: Callable[[Genome], DataFrame]) -> Callable[[Genome], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Genome(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def _join(array, f) -> F.Column:
    return F.array_join(F.transform(array, f), ",")


def _text(c) -> F.Column:
    return c.cast("string")


def _events(g: Genome) -> DataFrame:
    return alleles.with_event(g.indels())


@query
def q01_reference_lookup(g):
    """Three bases at every SNV."""
    rows = g.snvs().select("contig", "pos", "ref").distinct()
    seen = reference.lookup(rows, g.reference(), {"next3": (F.col("pos"), F.lit(3))}, reach=3)
    return seen.select("contig", "pos", "ref", "next3", (F.substring("next3", 1, 1) == F.col("ref")).alias("agrees"))


@query
def q02_revcomp_translate_genes(g):
    seqs = reference.intervals_sequence(g.genes(), g.reference(), ["gene_id", "strand"], "start", "end")
    cds = dna.oriented(F.col("seq"), F.col("strand"))
    return seqs.select("gene_id", "strand", cds.alias("cds"), dna.translate(cds).alias("protein"))


@query
def q03_variant_gene_interval_join(g):
    return codons.place_snvs(g.snvs(), g.genes()).select("gene_id", "contig", "pos", "ref", "alt")


@query
def q04_gene_semi_join(g):
    v = g.snvs().withColumn("p2", F.col("pos")).select("contig", F.col("pos").alias("p1"), "p2")
    return interval_join(g.genes(), v, "contig", "start", "end", "p1", "p2", how="left_semi").select("gene_id", "contig", "start", "end", "strand")


@query
def q05_intergenic_anti_join(g):
    v = g.snvs().withColumn("p2", F.col("pos")).select("contig", "pos", "p2", "ref", "alt")
    genes = g.genes().withColumnsRenamed({"start": "gs", "end": "ge"})
    return interval_join(v, genes, "contig", "pos", "p2", "gs", "ge", how="left_anti").select("contig", "pos", "ref", "alt")


@query
def q06_decompose_alleles(g):
    return _events(g).select("contig", "pos", "ref", "alt", "event_class", alleles.labels(F.col("components")).alias("components"), "affected_start", "affected_end", alleles.observed_span(F.col("ref"), F.col("components")).cast("long").alias("span"))


@query
def q07_changed_positions(g):
    return _events(g).select("contig", "pos", "ref", "alt", _join(alleles.changed_positions(F.col("components"), F.col("pos")), _text).alias("positions"))


@query
def q08_drop_reference_calls(g):
    """Every third SNV is written as a reference call, which goes."""
    v = g.snvs().withColumn("alt", F.when(F.col("pos") % 3 == 0, F.col("ref")).otherwise(F.col("alt")))
    return alleles.with_event(v).where("event_class <> 'reference'").select("contig", "pos", "ref", "alt", "event_class")


@query
def q09_multiallelic_split(g):
    """Records with comma lists of alternates and depths, split to alleles with their own depth and frequency."""
    v = g.snvs().groupBy("contig", "pos", "ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt", "odp"))), lambda x: x["alt"]), ",").alias("alt"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt", "odp"))), lambda x: x["odp"].cast("string")), ",").alias("ad"))
    rows = filters.split_alternates(v)
    depth = F.element_at(F.split("ad", ","), F.col("alt_index").cast("int")).cast("long")
    total = F.aggregate(F.split("ad", ","), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return rows.select("contig", "pos", "ref", "alt", F.col("alt_index").cast("int").alias("alt_index"), depth.alias("ad"), F.round(filters.ratio(depth, total), 6).alias("af"))


@query
def q10_codon_bounds(g):
    return codons.place_snvs(g.snvs(), g.genes()).select("gene_id", "pos", "alt", "codon_start", "aa_local", "cds_local")


@query
def q11_codon_groups(g):
    rows = codons.codon_groups(codons.place_snvs(g.snvs(), g.genes()))
    return rows.select("gene_id", "codon_start", F.size("sites").cast("int").alias("n_sites"), _join(F.col("sites"), lambda s: F.concat(s["pos"].cast("string"), s["ref"], F.lit(">"), F.array_join(s["alts"], "/"))).alias("sites"))


@query
def q12_codon_alternatives(g):
    rows = codons.alternatives(codons.codon_groups(codons.place_snvs(g.snvs(), g.genes())))
    return rows.select("gene_id", "codon_start", _join(F.col("snvs"), lambda s: F.concat(s["pos"].cast("string"), s["ref"], F.lit(">"), s["alt"])).alias("snvs"))


def _codon_rows(g: Genome) -> DataFrame:
    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference())
    return rows.withColumn("snvs", _join(F.col("snvs"), lambda s: F.concat(s["pos"].cast("string"), s["ref"], F.lit(">"), s["alt"])))


@query
def q13_codon_mnv(g):
    """The flagship: SNVs of a codon translated together."""
    return _codon_rows(g).select("gene_id", "contig", "strand", "codon_start", "snvs", "variant_type", "ref_codon", "alt_codon", "ref_aa", "alt_aa", "aa_pos", "aa_change", "snp_aa_changes", "change_type")


@query
def q14_change_type(g):
    return _codon_rows(g).groupBy("contig", "variant_type", "change_type").agg(F.count(F.lit(1)).alias("n"))


@query
def q15_consequence_shift(g):
    return _codon_rows(g).where("variant_type = 'SNP/MNV'").select("gene_id", "codon_start", "snvs", F.array_join("single_aas", "").alias("single_aas"), "alt_aa", "shift")


@query
def q16_grantham(g):
    return _codon_rows(g).where("grantham is not null").select("gene_id", "codon_start", "snvs", "ref_aa", "alt_aa", "grantham", aa.grantham_category(F.col("grantham")).alias("category"))


@query
def q17_dbs_class(g):
    return _codon_rows(g).where("dbs_class is not null").select("gene_id", "codon_start", "snvs", "dbs_class")


@query
def q18_hgvs(g):
    return _codon_rows(g).select("gene_id", "codon_start", "snvs", "hgvs_g", "hgvs_c")


@query
def q19_so_impact_summary(g):
    rows = _codon_rows(g).rollup("contig", "impact", "so_term").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("contig", "impact", "so_term", "n")


@query
def q20_translation_tables(g):
    """Codons of the genes with their number, under every genetic code."""
    seqs = reference.intervals_sequence(g.genes(), g.reference(), ["gene_id", "strand"], "start", "end")
    cds = dna.oriented(F.col("seq"), F.col("strand"))
    codes = seqs.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.length("seq") / 3) - 1), lambda i: F.substr(cds, (i * 3 + 1).cast("int"), F.lit(3)))).alias("codon"))
    counted = materialize(codes.groupBy("codon").agg(F.count(F.lit(1)).alias("n")), "codons")
    tables = [counted.select(F.lit(t).alias("table_id"), "codon", dna.codon_residue(F.col("codon"), t).alias("aa"), "n") for t in dna.GENETIC_CODES]
    return reduce(DataFrame.unionByName, tables)


@query
def q21_transcript_offsets(g):
    pos = g.snvs().select("contig", "pos").distinct()
    return transcripts.transcript_offsets(pos, g.segments()).select("gene_id", "contig", "pos", F.col("seg_idx").cast("int").alias("seg_idx"), "offset")


@query
def q22_introns(g):
    return transcripts.introns(g.segments()).select("gene_id", "contig", "intron", "start", "end")


@query
def q23_splice_class(g):
    pos = g.snvs().select("contig", "pos").distinct()
    return transcripts.splice_hits(pos, g.segments()).select("gene_id", "contig", "pos", "splice")


@query
def q24_spliced_cds(g):
    rows = transcripts.coding_sequences(g.segments(), g.reference())
    return rows.select("gene_id", "cds", dna.translate(F.col("cds")).alias("protein"))


def _transcript_rows(g: Genome) -> DataFrame:
    return codons.transcript_mnv(g.snvs().select("contig", "pos", "ref", "alt"), g.segments(), g.reference())


@query
def q25_junction_codon_mnv(g):
    """SNVs by codon of the spliced transcript, codons across junctions too, a row per combination of alleles."""
    far = F.array_max(F.transform("snvs", lambda s: s["pos"])) - F.array_min(F.transform("snvs", lambda s: s["pos"])) > 2
    return _transcript_rows(g).select("gene_id", F.col("codon_start").alias("codon"), F.size("snvs").alias("n_sites"), "ref_codon", "alt_codon", "ref_aa", "alt_aa", far.alias("crosses"))


@query
def q26_protein_offset(g):
    rows = transcripts.protein_offsets(g.segments().withColumn("phase", F.col("gene_id") % 3))
    return rows.select("gene_id", F.col("seg_idx").cast("int").alias("seg_idx"), "start", "end", "offset0", "protein_offset")


def _placed_indels(g: Genome) -> DataFrame:
    return indels.place_indels(_events(g), g.genes())


@query
def q27_indel_coding_delta(g):
    rows = _placed_indels(g)
    return rows.select("gene_id", "contig", "pos", "ref", "alt", indels.coding_delta(F.col("components"), F.col("g_start"), F.col("g_end")).alias("delta"))


def _codon_states(g: Genome) -> DataFrame:
    keys = codons.place_snvs(g.snvs(), g.genes()).where("codon_start is not null").select("gene_id", "strand", "codon_start").distinct()
    return indels.frame_states(keys, _placed_indels(g))


@query
def q28_frameshift_propagation(g):
    return _codon_states(g).select("gene_id", "codon_start", "shift", "frameshift")


@query
def q29_indel_overlap_flag(g):
    rows = _codon_rows(g).select("gene_id", "codon_start", "snvs", "change_type")
    both = rows.join(_codon_states(g).select("gene_id", "codon_start", "shift", "overlap"), ["gene_id", "codon_start"])
    return both.select("gene_id", "codon_start", "snvs", "overlap", indels.relabel(F.col("change_type"), F.col("shift"), F.col("overlap"), F.lit(False)).alias("change_type"))


def _effects(g: Genome) -> DataFrame:
    seqs = reference.intervals_sequence(g.genes(), g.reference(), ["gene_id"], "start", "end")
    return indels.protein_effects(_placed_indels(g), seqs)


@query
def q30_indel_protein_effect(g):
    return _effects(g).select("gene_id", "contig", "pos", "ref", "alt", "delta", "frameshift", "change_type", "protein_change")


@query
def q31_frameshift_ptc(g):
    rows = _effects(g).where("frameshift")
    ptc = indels.premature_stop(F.col("ref_stop"), F.col("alt_stop"), F.col("delta"), F.length("ref_cds"))
    return rows.select("gene_id", "pos", "ref", "alt", F.col("ref_stop").cast("int").alias("ref_stop"), F.col("alt_stop").cast("int").alias("alt_stop"), ptc.cast("long").alias("ptc"))


@query
def q32_nmd(g):
    """Stops gained in spliced transcripts, judged by the last real junction."""
    stops = _transcript_rows(g).where("change_type = 'Stop gained'").join(transcripts.last_junctions(g.segments()), "gene_id")
    return stops.select("gene_id", F.col("codon_start").alias("codon"), "alt_codon", "last_junction", indels.nmd(F.col("codon_start") * 3, F.col("last_junction")).alias("nmd"))


@query
def q33_fallback_class(g):
    pos = g.snvs().select("contig", "pos").distinct()
    return fallback.classify(pos, g.genes(), g.segments()).select("contig", "pos", "gene_id", "term")


def _observed(g: Genome, min_mapq: int = 0) -> DataFrame:
    """What the aligned reads show at the SNV sites."""
    return reads.observe_sites(reads.usable(g.reads(), min_mapq), g.one_alt().select("contig", "pos"))


@query
def q34_read_observations(g):
    return _observed(g, 10).select("contig", "pos", "read_id", "is_reverse", "base", "quality")


@query
def q35_molecule_merge(g):
    return reads.merge_molecules(_observed(g)).select("contig", "pos", "molecule", "base", "quality", "fwd", "rev")


@query
def q36_snp_support(g):
    return reads.snp_support(reads.merge_molecules(_observed(g)), g.one_alt(), MIN_QUALITY)


KEYS = ["gene_id", "codon_start"]


def _members(g: Genome) -> DataFrame:
    """Sites of codons with at least two of them."""
    placed = codons.place_snvs(g.one_alt(), g.genes()).where("codon_start is not null")
    by = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    idx = F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")) - 1
    return placed.withColumn("n", by).withColumn("idx", idx).where("n > 1").select(*KEYS, "contig", "pos", "alt", "idx", "n")


def _patterns(g: Genome) -> DataFrame:
    return reads.molecule_patterns(reads.merge_molecules(_observed(g)), _members(g), KEYS, MIN_QUALITY)


@query
def q37_mnv_support(g):
    return reads.mnv_support(_patterns(g), KEYS).select(*KEYS, "mnv_reads", "mnv_forward", "mnv_reverse", "mnv_depth")


@query
def q38_haplotype_patterns(g):
    return reads.pattern_counts(_patterns(g), KEYS).select(*KEYS, "pattern", "molecules")


@query
def q39_phasing_support(g):
    rows = reads.phasing_support(_patterns(g), _members(g), KEYS)
    return rows.select(*KEYS, "mnv_reads", "informative", F.round("phasing_support", 6).alias("phasing_support"))


@query
def q40_codon_ld(g):
    rows = reads.codon_linkage(reads.pattern_counts(_patterns(g), KEYS), KEYS)
    return rows.select(*KEYS, F.round("d_prime", 6).alias("d_prime"), F.round("r_squared", 6).alias("r_squared"), "molecules")


@query
def q41_strand_bias_fisher(g):
    s = reads.snp_support(reads.merge_molecules(_observed(g)), g.one_alt(), MIN_QUALITY).where("depth > 0")
    ref_f, ref_r = F.col("depth_forward") - F.col("snp_forward"), F.col("depth_reverse") - F.col("snp_reverse")
    p = stats.fisher_exact(F.col("snp_forward"), F.col("snp_reverse"), ref_f, ref_r)
    return s.select("contig", "pos", "alt", F.round(p, 6).alias("p"))


ALLELE = ["contig", "pos", "ref", "alt"]


def _read_indels(g: Genome) -> DataFrame:
    return alleles.with_event(g.read_indels())


def _indel_views(g: Genome) -> DataFrame:
    return reads.observe_alleles(reads.usable(g.reads()), _read_indels(g).select(*ALLELE, "components"))


@query
def q42_indel_support(g):
    """Molecules whose CIGAR and bases show exactly the indel, and depth by the anchor base."""
    rows = reads.indel_support(_indel_views(g), ALLELE, MIN_QUALITY)
    return rows.select(*ALLELE, "event_reads", "event_forward", "event_reverse", "event_depth", F.round("event_freq", 6).alias("event_freq"))


LINK_BASES, GATE = 600, 0.2


def q43_rows(g: Genome, views: DataFrame | None = None) -> DataFrame:
    """Indel and SNV of a gene within 600 bases: on molecules that carry the SNV, is the indel there?"""
    key = lambda what: F.concat_ws(":", "contig", F.col("pos").cast("string"), "ref", "alt").alias(what)
    near = indels.place_indels(_read_indels(g), g.genes()).select("contig", F.col("gene_id").alias("g2"), key("indel_id"), F.greatest(F.col("pos") - LINK_BASES, F.lit(1)).alias("lo"), (F.col("pos") + LINK_BASES).alias("hi"))
    snv = codons.place_snvs(g.one_alt(), g.genes()).select("contig", "gene_id", "pos", key("snv_id")).withColumn("p2", F.col("pos"))
    pairs = interval_join(snv, near, "contig", "pos", "p2", "lo", "hi").where("gene_id = g2").select("gene_id", "indel_id", "snv_id")
    shown = reads.indel_molecules(_indel_views(g) if views is None else views, ALLELE, MIN_QUALITY).select(key("indel_id"), "molecule", "supports")
    carriers = reads.snv_carriers(_observed(g), g.one_alt(), MIN_QUALITY).join(g.one_alt(), ["contig", "pos", "alt"]).select(key("snv_id"), "molecule")
    return reads.indel_snv_linkage(shown, carriers, pairs, ["gene_id", "indel_id", "snv_id"])


@query
def q43_indel_snv_linkage(g):
    return q43_rows(g)


def _window_members(g: Genome, events: DataFrame) -> DataFrame:
    genes = codons.with_bounds(g.genes()).select("gene_id", "eff_start", "eff_end")
    snv = codons.place_snvs(g.one_alt(), g.genes()).select("gene_id", *ALLELE, F.col("pos").alias("a"), F.col("pos").alias("b"), F.lit(False).alias("is_indel"), F.concat_ws(":", F.col("pos").cast("string"), "ref", "alt").alias("variant_id"))
    ind = indels.place_indels(events, g.genes()).select("gene_id", *ALLELE, F.col("affected_start").alias("a"), F.col("affected_end").alias("b"), F.lit(True).alias("is_indel"), F.concat_ws(":", F.col("pos").cast("string"), "ref", "alt").alias("variant_id"))
    rows = snv.unionByName(ind).join(genes, "gene_id")
    lo, hi = phase.variant_window(F.col("a"), F.col("b"), F.col("pos"), F.col("eff_start"), F.col("eff_end"))
    return rows.withColumn("w_start", lo).withColumn("w_end", hi)


@query
def q44_haplotype_windows(g):
    rows = phase.haplotype_windows(_window_members(g, _events(g)))
    return rows.select("gene_id", "window_start", "window_end", "members", "variant_id")


def _windows(g: Genome) -> DataFrame:
    """Members of the windows of SNVs and read indels, numbered within each: gene_id, island, contig, pos, ref, alt, is_indel, idx, n."""
    rows = phase.haplotype_windows(_window_members(g, _read_indels(g)))
    idx = F.row_number().over(Window.partitionBy("gene_id", "island").orderBy("pos", "is_indel", "ref", "alt")) - 1
    return rows.select("gene_id", "island", *ALLELE, "is_indel", F.col("members").alias("n"), idx.alias("idx"), "window_start", "window_end")


def _haplotypes(g: Genome, members: DataFrame | None = None) -> DataFrame:
    members = materialize(_windows(g), "windows") if members is None else members
    events = alleles.with_event(members.select(*ALLELE).distinct())
    views = reads.observe_alleles(reads.usable(g.reads()), events.select(*ALLELE, "components"))
    return reads.local_haplotypes(views, members, ["gene_id", "island"], MIN_QUALITY)


@query
def q45_local_haplotypes_topk(g):
    """Combinations of all members of a window, indels included, as molecules carry them: the 64 most frequent of each window."""
    rows = reads.top_haplotypes(_haplotypes(g), ["gene_id", "island"], 64)
    return rows.select("gene_id", "island", "pattern", "molecules", "forward", "reverse", "place")


@query
def q46_support_filters(g):
    s = reads.snp_support(reads.merge_molecules(_observed(g)), g.one_alt(), MIN_QUALITY)
    ok = filters.support_ok(F.col("snp_reads"), F.col("depth"), F.col("snp_forward"), F.col("snp_reverse"), 1, 0.3, 0)
    return s.where(filters.keep_row(F.lit("SNP"), ok, F.lit(False))).select("contig", "pos", "alt", "snp_reads", "depth", F.round(filters.ratio(F.col("snp_reads"), F.col("depth")), 6).alias("freq"))


@query
def q47_vcf_filter_tags(g):
    s = reads.snp_support(reads.merge_molecules(_observed(g)), g.one_alt(), MIN_QUALITY)
    tag = filters.vcf_filter(F.col("snp_reads"), F.col("depth"), F.col("snp_forward"), F.col("snp_reverse"), F.lit(None).cast("double"), 2, 0.3, 1, 0.0)
    return s.select("contig", "pos", "alt", tag.alias("filter"))


@query
def q48_declared_phase(g):
    """Genotypes by rule; codons whose sites share a phase set are cis or trans."""
    gt = F.when(F.col("pos") % 4 == 0, "0/1").when(F.col("pos") % 4 == 1, "0|1").when(F.col("pos") % 4 == 2, "1|0").otherwise("1|1")
    m = _members(g).withColumn("p", phase.parse_phase(gt, F.lit("7"), F.lit(1)))
    rows = m.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "p"))), lambda x: x["p"]).alias("phases"))
    return rows.select(*KEYS, phase.declared_phase(F.col("phases")).alias("declared"))


@query
def q49_vcf_records(g):
    """Records of each codon row: one per base, and a spanning one where there are several."""
    from strandmill.sinks.vcf import expand_records

    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference())
    return expand_records(rows, g.reference()).select("gene_id", "contig", "pos", "ref", "alt", "type")


@query
def q50_info_string(g):
    from strandmill.sinks.vcf import info_text

    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference())
    rows = rows.withColumn("snv_text", _join(F.col("snvs"), lambda s: F.concat(s["pos"].cast("string"), s["ref"], F.lit(">"), s["alt"])))
    return rows.select("gene_id", "codon_start", F.col("snv_text").alias("snvs"), info_text({"GENE": F.col("gene_id").cast("string"), "AA": F.col("aa_change"), "CT": F.col("change_type"), "TYPE": F.col("variant_type"), "SO": F.col("so_term"), "IMPACT": F.col("impact"), "GD": F.col("grantham").cast("string"), "DBS": F.col("dbs_class"), "HGVSC": F.col("hgvs_c")}).alias("info"))


@query
def q51_cohort_carriage(g):
    """Three samples by rule in one pass: alleles that a sample's genotype lacks are not its own."""
    v = g.snvs().select("contig", "pos", "ref", "alt", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    k = (F.col("pos") + F.col("s")) % 4
    gt = F.when(k == 0, "0/0").when(k == 1, "0/1").when(k == 2, "./.").otherwise("1|1")
    return v.where(filters.carried(gt, F.lit(1))).groupBy(F.concat(F.lit("sample"), F.col("s").cast("string")).alias("sample"), "contig").agg(F.count(F.lit(1)).alias("n"))


@query
def q52_contig_and_global_summary(g):
    coded = _codon_rows(g).select("contig", "variant_type", F.col("gene_id").cast("string").alias("gene"))
    v = g.snvs().withColumn("p2", F.col("pos"))
    genes = g.genes().withColumnsRenamed({"start": "gs", "end": "ge"})
    outside = interval_join(v, genes, "contig", "pos", "p2", "gs", "ge", how="left_anti").select("contig", F.lit("SNP").alias("variant_type"), F.lit(None).cast("string").alias("gene"))
    return filters.contig_summary(coded.unionByName(outside))


@query
def q53_pileup_view(g):
    """Depth and bases of each site."""
    o = _observed(g).join(g.one_alt().select("contig", "pos", "alt"), ["contig", "pos"])
    return o.groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("depth"), F.count(F.when(F.col("base") == F.col("alt"), 1)).alias("alt_reads"), F.count(F.when(F.col("is_reverse"), 1)).alias("reverse_reads"), F.min("quality").alias("min_quality"))


@query
def q54_report_rows(g):
    from strandmill.sinks.report import dictionary

    return dictionary(_codon_rows(g).select("gene_id", "codon_start", "snvs", "change_type", "so_term"), ["change_type", "so_term"])


@query
def q76_gated_frame_states(g):
    """Frame states by what reads show: the gate takes the observed frequency of an indel, and indels in trans with a codon's SNVs don't shift it."""
    events, views = _read_indels(g), materialize(_indel_views(g), "views")
    freq = reads.indel_support(views, ALLELE, MIN_QUALITY).select(*ALLELE, F.col("event_freq").alias("observed"))
    placed = indels.place_indels(events, g.genes()).withColumn("af", F.lit(None).cast("double")).join(freq, ALLELE, "left")
    placed = materialize(placed, "placed")
    snv = codons.place_snvs(g.one_alt(), g.genes()).where("codon_start is not null").select("gene_id", "strand", "codon_start", F.concat_ws(":", *ALLELE).alias("snv_id"))
    states = indels.frame_states(snv.select("gene_id", "strand", "codon_start").distinct(), placed, GATE)
    linked = q43_rows(g, views).where("verdict = 'trans'").select("gene_id", "indel_id", "snv_id")
    own = placed.where(indels.passes_gate(F.col("observed"), F.col("af"), GATE)).select("gene_id", F.concat_ws(":", *ALLELE).alias("indel_id"), indels.upstream_key(F.col("components"), F.col("strand")).alias("k"), indels.coding_delta(F.col("components"), F.col("g_start"), F.col("g_end")).alias("delta"))
    trans = linked.join(own, ["gene_id", "indel_id"]).join(snv, ["gene_id", "snv_id"]).where(F.col("k") < indels.codon_key(F.col("strand"), F.col("codon_start"))).select("gene_id", "codon_start", "indel_id", "delta").distinct()
    return indels.suppress_trans(states, trans).select("gene_id", "codon_start", "shift", "frameshift", "overlap")


@query
def q94_frameshift_rows(g):
    """Codon rows as upstream indels leave them: shifted frames, what lies behind a premature stop, overlaps."""
    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference())
    keys = rows.select("gene_id", "strand", "codon_start").distinct()
    out = indels.relabel_rows(rows, indels.frame_states(keys, _placed_indels(g)), indels.premature_stops(_effects(g)))
    return out.select("gene_id", "codon_start", _join(F.col("snvs"), lambda s: F.concat(s["pos"].cast("string"), s["ref"], F.lit(">"), s["alt"])).alias("snvs"), "aa_change", "change_type")


@query
def q95_spliced_indel_effect(g):
    """Indels of spliced transcripts: coding delta, change type and protein change of the joined sequence."""
    rows = indels.spliced_effects(_events(g), g.segments(), g.reference())
    return rows.select("gene_id", "contig", "pos", "ref", "alt", "delta", "change_type", "protein_change")
