"""Declared phase of genotypes, and windows of local haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.alleles import event_of
from strandmill.functions.dna import count_to
from strandmill.operators.indels import apply_to_feature
from strandmill.operators.intervals import islands
from strandmill.operators.reference import intervals_sequence

SLACK = 3


def parse_phase(genotype: Column, phase_set: Column, alt_index: Column) -> Column:
    """Struct (phase_set, slots holding the allele, unknown) of a genotype phased with |; null otherwise. alt_index counts from 1."""
    slots = F.split(genotype, r"\|")
    held = F.filter(count_to(F.size(slots)), lambda i: F.element_at(slots, i) == alt_index.cast("string"))
    value = F.struct(F.when(phase_set.rlike(r"^\d+$"), phase_set.cast("long")).alias("phase_set"), held.alias("slots"), F.exists(slots, lambda s: s == ".").alias("unknown"))
    return F.when(genotype.contains("|") & ~genotype.contains("/") & (F.size(held) > 0), value)


def share_haplotype(a: Column, b: Column) -> Column:
    """Two declared phases share a slot; null where a slot is unknown and none is shared."""
    both = F.size(F.array_intersect(a["slots"], b["slots"])) > 0
    return F.when(both, F.lit(True)).when(a["unknown"] | b["unknown"], F.lit(None).cast("boolean")).otherwise(F.lit(False))


def declared_phase(phases: Column) -> Column:
    """cis:PS or trans:PS of a row's phases (an array with a struct, or null, per site); null where it can't be told."""
    first = phases[0]["phase_set"]
    usable = (F.size(phases) > 1) & F.forall(phases, lambda p: p.isNotNull() & p["phase_set"].isNotNull() & (p["phase_set"] == first))
    n = F.size(phases)
    flat = F.flatten(F.transform(count_to(n), lambda i: F.transform(F.filter(count_to(n), lambda j: j > i), lambda j: share_haplotype(F.element_at(phases, i), F.element_at(phases, j)))))
    known = F.forall(flat, lambda x: x.isNotNull())
    verdict = F.when(F.forall(flat, lambda x: x), "cis").otherwise("trans")
    return F.when(usable & known, F.concat(verdict, F.lit(":"), first.cast("string")))


def reads_contradict(verdict: Column, haplotype_reads: Column, informative: Column) -> Column:
    return F.when(informative == 0, F.lit(False)).when(verdict == "cis", haplotype_reads == 0).when(verdict == "trans", haplotype_reads == informative).otherwise(F.lit(False))


def haplotype_windows(variants: DataFrame) -> DataFrame:
    """variants (gene_id, eff_start, eff_end, w_start, w_end, is_indel, variant_id) in windows of linked members: island, where at
    least two members, one of them an indel, chain within SLACK bases."""
    linked = islands(variants, ["gene_id"], "w_start", "w_end", SLACK, ["variant_id"])
    size = linked.groupBy("gene_id", "island").agg(F.count(F.lit(1)).alias("members"), F.max("is_indel").alias("any_indel"), F.min("w_start").alias("window_start"), F.max("w_end").alias("window_end"))
    return linked.join(size.where("members >= 2 and any_indel"), ["gene_id", "island"])


def variant_window(start: Column, end: Column, pos: Column, eff_start: Column, eff_end: Column) -> tuple[Column, Column]:
    """Window of a variant in a gene: whole codons of its ends that lie in the gene, else two bases either way, clipped to the gene."""
    low = lambda p: eff_start + F.floor((p - eff_start) / 3) * 3
    inside = lambda p: p.between(eff_start, eff_end) & (low(p) + 2 <= eff_end)
    ends = [pos, start, end]
    lows = [F.when(inside(p), low(p)) for p in ends]
    highs = [F.when(inside(p), low(p) + 2) for p in ends]
    none = ~(inside(pos) | inside(start) | inside(end))
    own_lo, own_hi = F.greatest(start, eff_start), F.least(end, eff_end)
    lo = F.least(own_lo, *lows, F.when(none, F.greatest(start - 2, eff_start)))
    hi = F.greatest(own_hi, *highs, F.when(none, F.least(end + 2, eff_end)))
    return lo.cast("long"), hi.cast("long")


def compound_alleles(groups: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """groups with pos, ref, alt, components and event_class of the allele that a molecule with all of a group's components has.

    groups: keys, contig, members (number), components (array), lo, hi (span of
    the members). Groups without an indel, with conflicting components, or whose
    allele is the reference's have no row.
    """
    order = F.when(F.col("_c.kind") == "SNV", 0).when(F.col("_c.kind") == "DEL", 1).otherwise(2)
    # one base more is read, so that an insertion behind the last base finds its place
    seqs = intervals_sequence(groups.withColumn("_hi", F.col("hi") + 1), reference, keys, "lo", "_hi")
    sorted_ = groups.select(*keys, F.explode("components").alias("_c")).distinct().groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c.pos", order.alias("o"), "_c.ref", "_c.alt", "_c.kind"))), lambda c: F.struct(c["kind"].alias("kind"), c["pos"].alias("pos"), c["ref"].alias("ref"), c["alt"].alias("alt"))).alias("components"))
    df = groups.drop("components").join(sorted_, keys).join(seqs, keys)
    df = df.withColumn("_alt", apply_to_feature(F.col("seq"), F.col("lo"), F.col("components"))).withColumn("ref", F.substr("seq", F.lit(1), F.length("seq") - 1)).withColumn("alt", F.substr("_alt", F.lit(1), F.length("_alt") - 1))
    indels = F.size(F.filter("components", lambda c: c["kind"] != "SNV"))
    subs = F.exists("components", lambda c: c["kind"] == "SNV")
    df = df.withColumn("pos", F.col("lo")).where((indels > 0) & F.col("alt").isNotNull() & (F.upper("ref") != F.upper("alt")))
    own = event_of(F.col("pos"), F.col("ref"), F.col("alt"))["event_class"]
    cls = F.when((F.col("members") > 1) & (subs | (indels > 1) | ~own.isin("insertion", "deletion", "delins", "complex_indel")), "complex_indel").otherwise(own)
    return df.withColumn("event_class", cls).drop("seq", "_alt", "lo", "hi")


def carried_groups(haplotypes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Per combination (keys, pattern) of at least two carried members, one of them an indel: contig, members, components, lo, hi. members: keys, contig, pos, ref, idx, components, affected_start, affected_end."""
    rows = haplotypes.join(members, keys).where(F.substr("pattern", (F.col("idx") + 1).cast("int"), F.lit(1)) == "1")
    out = rows.groupBy(*keys, "pattern", "contig").agg(
        F.count(F.lit(1)).alias("members"),
        F.flatten(F.collect_list("components")).alias("components"),
        F.min(F.least("affected_start", "pos")).alias("lo"),
        F.max(F.greatest("affected_end", F.col("pos") + F.length("ref") - 1)).alias("hi"),
    )
    return out.where((F.col("members") > 1) & F.exists("components", lambda c: c["kind"] != "SNV"))


def restricted_patterns(haplotypes: DataFrame, keys: list[str]) -> DataFrame:
    """Per combination (keys, pattern): the window's molecules by what they carry of its own members: sub (0/1), n, molecules."""
    own = haplotypes.select(*keys, "pattern")
    every = haplotypes.select(*keys, F.col("pattern").alias("_p"), "molecules")
    at = F.filter(count_to(F.length("pattern")), lambda i: F.substr("pattern", i, F.lit(1)) == "1")
    sub = F.array_join(F.transform(at, lambda i: F.substr("_p", i, F.lit(1))), "")
    return own.join(every, keys).groupBy(*keys, "pattern", F.size(at).alias("n"), sub.alias("sub")).agg(F.sum("molecules").alias("molecules"))
