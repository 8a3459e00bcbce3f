"""Columns for consequences: change types, shifts, Sequence Ontology terms, HGVS descriptors, splice classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.alleles import common_prefix, common_suffix

#: SO term and impact of each change type.
SO_TERMS = {
    "Synonymous": ("synonymous_variant", "LOW"),
    "Non-synonymous": ("missense_variant", "MODERATE"),
    "Start lost": ("start_lost", "HIGH"),
    "Stop gained": ("stop_gained", "HIGH"),
    "Stop gained (frameshift)": ("stop_gained", "HIGH"),
    "Stop lost": ("stop_lost", "HIGH"),
    "Stop lost (frameshift)": ("stop_lost", "HIGH"),
    "Frameshift Indel": ("frameshift_variant", "HIGH"),
    "Synonymous (frameshift)": ("frameshift_variant", "HIGH"),
    "Non-synonymous (frameshift)": ("frameshift_variant", "HIGH"),
    "Unknown (frameshift)": ("frameshift_variant", "HIGH"),
    "Downstream of premature stop": ("coding_sequence_variant", "MODIFIER"),
    "Indel overlap": ("coding_sequence_variant", "MODIFIER"),
    "Unknown": ("coding_sequence_variant", "MODIFIER"),
}
SPLICE_IMPACT = {"splice_donor_variant": "HIGH", "splice_acceptor_variant": "HIGH", "splice_region_variant": "LOW"}
FRAMESHIFTED = {"Synonymous": "Synonymous (frameshift)", "Non-synonymous": "Non-synonymous (frameshift)", "Stop gained": "Stop gained (frameshift)", "Stop lost": "Stop lost (frameshift)", "Unknown": "Unknown (frameshift)", "Start lost": "Start lost"}


def change_type(ref: Column, alt: Column, position: Column) -> Column:
    """Consequence of one residue's substitution at a 1-based protein position."""
    return (
        F.when((ref == "X") | (alt == "X"), "Unknown")
        .when((position == 1) & (ref == "M") & ~alt.isin("M", "*"), "Start lost")
        .when(ref == alt, "Synonymous")
        .when(alt == "*", "Stop gained")
        .when(ref == "*", "Stop lost")
        .otherwise("Non-synonymous")
    )


def change_type_of_text(text: Column) -> Column:
    """change_type of a one-letter description such as M1T."""
    return change_type(F.substring(text, 1, 1), F.substr(text, F.length(text), F.lit(1)), F.regexp_extract(text, r"(\d+)", 1).cast("long"))


#: All change types.
CHANGE_TYPES = ("Unknown", "Synonymous", "Non-synonymous", "Start lost", "Stop gained", "Stop lost", "Indel overlap", "Synonymous (frameshift)", "Non-synonymous (frameshift)", "Stop gained (frameshift)", "Stop lost (frameshift)", "Downstream of premature stop", "Unknown (frameshift)", "Frameshift Indel", "In-frame Indel")


def parse_change_type(text: Column) -> Column:
    """The change type that a label names, null for any other text."""
    return F.when(text.isin(*CHANGE_TYPES), text)


def indel_change_type(ref_protein: Column, alt_protein: Column, frameshift: Column) -> Column:
    stops = lambda p: F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit("")))
    alt1 = F.when(F.length(alt_protein) > 0, F.substring(alt_protein, 1, 1)).otherwise("-")
    return (
        F.when(frameshift, "Frameshift Indel")
        .when((F.substring(ref_protein, 1, 1) == "M") & ~alt1.isin("M", "*"), "Start lost")
        .when(stops(alt_protein) > stops(ref_protein), "Stop gained")
        .when(stops(alt_protein) < stops(ref_protein), "Stop lost")
        .otherwise("In-frame Indel")
    )


def severity(ref: Column, alt: Column) -> Column:
    return F.when((ref == "X") | (alt == "X"), 0).when(ref == alt, 1).when((ref == "*") | (alt == "*"), 3).otherwise(2)


def consequence_shift(ref: Column, combined: Column, singles: Column) -> Column:
    """How the combined change compares with the most severe of its single ones."""
    most = F.array_max(F.transform(singles, lambda s: severity(ref, s)))
    own = severity(ref, combined)
    return F.when((F.size(singles) <= 1) | (ref == "X"), "-").when(own > most, "MNV-gained").when(own < most, "MNV-masked").otherwise("Concordant")


def so_term(change: Column, intergenic: Column, non_coding: Column, ref_len: Column, alt_len: Column) -> Column:
    """Base SO term."""
    out = F.when(intergenic, "intergenic_variant").when(non_coding.isNotNull(), non_coding)
    out = out.when(change == "In-frame Indel", F.when(alt_len > ref_len, "inframe_insertion").otherwise("inframe_deletion"))
    for k, (term, _) in SO_TERMS.items():
        out = out.when(change == k, term)
    return out.otherwise("coding_sequence_variant")


def so_impact(change: Column, intergenic: Column, non_coding: Column) -> Column:
    out = F.when(intergenic | non_coding.isNotNull(), "MODIFIER").when(change == "In-frame Indel", "MODERATE")
    for k, (_, impact) in SO_TERMS.items():
        out = out.when(change == k, impact)
    return out.otherwise("MODIFIER")


def with_splice(term: Column, impact: Column, splice: Column, coding: Column) -> tuple[Column, Column]:
    """Term and impact with a splice term folded in: beside a protein consequence, instead of anything else."""
    own = F.when(splice == "splice_region_variant", "LOW").otherwise("HIGH")
    rank = lambda c: F.when(c == "HIGH", 3).when(c == "MODERATE", 2).when(c == "LOW", 1).otherwise(0)
    beside = coding & (term != "coding_sequence_variant")
    t = F.when(splice.isNull(), term).when(beside, F.concat(term, F.lit("&"), splice)).otherwise(splice)
    i = F.when(splice.isNull(), impact).when(beside, F.when(rank(impact) >= rank(own), impact).otherwise(own)).otherwise(own)
    return t, i


def hgvs_substitution(items: Column, prefix: str) -> Column:
    """prefix + POSREF>ALT, bracketed and sorted by position where there are several; those of one position stay in order. items: array of (pos, ref, alt)."""
    placed = F.transform(items, lambda x, i: F.struct(x["pos"].alias("pos"), i.alias("i"), x["ref"].alias("ref"), x["alt"].alias("alt")))
    text = F.transform(F.array_sort(placed), lambda x: F.concat(x["pos"].cast("string"), x["ref"], F.lit(">"), x["alt"]))
    return F.when(F.size(items) == 0, F.lit(None).cast("string")).when(F.size(items) == 1, F.concat(F.lit(prefix), text[0])).otherwise(F.concat(F.lit(prefix + "["), F.array_join(text, ";"), F.lit("]")))


def hgvs_indel(pos: Column, ref: Column, alt: Column) -> Column:
    """g. descriptor of an anchored indel from its trimmed core."""
    pre = common_prefix(ref, alt)
    suf = common_suffix(ref, alt, pre)
    rc, ac = F.substr(ref, pre + 1, F.length(ref) - pre - suf), F.substr(alt, pre + 1, F.length(alt) - pre - suf)
    start = pos + pre
    span = F.when(F.length(rc) == 1, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("_"), (start + F.length(rc) - 1).cast("string")))
    return F.when(F.length(rc) == 0, F.concat(F.lit("g."), (start - 1).cast("string"), F.lit("_"), start.cast("string"), F.lit("ins"), ac)).when(F.length(ac) == 0, F.concat(F.lit("g."), span, F.lit("del"))).otherwise(F.concat(F.lit("g."), span, F.lit("delins"), ac))


def hgvs_component(kind: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """g. descriptor of one component of an allele; null for symbolic ones."""
    at, behind = pos.cast("string"), (pos + 1).cast("string")
    span = F.when(F.length(ref) == 1, at).otherwise(F.concat(at, F.lit("_"), (pos + F.length(ref) - 1).cast("string")))
    text = F.when(kind == "SNV", F.concat(at, ref, F.lit(">"), alt)).when(kind == "INS", F.concat(at, F.lit("_"), behind, F.lit("ins"), alt)).when(kind == "DEL", F.concat(span, F.lit("del"))).when(kind == "DELINS", F.concat(span, F.lit("delins"), alt))
    return F.concat(F.lit("g."), text)


def splice_class(distance: Column, kind: str) -> Column:
    """Class of a base by its distance into the intron from the exon's last base (1 is the first intronic base)."""
    essential = "splice_donor_variant" if kind == "donor" else "splice_acceptor_variant"
    return F.when(distance.between(1, 2), essential).when(distance.between(-2, 0) | distance.between(3, 8), "splice_region_variant")
