"""Columns over residues: three-letter names, Grantham distance, doublet classes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.dna import reverse_complement

#: Three-letter names; composition, polarity and volume of Grantham (1974) with his weights.
THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val"}
GRANTHAM = {
    "S": (1.42, 9.2, 32.0), "R": (0.65, 10.5, 124.0), "L": (0.0, 4.9, 111.0), "P": (0.39, 8.0, 32.5), "T": (0.71, 8.6, 61.0),
    "A": (0.0, 8.1, 31.0), "V": (0.0, 5.9, 84.0), "G": (0.74, 9.0, 3.0), "I": (0.0, 5.2, 111.0), "F": (0.0, 5.2, 132.0),
    "Y": (0.2, 6.2, 136.0), "C": (2.75, 5.5, 55.0), "H": (0.58, 10.4, 96.0), "Q": (0.89, 10.5, 85.0), "N": (1.33, 11.6, 56.0),
    "K": (0.33, 11.3, 119.0), "D": (1.38, 13.0, 54.0), "E": (0.92, 12.3, 83.0), "M": (0.0, 5.7, 105.0), "W": (0.13, 5.4, 170.0),
}
GRANTHAM_WEIGHTS = (1.833, 0.1018, 0.000399, 50.723)
#: Doublets that the DBS catalogue keeps as they are.
CANONICAL_DOUBLETS = ("AC", "AT", "CC", "CG", "CT", "GC", "TA", "TC", "TG", "TT")


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*pairs.items())))


def three_letter(residue: Column) -> Column:
    """Ala for A; stops and unknown residues as they are."""
    return F.coalesce(F.element_at(_map(THREE), residue), residue)


def aa_change(ref: Column, position: Column, alt: Column) -> Column:
    return F.concat(three_letter(ref), position.cast("string"), three_letter(alt))


def grantham(a: Column, b: Column) -> Column:
    """Rounded distance, null unless both are standard residues."""
    alpha, beta, gamma, rho = GRANTHAM_WEIGHTS
    prop = [_map({k: v[i] for k, v in GRANTHAM.items()}) for i in range(3)]
    d = [F.element_at(p, a) - F.element_at(p, b) for p in prop]
    return F.round(F.lit(rho) * F.sqrt(F.lit(alpha) * d[0] * d[0] + F.lit(beta) * d[1] * d[1] + F.lit(gamma) * d[2] * d[2])).cast("int")


def grantham_category(distance: Column) -> Column:
    return F.when(distance <= 50, "conservative").when(distance <= 100, "moderately conservative").when(distance <= 150, "moderately radical").when(distance.isNotNull(), "radical")


def dbs_class(ref: Column, alt: Column) -> Column:
    """Doublet-substitution class of two doublets of the reference strand; null if a base is unchanged or ambiguous."""
    ref, alt = F.upper(ref), F.upper(alt)
    rref, ralt = reverse_complement(ref), reverse_complement(alt)
    clean = ref.rlike("^[ACGT]{2}$") & alt.rlike("^[ACGT]{2}$")
    both = (F.substring(ref, 1, 1) != F.substring(alt, 1, 1)) & (F.substring(ref, 2, 1) != F.substring(alt, 2, 1))
    keep = ref.isin(*CANONICAL_DOUBLETS)
    kept = F.concat(ref, F.lit(">"), F.when(rref == ref, F.least(alt, ralt)).otherwise(alt))
    return F.when(clean & both, F.when(keep, kept).otherwise(F.concat(rref, F.lit(">"), ralt)))
