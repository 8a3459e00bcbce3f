"""Columns over nucleotide strings: complement, translation, slices of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: NCBI genetic codes by table number, residues of the 64 codons in TCAG order.
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    25: "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
#: IUPAC codes and their complements.
IUPAC, COMPLEMENT = "ACGTURYKMSWBVDHNacgturykmswbvdhn", "TGCAAYRMKSWVBHDNtgcaayrmkswvbhdn"


def count_to(n: Column) -> Column:
    """Array 1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def oriented(base: Column, strand: Column) -> Column:
    """A base or sequence as the coding strand reads it."""
    return F.when(strand == "-", reverse_complement(base)).otherwise(base)


def let(value: Column, body) -> Column:
    """body of value, evaluated once: the plan names it once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are computed once a row: filters and columns on top of them refer to their values, where withColumn would put their expressions in at each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: The 64 codons in TCAG order, a comma before each.
CODONS = "".join(f",{x}{y}{z}" for x in "TCAG" for y in "TCAG" for z in "TCAG")


def _residue(codon: Column, table: int) -> Column:
    """Residue of an upper-case codon in T, C, A and G: what a text as long as CODONS holds in its place, X anywhere else."""
    residues = "X" + "XXX".join(GENETIC_CODES[table]) + "XX"
    return F.when(F.length(codon) == 3, F.substr(F.lit(residues), F.instr(F.lit(CODONS), codon), F.lit(1))).otherwise("X")


def _dna(seq: Column) -> Column:
    """Upper-case T, C, A and G; all other letters mean no residue, whatever their case."""
    return F.translate(seq, "tcaguU", "TCAGTT")


def codon_residue(codon: Column, table: int = 11) -> Column:
    """One-letter residue of a codon, X where it is ambiguous or not three bases."""
    return _residue(_dna(codon), table)


def translate(cds: Column, table: int = 11) -> Column:
    """Protein of every whole codon of a coding sequence."""
    n = F.floor(F.length(cds) / 3)
    return let(_dna(cds), lambda s: F.array_join(F.transform(count_to(n), lambda i: _residue(F.substr(s, (i - 1) * 3 + 1, F.lit(3)), table)), ""))
