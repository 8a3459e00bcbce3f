"""The whole plan on small transcripts: introns, abutting segments, frames, decay, evidence and the wide table, against plain Python."""

import random

import pytest
from strandmill.functions import alleles
from strandmill.operators import evidence, frames
from strandmill.plans.annotate import annotate
from strandmill.sinks import tables

CODE = dict(zip([a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"], "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"))
rng = random.Random(5)
SENSE = [c for c, a in CODE.items() if a != "*"]


def coding(n):
    return "ATG" + "".join(rng.choice(SENSE) for _ in range(n - 2)) + "TAA"


def protein(cds):
    return "".join(CODE[cds[i : i + 3]] for i in range(0, len(cds) // 3 * 3, 3))


# three genes of 120 codons: one with an intron of 40 bases behind base 180, one of two abutting segments, one plain
CDS = [coding(120) for _ in range(3)]
INTRON = "GT" + "".join(rng.choice("ACGT") for _ in range(36)) + "AG"
GENOME, STARTS = "", []
for k, c in enumerate(CDS):
    GENOME += "ACGTACGTAC"
    STARTS.append(len(GENOME) + 1)
    GENOME += c[:180] + INTRON + c[180:] if k == 0 else c
GENOME += "ACGTACGTAC"


def place(k, offset):
    """Genomic position of a base of a gene's coding sequence."""
    return STARTS[k] + offset + (len(INTRON) if k == 0 and offset >= 180 else 0)


def stop_at(k, codon):
    """An SNV that makes the codon a stop, if one base can."""
    c = CDS[k][codon * 3 : codon * 3 + 3]
    return next(((codon * 3 + i, x) for i in range(3) for x in "ACGT" if x != c[i] and CODE[c[:i] + x + c[i + 1 :]] == "*"), None)


@pytest.fixture(scope="module")
def world(spark):
    ref = spark.createDataFrame([("c", 0, 1, GENOME)], "contig string, chunk_id long, chunk_start long, seq string")
    genes = spark.createDataFrame([(f"g{k}", "c", STARTS[k], place(k, 359), "+", 0, True) for k in range(3)], "gene_id string, contig string, start long, end long, strand string, phase int, coding boolean")
    segs = [("g0", "c", "+", 0, place(0, 0), place(0, 179)), ("g0", "c", "+", 1, place(0, 180), place(0, 359)), ("g1", "c", "+", 0, place(1, 0), place(1, 179)), ("g1", "c", "+", 1, place(1, 180), place(1, 359))]
    return ref, genes, spark.createDataFrame(segs, "gene_id string, contig string, strand string, seg_idx int, start long, end long")


def snv(k, offset, alt):
    return ("c", place(k, offset), CDS[k][offset], alt)


def run(spark, world, rows):
    ref, genes, segs = world
    found = spark.createDataFrame([(*r, None) for r in rows], "contig string, pos long, ref string, alt string, ofreq double")
    return annotate(found, genes, ref, segs)


def test_decay_needs_a_real_intron(spark, world):
    early = {k: next(s for c in range(5, 40) if (s := stop_at(k, c))) for k in (0, 1)}
    late = next(s for c in range(50, 59) if (s := stop_at(0, c)))
    by = {(r.gene_id, tuple(r.positions)): r for r in run(spark, world, [snv(k, *s) for k, s in early.items()] + [snv(0, *late)]).collect()}
    told = {(k, off): by[(f"g{k}", (place(k, off),))].nmd for k, (off, _) in [*early.items(), (0, late)]}
    assert told == {(0, early[0][0]): "NMD-triggering", (1, early[1][0]): None, (0, late[0]): "NMD-triggering" if 180 - late[0] // 3 * 3 > 50 else "NMD-escaping"}
    assert all(r.change_type == "Stop gained" for r in by.values() if r.gene_id != "intergenic")


def test_frames_behind_a_deletion(spark, world):
    """A base deleted in the third codon: every later codon is shifted, or lies behind the new stop, in spliced genes as in plain ones."""
    gone, spots = 9, (15, 60, 240, 330)
    rows = [("c", place(k, gone - 1), CDS[k][gone - 1 : gone + 1], CDS[k][gone - 1]) for k in range(3)]
    rows += [snv(k, o, "A" if CDS[k][o] != "A" else "C") for k in range(3) for o in spots]
    every = run(spark, world, rows).collect()
    for k in range(3):
        altered = CDS[k][:gone] + CDS[k][gone + 1 :]
        stop = protein(altered).find("*")
        ptc = ((stop * 3 + 1) // 3 + 1) if stop >= 0 else None
        got = [r for r in every if r.gene_id == f"g{k}"]
        indel = next(r for r in got if r.variant_type == "INDEL")
        assert len(got) == 5 and indel.change_type == "Frameshift Indel" and indel.ref_codon == CDS[k][9:12] and indel.alt_codon == altered[9:12] and indel.local_aa_change == indel.aa_change
        for r in got:
            if r.variant_type == "INDEL":
                continue
            offset = next(o for o in spots if place(k, o) == r.positions[0])
            texts = (r.aa_change, r.snp_aa_changes, r.local_aa_change, r.local_snp_aa_changes)
            if ptc is not None and ptc < 120 and offset // 3 + 1 > ptc:
                assert r.change_type == "Downstream of premature stop" and set(texts) == {"downstream of premature stop"}
            else:
                assert "(frameshift)" in r.change_type and all(x.endswith(" (fs)") for x in texts), (offset, ptc)


def test_ranges_of_an_exon_deletion(spark, world):
    _, _, segs = world
    at, end = place(0, 170), place(0, 190)
    rows = alleles.with_event(spark.createDataFrame([("c", at, GENOME[at - 1 : end], GENOME[at - 1])], "contig string, pos long, ref string, alt string"))
    got = sorted((r.lo, r.hi) for r in frames.touched_ranges(rows, segs).collect())
    assert got == [(171, 179), (180, 190)]
    first = frames.first_offsets(frames.touched_ranges(rows, segs)).first()
    assert (first.first_touched, first.first_changed, first.effective) == (171, 171, 171)


def test_wide_table(spark, world):
    """44 columns in order; counts of a codon of two SNVs, a single SNV and a deletion, from four molecules."""
    o = 240
    pair = [(o, "A" if CDS[2][o] != "A" else "C"), (o + 1, "A" if CDS[2][o + 1] != "A" else "C")]
    one = (300, "A" if CDS[2][300] != "A" else "C")
    d = 270
    s = STARTS[2] + 230

    def read(name, flag, edits, cut=False):
        seq = list(CDS[2][230:330])
        for at, x in edits:
            seq[at - 230] = x
        if cut:
            del seq[d - 230]
        return (abs(hash(name)) % 1000, name, flag, "c", s, 60, f"{d - 230}M1D{99 - d + 230}M" if cut else "100M", "".join(seq), "I" * len(seq))

    aligned = spark.createDataFrame([read("m1", 0, pair), read("m2", 16, pair + [one]), read("m3", 0, pair[:1], True), read("m4", 16, [])], "read_id long, qname string, flag int, contig string, start long, mapq int, cigar string, seq string, qual string")
    rows = [snv(2, *x) for x in (*pair, one)] + [("c", place(2, d - 1), CDS[2][d - 1 : d + 1], CDS[2][d - 1])]
    events = alleles.with_event(spark.createDataFrame(rows[-1:], "contig string, pos long, ref string, alt string"))
    wide = tables.read_table(evidence.attach_support(run(spark, world, rows), events, aligned))
    titles = wide.columns
    assert len(titles) == 44 and titles[13:23] == ["MNV Codon", *tables.READ_COLUMNS["MNV Codon"]] and titles[-3:] == ["NMD Prediction", "HGVS g.", "HGVS c."]
    got = {r["Variant Type"]: r for r in wide.collect() if r["Gene"] == "g2"}
    both = got["SNP/MNV"]
    assert [both[c] for c in tables.READ_COLUMNS["MNV Codon"]] == ["1, 0", "1, 0", "0, 0", "2", "1", "1", "4", "0.2500, 0.0000", "0.5000"]
    assert (both["MNV Phasing Reads"], both["MNV Phasing Support"], both["Event Reads"]) == ("2", "1.0000", "-")
    assert [got["SNP"][c] for c in tables.READ_COLUMNS["MNV Codon"]] == ["1", "0", "1", "0", "0", "0", "4", "0.2500", "0.0000"]
    assert [got["INDEL"][c] for c in tables.READ_COLUMNS["Event Components"]] == ["1", "1", "0", "4", "0.2500"] and got["INDEL"]["SNP Reads"] == "-"


def test_support_rules(spark):
    ddl = "gene_id string, variant_type string, snp_reads array<long>, snp_forward array<long>, snp_reverse array<long>, site_depth array<long>, snp_freq array<string>, mnv_reads long, mnv_forward long, mnv_reverse long, mnv_depth long, event_reads long, event_forward long, event_reverse long, event_depth long"
    rows = [
        ("a", "SNP", [3], [2], [1], [10], ["x"], 0, 0, 0, 10, None, None, None, None),
        ("b", "SNP/MNV", [3, 0], [2, 0], [1, 0], [10, 10], ["x", "y"], 5, 2, 3, 10, None, None, None, None),
        ("c", "INDEL", None, None, None, None, None, None, None, None, None, 1, 1, 0, 10),
        ("intergenic", "MNV", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ddl)
    kept = lambda **k: {r.gene_id for r in df.where(evidence.passes_support(**k)).collect()}
    assert kept() == {"a", "b", "c", "intergenic"}
    assert kept(min_snp_reads=2) == {"a", "b", "c", "intergenic"}
    assert kept(min_snp_reads=2, min_mnv_reads=6) == {"a"}
    assert kept(min_snp_reads=4, min_mnv_freq=0.5) == {"b"}
    assert kept(min_snp_strand=2) == {"b", "c", "intergenic"}
