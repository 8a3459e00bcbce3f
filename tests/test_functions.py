"""Scalar functions against plain Python."""

import itertools
import math
import random

from pyspark.sql import functions as F
from strandmill.functions import aa, alleles, consequence, dna, stats
from strandmill.operators import filters, phase


def test_translation_and_complement(spark):
    code = {"".join(c): r for c, r in zip(itertools.product("TCAG", repeat=3), dna.GENETIC_CODES[11], strict=True)}
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in range(12)] + ["ACNGGT", "acgtuu"]
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", dna.translate(F.col("s")).alias("p"), dna.reverse_complement(dna.reverse_complement(F.col("s"))).alias("rr")).collect()
    for r in got:
        s = r.s.upper().replace("U", "T")
        assert r.p == "".join(code.get(s[i : i + 3], "X") for i in range(0, len(s) - len(s) % 3, 3))
        assert r.rr.upper().replace("U", "T") == r.s.upper().replace("U", "T")


def test_decomposition_rebuilds_the_allele(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("AC") for _ in range(rng.randint(1, 5)))
    pairs = [(word(), word()) for _ in range(300)] + [("A", "<DEL>"), ("AT", "AT"), ("T", "AT")]
    df = spark.createDataFrame([(10, r, a) for r, a in pairs], "pos long, ref string, alt string")
    for r in alleles.with_event(df).withColumn("labels", alleles.labels(F.col("components"))).collect():
        if r.event_class == "symbolic":
            continue
        bases = {10 + i: b for i, b in enumerate(r.ref)}
        after = {}
        for c in r.components:
            if c.kind == "SNV":
                bases[c.pos] = c.alt
            elif c.kind == "DEL":
                for k in range(len(c.ref)):
                    assert bases[c.pos + k] == c.ref[k]
                    bases[c.pos + k] = ""
            else:
                after[c.pos] = c.alt
        assert after.get(9, "") + "".join(bases[p] + after.get(p, "") for p in sorted(bases)) == r.alt
        assert (r.event_class == "reference") == (r.ref == r.alt)


def test_labels_round_trip_and_normalise(spark):
    df = spark.createDataFrame([(5, "CAG", "CG"), (5, "A", "ATT"), (5, "ACG", "GCT"), (5, "AAC", "AC")], "pos long, ref string, alt string")
    e = alleles.with_event(df).withColumn("c", F.explode("components")).withColumn("l", alleles.label(F.col("c")))
    assert all(r.c == r.b for r in e.withColumn("b", alleles.parse_label(F.col("l"))).collect())
    n = {(r.pos, r.ref, r.alt) for r in alleles.normalise(spark.createDataFrame([(5, "CAAG", "CAG"), (7, "GTT", "GAT"), (3, "A", "C")], "pos long, ref string, alt string")).collect()}
    assert n == {(7, "AG", "G"), (8, "T", "A"), (3, "A", "C")}


def test_fisher_and_linkage(spark):
    def exact(a, b, c, d):
        r1, r2, c1 = a + b, c + d, a + c
        p = [math.comb(r1, k) * math.comb(r2, c1 - k) / math.comb(r1 + r2, c1) for k in range(max(0, c1 - r2), min(r1, c1) + 1)]
        seen = math.comb(r1, a) * math.comb(r2, c1 - a) / math.comb(r1 + r2, c1)
        return min(1.0, sum(x for x in p if x <= seen * (1 + 1e-7)))

    rng = random.Random(3)
    rows = [tuple(rng.randint(0, 9) for _ in range(4)) for _ in range(60)] + [(0, 0, 0, 0), (5, 0, 0, 5)]
    got = spark.createDataFrame(rows, "a int, b int, c int, d int").select("*", stats.fisher_exact(*(F.col(x) for x in "abcd")).alias("p"), stats.linkage(*(F.col(x) for x in "abcd")).alias("l")).collect()
    assert all(abs(r.p - exact(r.a, r.b, r.c, r.d)) < 1e-9 for r in got)
    assert next(r.l.d_prime for r in got if (r.a, r.b, r.c, r.d) == (5, 0, 0, 5)) == 1.0
    assert next(r.l for r in got if (r.a, r.b, r.c, r.d) == (0, 0, 0, 0)) is None


def test_residues(spark):
    row = spark.range(1).select(aa.grantham(F.lit("S"), F.lit("R")).alias("sr"), aa.grantham(F.lit("L"), F.lit("I")).alias("li"), aa.grantham(F.lit("C"), F.lit("W")).alias("cw"), aa.grantham(F.lit("*"), F.lit("W")).alias("no"), aa.dbs_class(F.lit("GG"), F.lit("AA")).alias("gg"), aa.dbs_class(F.lit("CG"), F.lit("TT")).alias("cg"), aa.dbs_class(F.lit("AC"), F.lit("AT")).alias("one"), consequence.change_type_of_text(F.lit("M1T")).alias("m")).first()
    assert (row.sr, row.li, row.cw, row.no, row.gg, row.cg, row.one, row.m) == (109, 5, 214, None, "CC>TT", "CG>AA", None, "Start lost")


def test_filters_and_phase(spark):
    df = spark.createDataFrame([("0/1",), ("0/0",), ("./.",), (None,), ("0|.",)], "g string")
    assert [r.c for r in df.select(filters.carried(F.col("g"), F.lit(1)).alias("c")).collect()] == [True, False, True, True, True]
    f = spark.createDataFrame([("12%",), ("0.5",), ("50",), ("x",)], "t string").select(filters.as_fraction(F.col("t")).alias("x"))
    assert [r.x for r in f.collect()] == [0.12, 0.5, 0.5, None]
    g = spark.range(1).select(phase.declared_phase(F.array(*(phase.parse_phase(F.lit(x), F.lit("9"), F.lit(1)) for x in ("0|1", "0|1")))).alias("cis"), phase.declared_phase(F.array(*(phase.parse_phase(F.lit(x), F.lit("9"), F.lit(1)) for x in ("0|1", "1|0")))).alias("trans"), phase.declared_phase(F.array(*(phase.parse_phase(F.lit(x), F.lit("9"), F.lit(1)) for x in ("0|1", "0/1")))).alias("none")).first()
    assert (g.cis, g.trans, g.none) == ("cis:9", "trans:9", None)


def test_columns_of_codon_rows_are_computed_once(spark):
    """A filter on a late column doesn't put the residues' expressions in again at each use (q16_grantham)."""
    from strandmill.operators.codons import describe_codons

    rows = spark.sql("select 'ATG' ref_codon, 'ACG' alt_codon, array('ACG') single_codons, '+' strand, 5L aa_local, array(struct(2L as pos, 'T' as ref, 'C' as alt, 2L as cds)) snvs from range(3)")
    found = describe_codons(rows, 11, F.lit(0)).where("grantham is not null").select("grantham", "ref_aa")
    assert [tuple(r) for r in found.collect()] == [(81, "M")] * 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count(dna.GENETIC_CODES[11]) <= 3


def test_molecules_are_merged_without_sorting_and_long_reads_piece_by_piece(spark):
    """Bases of mates are aggregated by hash (q36_snp_support and what else counts molecules), and a read over many bins shows each site."""
    from strandmill.operators import reads

    seq = "ACGTTGCA" * 200
    rows = spark.createDataFrame([(1, "m", "c", 100, 0, 60, "1600M", seq, None), (2, "m", "c", 100, 16, 60, "5S700M3I20D892M", seq, "I" * 1600)], "read_id long, qname string, contig string, start long, flag int, mapq int, cigar string, seq string, qual string")
    sites = spark.createDataFrame([("c", p) for p in range(90, 1720, 7)], "contig string, pos long")
    seen = reads.observe_sites(rows, sites)
    place = lambda r, p: p - 100 if r == 1 else p - 100 + 5 if p < 800 else p - 820 + 708 if p >= 820 else None
    want = {(r, p): seq[place(r, p)] for r in (1, 2) for p in range(90, 1720, 7) if p >= 100 and (place(r, p) is not None) and p <= (1699 if r == 1 else 1711)}
    assert {(r.read_id, r.pos): r.base for r in seen.collect()} == want
    assert {(r.read_id, r.quality) for r in seen.collect()} == {(1, 255), (2, 40)}
    merged = reads.merge_molecules(seen)
    same = {p: want.get((1, p), want.get((2, p))) for p in {p for _, p in want} if want.get((1, p), want.get((2, p))) == want.get((2, p), want.get((1, p)))}
    assert {r.pos: r.base for r in merged.collect()} == same
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()


def test_substitutions_of_one_position_keep_their_order(spark):
    """A base that a transcript reads twice can change to two bases in one codon (q102_annotated_rows)."""
    rows = spark.createDataFrame([([(9, "T", "C"), (9, "T", "A"), (7, "G", "C")],)], "items array<struct<pos:long,ref:string,alt:string>>")
    assert rows.select(consequence.hgvs_substitution(F.col("items"), "g.")).first()[0] == "g.[7G>C;9T>C;9T>A]"
