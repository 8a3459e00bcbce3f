"""Text sources, alignments and the whole plan on a small genome, against whole-sequence retranslation in plain Python."""

import gzip
import itertools
import struct
import zlib

import pytest
from strandmill.errors import EngineError
from strandmill.functions import alleles
from strandmill.functions.dna import GENETIC_CODES
from strandmill.operators import reads
from strandmill.plans.annotate import Params, annotate, ordered, prepare, read_support
from strandmill.sinks import report, tables
from strandmill.sources import alignments, annotation, fasta, ivar, vcf

CODE = {"".join(c): r for c, r in zip(itertools.product("TCAG", repeat=3), GENETIC_CODES[11], strict=True)}
PLUS = "ATG" + "GCT" * 20 + "TAA"
COMP = str.maketrans("ACGT", "TGCA")
MINUS = PLUS.translate(COMP)[::-1]
SPLICED = ("ATGGC", "T" * 30, "TGCTGCTTAA")
GENOME = PLUS + "A" * 30 + MINUS + "A" * 30 + "".join(SPLICED) + "A" * 20
M0, S0 = len(PLUS) + 31, len(PLUS) + 31 + len(MINUS) + 30


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "g.fa").write_text(">c1 description\n" + "\n".join(GENOME[i : i + 50].lower() for i in range(0, len(GENOME), 50)) + "\n")
    gff = [
        f"c1\tx\tgene\t1\t{len(PLUS)}\t.\t+\t.\tID=gene-plus;biotype=protein_coding",
        f'c1\tx\tgene\t{M0}\t{M0 + len(MINUS) - 1}\t.\t-\t.\tID=minus;Note="a;b"',
        f"c1\tx\tCDS\t{S0}\t{S0 + 4}\t.\t+\t0\tParent=t1;gene=spl",
        f"c1\tx\tCDS\t{S0 + 35}\t{S0 + 44}\t.\t+\t1\tParent=t1;gene=spl",
    ]
    (d / "g.gff3").write_text("##gff-version 3\n" + "\n".join(gff) + "\n")
    rows = [
        ("c1", 4, "G", "A", "DP=10;AF=0.5", "0|1:8"),
        ("c1", 5, "C", "T", "DP=10", "0|1:8"),
        ("c1", M0 + 4, GENOME[M0 + 3], "T" if GENOME[M0 + 3] != "T" else "A", ".", "0/1:7"),
        ("c1", 10, GENOME[9:11], GENOME[9], ".", "1/1:7"),
        ("c1", 70, "A", "C", ".", "0/1:7"),
        ("c1", S0 + 4, "C", "A", ".", "0/1:7"),
        ("c1", S0 + 6, "T", "G", ".", "0/1:7"),
    ]
    head = '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n'
    body = "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\tPASS\t{i}\tGT:DP\t{g}\t0/0:5\n" for c, p, r, a, i, g in rows)
    (d / "v.vcf").write_text(head + body)
    with gzip.open(d / "v2.vcf.gz", "wt") as f:
        f.write(head + body)
    return d


def test_sources(spark, files):
    ref = fasta.read_fasta(spark, f"{files}/g.fa", chunk=64, overlap=16)
    parts = sorted(ref.collect(), key=lambda r: r.chunk_id)
    assert "".join(p.seq[:64] for p in parts) == GENOME and parts[0].contig == "c1"
    a = vcf.read_vcf(spark, f"{files}/v.vcf")
    assert a.count() == 7 == vcf.read_vcf(spark, f"{files}/v2.vcf.gz").count()
    first = a.where("pos = 4").first()
    assert (first.odp, first.ofreq, first.phase.slots) == (8, 0.5, [2])
    assert vcf.samples(spark, f"{files}/v.vcf") == ["s1", "s2"]
    assert vcf.read_vcf(spark, f"{files}/v.vcf", "s2").count() == 0
    assert {(r.sample) for r in vcf.read_vcf(spark, f"{files}/v.vcf", "all").collect()} == {"s1"}
    with pytest.raises(EngineError):
        vcf.read_vcf(spark, f"{files}/v.vcf", "nobody")
    g = annotation.read_gff(spark, f"{files}/g.gff3")
    assert annotation.feature_types(g) == ["CDS", "gene"]
    assert {r.name for r in g.collect()} == {"plus", "minus", "spl"}


def test_bad_inputs(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC!GT\n")
    (tmp_path / "b.gff").write_text("c\tx\tgene\t9\t3\t.\t+\t.\tID=a\n")
    (tmp_path / "c.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t3\t.\tA\tC,G\t.\t.\t.\n")
    for call in (lambda: fasta.read_fasta(spark, f"{tmp_path}/a.fa"), lambda: annotation.read_gff(spark, f"{tmp_path}/b.gff"), lambda: vcf.read_vcf(spark, f"{tmp_path}/c.vcf")):
        with pytest.raises(EngineError):
            call()
    assert vcf.read_vcf(spark, f"{tmp_path}/c.vcf", split=True).count() == 2


def test_ivar(spark, tmp_path, files):
    (tmp_path / "i.tsv").write_text("REGION\tPOS\tREF\tALT\tTOTAL_DP\tALT_DP\tALT_FREQ\tPASS\nc1\t4\tG\tA\t20\t5\t0.25\tTRUE\nc1\t5\tC\t+GG\t20\t5\t0.25\tTRUE\nc1\t5\tC\t-TG\t20\t5\t0.25\tTRUE\nc1\t6\tT\tA\t20\t5\t0.25\tFALSE\n")
    ref = fasta.read_fasta(spark, f"{files}/g.fa")
    assert ivar.looks_like_ivar(spark, f"{tmp_path}/i.tsv") and not ivar.looks_like_ivar(spark, f"{files}/v.vcf")
    got = {(r.pos, r.ref, r.alt, r.odp) for r in ivar.read_ivar(spark, f"{tmp_path}/i.tsv", ref).collect()}
    assert got == {(4, "G", "A", 20), (5, "C", "CGG", 20), (5, "CTG", "C", 20)}


def residue_of(seq, k):
    return CODE[seq[3 * k : 3 * k + 3]]


def test_annotate(spark, files, tmp_path):
    ref = fasta.read_fasta(spark, f"{files}/g.fa")
    genes, segments = annotation.genes_of(annotation.read_gff(spark, f"{files}/g.gff3"))
    found = ordered(annotate(vcf.read_vcf(spark, f"{files}/v.vcf"), genes, ref, segments)).collect()
    by = {tuple(r.positions): r for r in found}
    mnv = by[(4, 5)]
    assert (mnv.variant_type, mnv.ref_codon, mnv.alt_codon, mnv.aa_change, mnv.hgvs_g) == ("SNP/MNV", "GCT", "ATT", "Ala2Ile", "g.[4G>A;5C>T]")
    fs = by[(10,)]
    mutated = PLUS[:10] + PLUS[11:]
    assert fs.change_type == "Frameshift Indel" and fs.aa_change.endswith("fs") and "Ala4" in fs.aa_change and residue_of(mutated, 3) != residue_of(PLUS, 3)
    minus = by[(M0 + 4,)]
    assert minus.ref_codon == PLUS[len(PLUS) - 6 : len(PLUS) - 3] and minus.gene_id != "intergenic"
    assert by[(70,)].so_term == "intergenic_variant"
    cds = SPLICED[0] + SPLICED[2]
    j = by[(S0 + 4,)]
    assert j.ref_codon == cds[3:6] and j.alt_codon == "GA" + cds[5] and j.so_term.endswith("&splice_region_variant")
    assert by[(S0 + 6,)].so_term == "splice_donor_variant"
    tables.write_tsv(spark.createDataFrame([("a%b", None)], "x string, y string"), f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).first().asDict() == {"x": "a%25b", "y": "-"}


def test_reference_guard(spark, files):
    ref = fasta.read_fasta(spark, f"{files}/g.fa")
    with pytest.raises(EngineError):
        prepare(spark.createDataFrame([("c1", 4, "T", "A")], "contig string, pos long, ref string, alt string"), ref)


SAM = [
    ("m1", 0, 1, "20M", GENOME[:3] + "AT" + GENOME[5:20]),
    ("m1", 16, 3, "20M", GENOME[2] + "AT" + GENOME[5:22]),
    ("m2", 0, 1, "20M", GENOME[:3] + "A" + GENOME[4:20]),
    ("m3", 16, 1, "5M2D15M", GENOME[:5] + GENOME[7:22]),
    ("m4", 1024, 1, "20M", GENOME[:3] + "AT" + GENOME[5:20]),
]


def sam_text():
    return "@HD\tVN:1.6\n" + "".join(f"{q}\t{f}\tc1\t{p}\t60\t{c}\t*\t0\t0\t{s}\t{'I' * len(s)}\n" for q, f, p, c, s in SAM)


def bam_bytes():
    import re

    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", len(GENOME))
    for q, f, p, c, s in SAM:
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)(\D)", c)]
        packed = bytes(("=ACMGRSVTWYHKDBN".index(s[i]) << 4) | ("=ACMGRSVTWYHKDBN".index(s[i + 1]) if i + 1 < len(s) else 0) for i in range(0, len(s), 2))
        body = struct.pack("<iiBBHHHiiii", 0, p - 1, len(q) + 1, 60, 0, len(ops), f, len(s), -1, -1, 0) + q.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + bytes([40] * len(s))
        out += struct.pack("<i", len(body)) + body
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    half = len(out) // 2
    z2 = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(out[:half]) + z.flush() + z2.compress(out[half:]) + z2.flush()


def test_reads(spark, tmp_path):
    (tmp_path / "r.sam").write_text(sam_text())
    (tmp_path / "r.bam").write_bytes(bam_bytes())
    sam, bam = alignments.read_sam(spark, f"{tmp_path}/r.sam"), alignments.read_bam(spark, f"{tmp_path}/r.bam")
    cols = ["qname", "flag", "contig", "start", "mapq", "cigar", "seq", "qual"]
    assert sorted(map(str, sam.select(*cols).collect())) == sorted(map(str, bam.select(*cols).collect()))
    rows = spark.createDataFrame([("c1", "plus", [4, 5], ["A", "T"], "SNV:4:G>A | SNV:5:C>T", "SNP/MNV")], "contig string, gene_id string, positions array<long>, alt_bases array<string>, components string, variant_type string")
    r = read_support(rows, sam, Params()).where("variant_type = 'SNP/MNV'").first()
    assert (r.mnv_reads, r.mnv_forward, r.mnv_reverse, r.mnv_depth, list(r.snp_reads)) == (1, 1, 1, 3, [1, 0])
    d = alleles.with_event(spark.createDataFrame([("c1", 5, GENOME[4:7], GENOME[4])], "contig string, pos long, ref string, alt string"))
    views = reads.observe_alleles(reads.usable(sam), d.select("contig", "pos", "ref", "alt", "components"))
    s = reads.indel_support(views, ["contig", "pos", "ref", "alt"]).first()
    assert (s.event_reads, s.event_reverse, s.event_depth) == (1, 1, 3)


def test_report_labels_and_page():
    assert report.labels(["a/x.tsv", "b/x.tsv", "c/y.tsv"]) == ["a/x", "b/x", "y"]
    assert report.labels(["x.tsv", "x.tsv"]) == ["x", "x#2"]
    assert "</script><b>" not in report.page([{"a": "</script><b>"}])
