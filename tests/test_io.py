"""Files in and out: splits, blocks, several alignment files, guards, sinks, the watched folder."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from strandmill.errors import EngineError
from strandmill.functions import alleles
from strandmill.operators import indels, reads
from strandmill.sinks import blocks, tables
from strandmill.sinks import vcf as vcf_out
from strandmill.sources import alignments, annotation, fasta, vcf


def test_fasta_over_many_splits(spark, tmp_path):
    seqs = {f"s{i}": "".join("ACGT"[(i * 7 + k * k) % 4] for k in range(700 * i)) for i in range(5)}
    lines = [x for n, s in seqs.items() for x in (f">{n} text", *(s[k : k + 61] for k in range(0, len(s), 61)))]
    (tmp_path / "a.fa").write_text("\n".join(lines[:40]) + "\n" + "\n".join(lines[40:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for chunk, overlap in ((128, 16), (16384, 64)):
            rows = fasta.read_fasta(spark, f"{tmp_path}/a.fa", chunk=chunk, overlap=overlap).collect()
            got = {}
            for r in sorted(rows, key=lambda r: r.chunk_id):
                assert r.seq == seqs[r.contig][r.chunk_start - 1 : r.chunk_start - 1 + chunk + overlap]
                got[r.contig] = got.get(r.contig, "") + r.seq[:chunk]
            assert got == {n: s for n, s in seqs.items() if s}
        assert {r.name: (r.length, r.line_bases) for r in fasta.index(spark, f"{tmp_path}/a.fa").collect()} == {n: (len(s), min(61, len(s))) for n, s in seqs.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "b.fa").write_text("ACGT\n>x\nAC\n")
    (tmp_path / "c.fa").write_text(">x\nAC\n>x\nAC\n")
    for bad in ("b", "c"):
        with pytest.raises(EngineError):
            fasta.read_fasta(spark, f"{tmp_path}/{bad}.fa")


def test_unnamed_reads_of_two_files_stay_apart(spark, tmp_path):
    rows = [(i, None, 16 * (i % 2), "c", 10 + i, 60, "10M2D10M", "A" * 20, "I" * 20) for i in range(6)]
    df = spark.createDataFrame(rows, alignments.READ_DDL)
    assert blocks.write_bam(df.repartition(2), f"{tmp_path}/b", [("c", 1000)]) == 6
    back = alignments.read_bam(spark, f"{tmp_path}/b")
    assert back.select("read_id").distinct().count() == 6 == back.select(reads.molecule_key()).distinct().count()
    assert alignments.read_bam(spark, f"{tmp_path}/b", ("c", 33, 34)).count() == 4  # those that start at 12 and later end at 33 and later
    assert alignments.check_bam(spark, f"{tmp_path}/b") == ["c"]
    with pytest.raises(EngineError):
        alignments.check_bam(spark, f"{tmp_path}/none")


def test_block_text_is_one_gzip_file(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").repartitionByRange(3, "i").sortWithinPartitions("i")
    assert blocks.write_block_text(df, f"{tmp_path}/t") == 5000
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").iterdir()) if p.name.startswith("part-"))
    assert gzip.decompress(data).decode().splitlines() == lines


def test_conflicting_components_have_no_sequence(spark):
    def comp(kind, pos, ref, alt):
        return F.struct(F.lit(kind).alias("kind"), F.lit(pos).cast("long").alias("pos"), F.lit(ref).alias("ref"), F.lit(alt).alias("alt"))

    cases = [
        ([comp("DEL", 12, "GT", ""), comp("SNV", 13, "T", "A")], None),
        ([comp("DEL", 12, "GT", ""), comp("INS", 12, "", "AA")], None),
        ([comp("SNV", 12, "G", "A"), comp("SNV", 12, "G", "C")], None),
        ([comp("SNV", 11, "C", "T"), comp("DEL", 13, "T", ""), comp("INS", 12, "", "AA")], "ATGAAACG"),
        ([comp("INS", 16, "", "AA")], "ACGTACG"),
    ]
    for parts, want in cases:
        got = spark.range(1).select(indels.apply_to_feature(F.lit("ACGTACG"), F.lit(10), F.array(*parts)).alias("s")).first().s
        assert got == want
    behind = spark.range(1).select(indels.apply_to_feature(F.lit("ACGTACG"), F.lit(10), F.array(comp("INS", 16, "", "AA")), F.lit(True)).alias("s")).first().s
    assert behind == "ACGTACGAA"


def test_longer_deletions_and_skips_are_no_support(spark):
    """A read that deletes more, or skips the bases, doesn't show the deletion; one that stops on the anchor has no say."""
    ref = "ACGTACGTACGTACGTACGT"
    rows = [
        (1, "exact", 0, "c", 1, 60, "5M2D13M", ref[:5] + ref[7:], "I" * 18),
        (2, "longer", 0, "c", 1, 60, "5M3D12M", ref[:5] + ref[8:], "I" * 17),
        (3, "skip", 0, "c", 1, 60, "5M2N13M", ref[:5] + ref[7:], "I" * 18),
        (4, "stops", 0, "c", 1, 60, "5M", ref[:5], "I" * 5),
        (5, "plain", 0, "c", 1, 60, "20M", ref, "I" * 20),
    ]
    v = alleles.with_event(spark.createDataFrame([("c", 5, ref[4:7], ref[4])], "contig string, pos long, ref string, alt string"))
    views = reads.observe_alleles(spark.createDataFrame(rows, alignments.READ_DDL), v.select("contig", "pos", "ref", "alt", "components"))
    s = reads.indel_support(views, ["pos"]).first()
    assert (s.event_reads, s.event_depth) == (1, 5)
    full = reads.indel_support(views, ["pos"], anchor_depth=False).first()
    assert (full.event_reads, full.event_depth) == (1, 3)


def test_guards(spark, tmp_path):
    with pytest.raises(EngineError):
        vcf.read_vcf(spark, f"{tmp_path}/x.bcf")
    (tmp_path / "g.txt").write_text("a\t1\t9\t+\t0\tsomething\n")
    with pytest.raises(EngineError):
        annotation.read_gene_table(spark, f"{tmp_path}/g.txt", "c")
    assert annotation.detect_format("a.gff3.gz") == annotation.detect_format("x", "1\t2\t3\t4\t5\t6\t7\t8\t9") == "gff" and annotation.detect_format("a.tsv") == annotation.detect_format("x", "a\tb") == "table"
    (tmp_path / "n.vcf").write_text("no header\n")
    with pytest.raises(EngineError) as e:
        vcf.header(spark, f"{tmp_path}/n.vcf")
    said = json.loads(e.value.to_json())
    assert (said["code"], said["exit_code"]) == ("E102", 12)
    with pytest.raises(EngineError):
        tables.output_paths("o", "p", ["a b", "a_b"])
    assert tables.output_paths("o/", "p", ["a", "b"]) == {"a": "o/p.sample_a", "b": "o/p.sample_b"} and tables.base_name("x/y.vcf.gz") == "y"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 9, "A", "T", "PASS", "X=1"), ("c1", 3, "A", "C", "LowSupport", "X=2"), ("c0", 5, "G", "C", "PASS", "")], "contig string, pos long, ref string, alt string, filter string, info string")
    vcf_out.write_vcf(rows, f"{tmp_path}/o", ["c0", "c1"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/o").collect()]
    assert [x.split("\t")[1] for x in lines if not x.startswith("#")] == ["5", "9"] and not any("##FILTER" in x for x in lines)
    vcf_out.write_vcf(rows, f"{tmp_path}/p", emit_filtered=True)
    assert spark.read.text(f"{tmp_path}/p").where("value like '##FILTER%' or value like '%LowSupport%'").count() >= 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_bytes(b"abc")
    m = json.loads(tables.manifest(spark, [f"{tmp_path}/in"], [], {"quality": 20}))
    assert list(next(iter(m["inputs"].values())).values()) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    counts = spark.createDataFrame([("c1", 2), (None, 2)], "contig string, n_rows long")
    assert json.loads(tables.summary_json(counts))["global"]["n_rows"] == 2
    tables.write_tsv(spark.createDataFrame([("a\tb%", None)], "x string, y string"), f"{tmp_path}/t")
    assert tables.read_tsv(spark, f"{tmp_path}/t", ["x"]).first().asDict() == {"x": "a\tb%", "y": None}
    with pytest.raises(EngineError):
        tables.read_tsv(spark, f"{tmp_path}/t", ["z"])


def test_watched_folder(spark, tmp_path):
    from strandmill.streaming.drops import watch_vcf

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\nc\t3\t.\tA\tC,G\n")
    seen = []
    watch_vcf(spark, f"{tmp_path}/in", f"{tmp_path}/cp", lambda df, k: seen.extend(map(tuple, df.collect()))).awaitTermination()
    assert sorted(seen) == [("c", 3, "A", "C"), ("c", 3, "A", "G")]
