"""Block-compressed files read in ranges: cuts inside lines, multi-byte text and records; indexes and regions."""

import os
import random
import struct

import pytest
from strandmill.errors import EngineError
from strandmill.sinks import blocks as sink
from strandmill.sources import alignments, bam_index, bgzf, vcf


def packed(data: bytes, size: int) -> bytes:
    return b"".join(sink.block(data[i : i + size]) for i in range(0, len(data), size)) + sink.EOF


@pytest.mark.parametrize("end", ["\n", "\r\n", ""])
def test_lines_of_ranges(spark, tmp_path, end):
    rng = random.Random(1)
    lines = ["é日本" * rng.randrange(40) + f" {i}" for i in range(900)] + ["", "x" * 70_000, "", "ü"]
    text = (end or "\n").join(lines) + end
    (tmp_path / "t.txt.gz").write_bytes(packed(text.encode(), 997))  # blocks cut characters
    (tmp_path / "nothing.txt.gz").write_bytes(sink.EOF)
    for split in (100, 1009, 1 << 30):
        got = [r.value for r in bgzf.read_block_lines(spark, str(tmp_path), split).collect()]
        assert sorted(got) == sorted(lines), split
    assert bgzf.read_block_lines(spark, str(tmp_path), 1009).rdd.getNumPartitions() > 10


def test_every_cut_gives_each_line_once(tmp_path):
    text = b"a\nbb\n\nccc\n" + b"d" * 50 + b"\ne"
    (tmp_path / "t.gz").write_bytes(packed(text, 7))
    size = os.path.getsize(tmp_path / "t.gz")
    for cut in range(1, size):
        found = []
        for start, end in ((0, cut), (cut, size)):
            with bgzf.open_at(f"file://{tmp_path}/t.gz") as f:
                found += [x for part in bgzf.owned_lines(bgzf.BlockFile(f, size, 64), start, end) for x in part]
        assert found == text.split(b"\n"), cut


def test_magic_inside_a_block_is_no_block(tmp_path):
    inner = sink.block(b"inner lines\n" * 3)
    raw = sink.block(os.urandom(500) + inner + os.urandom(500), level=0) + sink.block(b"next\n") + sink.EOF
    (tmp_path / "t.gz").write_bytes(raw)
    first = bgzf.block_size(raw)
    with bgzf.open_at(f"file://{tmp_path}/t.gz") as f:
        assert bgzf.BlockFile(f, len(raw), 64).find_block(5) == first


VCF = "##fileformat=VCFv4.2\n##INFO=<ID=XA,Number=A,Type=Integer,Description=\"é\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"


def test_block_vcf_equals_plain(spark, tmp_path):
    body = "".join(f"c{i % 3}\t{i + 1}\té{i}\tA\tG,T\t.\tPASS\tDP={i};XA=1,2\tGT:DP\t0|1:{i}\n" for i in range(2000))
    (tmp_path / "p.vcf").write_text(VCF + body)
    (tmp_path / "b.vcf.gz").write_bytes(packed((VCF + body).encode(), 1500))
    rows = lambda p, **k: sorted(map(str, vcf.read_vcf(spark, p, split=True, keep_info=True, **k).collect()))
    plain = rows(f"{tmp_path}/p.vcf")
    assert len(plain) == 2000 and rows(f"{tmp_path}/b.vcf.gz", split_bytes=700) == plain == rows(f"{tmp_path}/b.vcf.gz")
    with pytest.raises(EngineError):
        vcf.lines(spark, str(tmp_path))


QUALITIES = "".join(chr(33 + q) for q in range(41))
CONTIGS = [("a", 600_000), ("b", 400_000), ("c", 200_000)]


@pytest.fixture(scope="module")
def bam(spark, tmp_path_factory):
    """Sorted reads over three contigs, some of the first over introns of 50,000 bases, some unnamed, one long."""
    rng, rows = random.Random(2), []
    for k, (c, n) in enumerate(CONTIGS):
        for i in range(6000):
            start = rng.randrange(1, n - 60_000)
            cigar = "80M50000N120M" if k == 0 and i % 97 == 0 else "200M"
            rows.append((k, None if i % 50 == 0 else f"r{k}_{i}", 16 * (i % 2), c, start, i % 60, cigar, "".join(rng.choices("ACGT", k=200)), "".join(rng.choices(QUALITIES, k=200))))
    rows.append((1, "long", 0, "b", 77, 60, "9000M", "ACGT" * 2250, None))
    df = spark.createDataFrame(rows, "k int, qname string, flag int, contig string, start long, mapq int, cigar string, seq string, qual string")
    path = str(tmp_path_factory.mktemp("bam"))
    sink.write_bam(df.coalesce(1).sortWithinPartitions("k", "start"), path, CONTIGS)
    assert alignments.write_index(spark, path, 50_000) == 1
    return path, rows


def over(row, region):
    _, _, _, c, start, _, cigar, *_ = row
    end = start + {"200M": 200, "80M50000N120M": 50200, "9000M": 9000}[cigar] - 1
    return c == region[0] and start <= region[2] and end >= region[1]


def test_whole_file_by_ranges(spark, bam):
    path, rows = bam
    want = sorted(str(r[1:]) for r in rows)
    for split in (3_000, 20_000, 1 << 30):
        got = alignments.read_bam(spark, path, split_bytes=split).select("qname", "flag", "contig", "start", "mapq", "cigar", "seq", "qual").collect()
        assert sorted(str(tuple(r)) for r in got) == want, split
    assert alignments.read_bam(spark, path, split_bytes=20_000).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("region", [("a", 1, 600_000), ("b", 1, 1), ("b", 9000, 9100), ("b", 100_000, 110_000), ("c", 60_000, 60_500), ("c", 199_000, 200_000), ("a", 131_072, 131_073)])
def test_regions(spark, bam, region):
    path, rows = bam
    got = alignments.read_bam(spark, path, region, split_bytes=30_000, indexed=True).select("qname", "start").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[1], r[4])) for r in rows if over(r, region))


def test_a_region_reads_little(spark, bam):
    path, _ = bam
    total = read = 0
    for r in alignments.region_ranges(spark, path, ("b", 150_000, 152_000)).collect():
        blocks, _, found = alignments.open_records(*r)
        assert sum(1 for _ in found) > 0
        read, total = read + blocks.bytes_read, r.size
    assert 0 < read < 0.1 * total, (read, total)
    spans = sum((r.hi >> 16) - (r.lo >> 16) for r in alignments.region_ranges(spark, path, ("b", 150_000, 152_000)).collect())
    assert spans < 0.1 * total


def test_bad_indexes(spark, bam, tmp_path):
    path, rows = bam
    name = next(x for x in os.listdir(path) if x.endswith(".bam"))
    data, index = (open(f"{path}/{name}{x}", "rb").read() for x in ("", ".bai"))
    at, region = f"{tmp_path}/x.bam", ("a", 1, 5000)
    open(at, "wb").write(data)
    with pytest.raises(EngineError, match="no index"):
        alignments.read_bam(spark, at, region, indexed=True)
    with pytest.raises(EngineError, match="no index"):
        alignments.check_bam(spark, at, indexed=True)
    assert alignments.read_bam(spark, at, region).count() == sum(over(r, region) for r in rows)
    for bad, said in ((b"BAJ\1" + index[4:], "unreadable"), (index[:50], "unreadable"), (bam_index.pack_index(2, {}, {}), "another file")):
        open(f"{tmp_path}/x.bai", "wb").write(bad)
        with pytest.raises(EngineError, match=said):
            alignments.read_bam(spark, at, region)
    open(f"{tmp_path}/x.bai", "wb").write(index)
    assert alignments.check_bam(spark, at, indexed=True) == ["a", "b", "c"]
    os.utime(f"{tmp_path}/x.bai", (1, 1))
    with pytest.raises(EngineError, match="newer"):
        alignments.read_bam(spark, at, region)
    with pytest.raises(EngineError, match="no contig"):
        alignments.read_bam(spark, path, ("zz", 1, 2))
    with pytest.raises(EngineError):
        open(f"{tmp_path}/y.bam", "wb").write(b"no bam")
        alignments.check_bam(spark, f"{tmp_path}/y.bam")


def test_index_bytes_round_trip():
    chunks = {(0, 4681): [(1 << 16, 2 << 16)], (2, 0): [(5 << 16 | 7, 9 << 16), (11 << 16, 12 << 16)]}
    linear = {(0, 0): 1 << 16, (0, 2): 3 << 16}
    back = bam_index.unpack_index(bam_index.pack_index(3, chunks, linear))
    assert back == [({4681: chunks[0, 4681]}, [1 << 16, 1 << 16, 3 << 16]), ({}, []), ({0: chunks[2, 0]}, [])]
    assert bam_index.pack_index(3, chunks, linear)[:8] == b"BAI\1" + struct.pack("<i", 3)
    rng = random.Random(3)
    for _ in range(500):
        a = rng.randrange(1 << 29)
        z = min(1 << 29, a + rng.choice((1, 100, 20_000, 3_000_000)))
        b = bam_index.bin_of(a, z)
        x = rng.randrange(a, z)
        assert b in bam_index.bins_over(x, x + 1)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_offsets(spark, tmp_path, end):
    from strandmill.sources import fasta_ranges as fr

    rng = random.Random(9)
    seqs = {"a": "".join(rng.choices("ACGTacgt", k=1234)), "empty": "", "b": "".join(rng.choices("ACGT", k=600)), "one": "".join(rng.choices("ACGTN", k=5000))}
    text = ""
    for name, s in seqs.items():
        step = 5000 if name == "one" else 60
        text += f">{name} é described{end}" + "".join(s[i : i + step] + end for i in range(0, len(s), step))
    (tmp_path / "x.fa").write_bytes(text.encode())
    (tmp_path / "y.fa").write_bytes(b">odd\nACGT\nAC\nACGT\n>z\nAC")
    want = None
    for split in (1 << 30, 997, 400):
        index = fr.byte_index(spark, str(tmp_path), split)
        got = {r.name: (r.length, r.offset, r.line_bases, r.line_width, r.even) for r in index.collect()}
        assert want is None or got == want
        want = got
    w = len(end)
    assert {n: x[0] for n, x in got.items()} == {**{n: len(s) for n, s in seqs.items()}, "odd": 10, "z": 2}
    assert got["a"][2:] == (60, 60 + w, True) and got["one"][2:] == (5000, 5000 + w, True) and not got["odd"][4]
    assert got["a"][1] == len(f">a é described{end}".encode())
    ask = [("a", 1, 1), ("a", 60, 61), ("a", 59, 240), ("a", 1200, 9999), ("b", 1, 600), ("one", 2345, 2399), ("z", 1, 2)]
    regions = spark.createDataFrame(ask, "contig string, start long, end long")
    for r in fr.read_regions(regions, index).collect():
        own = {**seqs, "z": "AC"}[r.contig]
        assert r.seq == own[r.start - 1 : r.end].upper(), r
    for bad in (("odd", 1, 2), ("nowhere", 1, 2)):
        with pytest.raises(EngineError):
            fr.read_regions(spark.createDataFrame([bad], "contig string, start long, end long"), index).collect()


def test_a_range_of_a_fasta_file_reads_little_beyond_itself():
    """Bytes that the ranges of a file read together: the file, and one more line's worth a range (q56_fasta_index)."""
    import io

    from strandmill.sources.fasta_ranges import HEADER_BYTES, range_parts

    data = b">c1 x\n" + b"".join(b"ACGT" * 15 + b"\n" for _ in range(8000)) + b">c2\n" + b"A" * 300_000 + b"\n"

    class Source(io.BytesIO):
        taken = 0

        def read_at(self, n, at):
            out = self.getvalue()[at : at + n]
            Source.taken += len(out)
            return out

    cuts = list(range(0, len(data), 20_000))
    parts = [p for a in cuts for p in range_parts(Source(data), len(data), a, min(a + 20_000, len(data)))]
    assert sum(p.bases for p in parts) == 8000 * 60 + 300_000
    assert [p.name for p in parts if p.name is not None] == ["c1", "c2"]
    assert Source.taken <= len(data) + len(cuts) * HEADER_BYTES + 2 * 300_000


def test_short_ranges_share_tasks(spark, tmp_path):
    """As many tasks as cores want, not as there are ranges (q56_fasta_index, q92_bam_region); long ranges keep a task each."""
    from pyspark.sql import functions as F
    from strandmill.sources.bgzf import SPLIT_BYTES, file_ranges, spread

    (tmp_path / "x.txt").write_bytes(b"a\n" * 50_000)
    short = spread(file_ranges(spark, str(tmp_path), 100), F.col("end") - F.col("start"))
    assert short.count() == 1000
    assert short.select(F.spark_partition_id()).distinct().count() <= 4 * spark.sparkContext.defaultParallelism


def test_parts_of_lines_grow_with_the_table(spark, tmp_path):
    """Plain gzip parts can't be cut, so a larger table gets more of them (q58_vcf_gzip_cohort, q61_caller_table_scan)."""
    from strandmill.plans import text_queries
    from strandmill.plans.fixture import Genome

    spark.range(2_600_000).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert text_queries._parts(Genome(spark, str(tmp_path))) == 6
