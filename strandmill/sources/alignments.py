"""Aligned reads from SAM text or BAM files: read_id, qname, flag, contig, start, mapq, cigar, seq, qual.

BAM files are read in ranges, many tasks a file. A whole file is cut at any
byte: a task finds the first block of its range, then the first record in it,
which must head a chain of records that make sense. A region is read through
the file's index: only the ranges that it names are opened, and they start at
records.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.errors import EngineError
from strandmill.scratch import materialize
from strandmill.sources.bam_index import CHUNK_DDL, LINEAR_BITS, bin_of, load_index, region_chunks, write_indexes
from strandmill.sources.bgzf import SPLIT_BYTES, BlockFile, GzipStream, block_size, file_ranges, open_at, spread

READ_DDL = "read_id long, qname string, flag int, contig string, start long, mapq int, cigar string, seq string, qual string"
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
#: Compressed bytes of a range of virtual offsets, as SQL.
BYTES = "shiftright(hi, 16) - shiftright(lo, 16)"
#: Two bases of each byte, and the text of each quality.
PAIRS = [BASES[x >> 4] + BASES[x & 15] for x in range(256)]
SCORES = bytes((x + 33) & 255 for x in range(256))
#: Records that must follow from a place for it to be taken for a record's start.
CHAIN = 8
#: Bytes of the first read of a file, and of a read within a long range.
HEAD_BYTES, MOST_READ = 1 << 14, 4 << 20
#: Tasks a core at least, if there are ranges enough: a byte of records costs more than one of text, and how much differs by range.
RECORD_TASKS = 8
RANGE_DDL = "path string, size long, lo long, hi long, exact boolean"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("read_id"))
    f = lambda i: F.get("f", F.lit(i))
    mapq = f(4).cast("int")
    out = rows.select("read_id", F.nullif(f(0), F.lit("*")).alias("qname"), f(1).cast("int").alias("flag"), f(2).alias("contig"), f(3).cast("long").alias("start"), F.when(mapq == 255, None).otherwise(mapq).alias("mapq"), f(5).alias("cigar"), f(9).alias("seq"), F.nullif(f(10), F.lit("*")).alias("qual"))
    return out.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("cigar") != "*"))


class Records:
    """Records of a block-compressed file from a virtual offset on, with their own offsets."""

    def __init__(self, blocks: BlockFile, offset: int = 0):
        self.blocks, self.next, self.data, self.at = blocks, offset >> 16, b"", 0
        self._more()
        self.at = offset & 0xFFFF

    def _more(self) -> bool:
        if self.next >= self.blocks.size:
            return False
        self.place = self.next
        self.data, self.next = self.blocks.block(self.next)
        self.at = 0
        return True

    def tell(self) -> int:
        while self.at >= len(self.data) and self._more():
            pass
        return self.place << 16 | self.at if self.at < len(self.data) else self.blocks.size << 16

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None at the end."""
        parts, have = [], 0
        while have < n:
            if self.at >= len(self.data) and not self._more():
                if have:
                    raise ValueError("BAM file ends within a record")
                return None
            piece = self.data[self.at : self.at + n - have]
            self.at += len(piece)
            have += len(piece)
            parts.append(piece)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def int(self) -> int:
        raw = self.take(4)
        if raw is None:
            raise ValueError("BAM file ends within its header")
        return struct.unpack("<i", raw)[0]

    def header(self) -> list[tuple[str, int]]:
        """Contigs and their lengths; the records follow."""
        if self.take(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        self.take(self.int())
        return [(self.take(self.int())[:-1].decode(), self.int()) for _ in range(self.int())]

    def records(self, until: int):
        """(offset, offset behind, bytes) of the records that start before a virtual offset."""
        here = self.tell()
        while here < until and (raw := self.take(4)) is not None:
            data = self.take(struct.unpack("<i", raw)[0])
            behind = self.tell()
            yield here, behind, data
            here = behind


def _record_end(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record at a place ends, if what stands there can be a record; -1 if too little of it is there to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, lname, _, _, ncigar, _, lseq, nref, npos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fits = lambda r, p: -1 <= r < len(lengths) and -1 <= p and (r < 0 or p < lengths[r])
    if size < 32 or lname < 1 or lseq < 0 or not fits(ref, pos) or not fits(nref, npos) or size < 32 + lname + 4 * ncigar + (lseq + 1) // 2 + lseq:
        return None
    name = data[at + 36 : at + 36 + lname]
    if len(name) < lname:
        return -1
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    cigar = data[at + 36 + lname : at + 36 + lname + 4 * ncigar]
    if any(x & 15 > 8 for x in cigar[::4]):
        return None
    return at + 4 + size


def find_record(blocks: BlockFile, start: int, end: int, lengths: list[int]) -> int | None:
    """Virtual offset of the first record that starts in a block of [start, end): the first place from which a chain of CHAIN records, or records up to the file's end, makes sense."""
    place = blocks.find_block(start)
    while place is not None and place < min(end, blocks.size):
        first, following = blocks.block(place)
        data, more = first, following
        for at in range(len(first)):
            here, chain = at, 0
            while chain < CHAIN:
                if here == len(data) and more >= blocks.size:
                    break
                step = _record_end(data, here, lengths)
                if step is None:
                    chain = -1
                    break
                if step < 0 or step > len(data):
                    if more >= blocks.size:
                        chain = -1 if step < 0 or step > len(data) else chain
                        break
                    piece, more = blocks.block(more)
                    data += piece
                    continue
                here, chain = step, chain + 1
            if chain > 0:
                return place << 16 | at
        place = following
    return None


def parse_record(data: bytes, names: list[str]):
    """A mapped record (READ_DDL without the identifier); None for others."""
    ref, pos, lname, mapq, _, ncigar, flag, lseq = struct.unpack_from("<iiBBHHHi", data)
    p = 32
    name = data[p : p + lname - 1].decode()
    p += lname
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ncigar}I", data, p))
    if ref < 0 or flag & 4 or not cigar:
        return None
    p += 4 * ncigar
    seq = "".join(map(PAIRS.__getitem__, data[p : p + (lseq + 1) // 2]))[:lseq]
    q = data[p + (lseq + 1) // 2 : p + (lseq + 1) // 2 + lseq]
    qual = None if not lseq or q[:1] == b"\xff" else q.translate(SCORES).decode("latin-1")
    return None if name == "*" else name, flag, names[ref], pos + 1, None if mapq == 255 else mapq, cigar, seq, qual


def record_span(data: bytes) -> tuple[int, int, int]:
    """Contig number, start and end (0-based, end behind) of a record on the reference."""
    ref, pos, lname, _, _, ncigar, flag, _ = struct.unpack_from("<iiBBHHHi", data)
    ops = struct.unpack_from(f"<{ncigar}I", data, 32 + lname)
    covered = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))
    return ref, pos, pos + (covered if covered and not flag & 4 else 1)


def open_records(uri: str, size: int, lo: int, hi: int, exact: bool):
    """The open file, its contigs, and the records that start in [lo, hi) (virtual offsets). exact: a record starts at lo."""
    f = open_at(uri)
    blocks = BlockFile(f, size, HEAD_BYTES)
    if size and block_size(blocks.bytes_at(0, 18)) is None:  # plain gzip can't be cut: the first range has it all
        own = Records(GzipStream(f))
        return blocks, own.header(), own.records(1 << 62) if lo == 0 else iter(())
    own = Records(blocks)
    contigs = own.header()
    first = own.tell()
    blocks.step = max(HEAD_BYTES, min(MOST_READ, (hi >> 16) - (lo >> 16)))
    if not exact:
        found = first if lo <= first else find_record(blocks, lo >> 16, hi + 0xFFFF >> 16, [n for _, n in contigs])
        lo = hi if found is None else max(found, first)
    return blocks, contigs, Records(blocks, lo).records(hi) if lo < hi else iter(())


def whole_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RANGE_DDL over whole files."""
    shift = lambda c: F.shiftleft(F.col(c), 16)
    return file_ranges(spark, path, split_bytes, "*.bam").select("path", "size", shift("start").alias("lo"), shift("end").alias("hi"), F.lit(False).alias("exact"))


def region_ranges(spark: SparkSession, path: str, region: tuple[str, int, int], split_bytes: int = SPLIT_BYTES, indexed: bool = True) -> DataFrame:
    """RANGE_DDL of what the files' indexes name for a region (1-based, both ends included). A stale or foreign index is an error, and, if indexed, so is a missing one; else such a file is read whole.

    The header and the index of a file are read by one task; long ranges are cut
    at any byte again.
    """
    contig, start, end = region
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path", F.col("length").alias("size"))

    def plan(batches):
        for batch in batches:
            rows = []
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_at(uri) as f:
                    try:
                        names = [c for c, _ in Records(BlockFile(f, size)).header()]
                    except (ValueError, zlib.error) as e:
                        rows.append((uri, size, 0, 0, True, f"can't be read: {e}"))
                        continue
                entries, problem = load_index(uri, len(names))
                if contig not in names:
                    problem = f"has no contig {contig}"
                whole = problem == "has no index" and not indexed and contig in names
                if problem and not whole:
                    rows.append((uri, size, 0, 0, True, problem))
                    continue
                for lo, hi in [(0, size << 16)] if whole else region_chunks(entries[names.index(contig)], start - 1, end):
                    exact = not whole
                    while (hi >> 16) - (lo >> 16) > split_bytes:
                        cut = (lo >> 16) + split_bytes << 16
                        rows.append((uri, size, lo, cut, exact, None))
                        lo, exact = cut, False
                    rows.append((uri, size, lo, hi, exact, None))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "size", "lo", "hi", "exact", "problem"), r)) for r in rows], pa.schema([("path", pa.string()), ("size", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("exact", pa.bool_()), ("problem", pa.string())]))

    planned = materialize(spread(files).mapInArrow(plan, RANGE_DDL + ", problem string"), "ranges")
    for bad in planned.where("problem is not null").limit(5).collect():
        raise EngineError(f"alignments can't be read by region: {bad.path} {bad.problem}", "E105", path=bad.path)
    return planned.drop("problem")


def read_bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, split_bytes: int = SPLIT_BYTES, indexed: bool = False) -> DataFrame:
    """Mapped records of BAM files, read in ranges of split_bytes; short ranges share tasks.

    region: contig, start, end (1-based, both included): records that overlap it,
    found through the files' indexes. indexed: a file without one is an error
    (else it is read whole); a stale one always is.
    """
    ranges = region_ranges(spark, path, region, split_bytes, indexed) if region else whole_ranges(spark, path, split_bytes)
    schema = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def task(batches):
        rows = []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                _, contigs, found = open_records(*r)
                names = [c for c, _ in contigs]
                for _, _, data in found:
                    if region:
                        ref, lo, hi = record_span(data)
                        if ref < 0 or names[ref] != region[0] or lo >= region[2] or hi < region[1]:
                            continue
                    record = parse_record(data, names)
                    if record:
                        rows.append(record)
                    if len(rows) == 5000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    out = spread(ranges, F.expr(BYTES), RECORD_TASKS).mapInArrow(task, READ_DDL.split(", ", 1)[1]).withColumn("read_id", F.monotonically_increasing_id())
    return out.select(*(c.split()[0] for c in READ_DDL.split(", ")))


def write_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> int:
    """Writes an index beside each coordinate-sorted BAM file under a path; returns how many. Ranges are scanned by tasks, and a file's index, which is small, is put together by one."""

    def scan(batches):
        for batch in batches:
            for uri, size, lo, hi, exact in zip(*(batch.column(i).to_pylist() for i in range(5))):
                _, contigs, found = open_records(uri, size, lo, hi, exact)
                rows, windows, last, before = [(uri, 2, 0, 0, len(contigs), 0)], {}, None, None
                for here, behind, data in found:
                    ref, start, end = record_span(data)
                    if ref < 0:
                        continue
                    if before is not None and (ref, start) < before:
                        raise ValueError(f"{uri} isn't sorted by coordinate")
                    before = (ref, start)
                    for w in range(start >> LINEAR_BITS, (end - 1 >> LINEAR_BITS) + 1):
                        windows.setdefault((ref, w), here)
                    key = (ref, bin_of(start, end))
                    if last and last[0] == key and last[2] == here:
                        last = (key, last[1], behind)
                    else:
                        if last:
                            rows.append((uri, 0, *last[0], last[1], last[2]))
                        last = (key, here, behind)
                if last:
                    rows.append((uri, 0, *last[0], last[1], last[2]))
                rows += [(uri, 1, ref, w, v, 0) for (ref, w), v in windows.items()]
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in CHUNK_DDL.split(", ")])

    rows = spread(whole_ranges(spark, path, split_bytes), F.expr(BYTES)).mapInArrow(scan, CHUNK_DDL)
    files = rows.repartition("path").sortWithinPartitions("path", F.desc("kind"), "contig", "at", "lo").mapInArrow(write_indexes, "path string, chunks long")
    return materialize(files, "indexes").count()


def index_bins(spark: SparkSession, path: str) -> DataFrame:
    """path, contig, bin, chunks, bytes: what the indexes of the BAM files under a path hold; bytes is the compressed span of a bin's chunks."""

    def task(batches):
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_at(uri) as f:
                    names = [c for c, _ in Records(BlockFile(f, size)).header()]
                rows = [(uri, names[k], b, len(v), sum((z >> 16) - (a >> 16) for a, z in v)) for k, (bins, _) in enumerate(load_index(uri, len(names))[0]) for b, v in bins.items()]
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["path", "contig", "bin", "chunks", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path", F.col("length").alias("size"))
    return spread(files).mapInArrow(task, "path string, contig string, bin int, chunks int, bytes long")


def _index_problem(uri: str, contigs: int, indexed: bool) -> str | None:
    problem = load_index(uri, contigs)[1]
    return None if problem == "has no index" and not indexed else problem


def check_bam(spark: SparkSession, path: str, indexed: bool = False) -> list[str]:
    """Pre-flight over all BAM files under a path: contigs of their headers. A missing or unreadable file is an error, and, if indexed, so is a missing or stale index."""

    def look(batches):
        for batch in batches:
            rows = []
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, problem = [], None
                with open_at(uri) as f:
                    try:
                        names = [c for c, _ in Records(BlockFile(f, size)).header()]
                    except (ValueError, zlib.error, struct.error) as e:
                        problem = f"can't be read: {e}"
                rows.append({"path": uri, "names": names, "problem": problem or _index_problem(uri, len(names), indexed)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("names", pa.list_(pa.string())), ("problem", pa.string())]))

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path", F.col("length").alias("size"))
        seen = materialize(spread(files).mapInArrow(look, "path string, names array<string>, problem string"), "headers")
    except Exception as e:
        raise EngineError("alignments can't be read", "E105", path=path) from e
    for bad in seen.where("problem is not null").limit(5).collect():
        raise EngineError(f"alignments can't be read: {bad.path} {bad.problem}", "E105", path=bad.path)
    if seen.isEmpty():
        raise EngineError("there are no alignments", "E105", path=path)
    place = seen.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    return [r.name for r in place.orderBy("at", "name").collect()]
