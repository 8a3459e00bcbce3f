"""Block-compressed output: parts whose concatenation is one file, for text and for alignments."""

from __future__ import annotations

import os
import struct
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.sources.alignments import BASES, OPS

#: Fixed value: the empty block that ends a file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Fixed value: hexadecimal digits of the numbers below 16.
DIGITS = b"0123456789abcdef" + bytes(240)
#: Inflated bytes of a block.
BLOCK = 65_280


def block(data: bytes, level: int = 6) -> bytes:
    """One block: a gzip member that states its own size."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[s : s + BLOCK]) for s in range(0, len(data), BLOCK))


def _write_parts(rows: DataFrame, path: str, encode, suffix: str) -> DataFrame:
    """Each task writes one file under its attempt's name and renames it when whole; returns file, rows."""
    schema = pa.schema([("file", pa.string()), ("rows", pa.int64())])

    def task(batches):
        ctx = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        name = f"part-{ctx.partitionId():05d}{suffix}"
        tmp, n = f"{folder}/.{name}.{ctx.taskAttemptId()}", 0
        with system.open_output_stream(tmp, compression=None) as f:
            for piece, k in encode(batches):
                f.write(piece)
                n += k
        system.move(tmp, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), pa.array([n])], schema=schema)

    return rows.mapInArrow(task, "file string, rows long")


def write_block_text(lines: DataFrame, path: str) -> int:
    """Lines (column value, in the order of their partitions) as block-compressed parts; returns how many. Parts in order of name make one file."""

    def encode(batches):
        held, n = b"", 0
        for batch in batches:
            for x in batch.column("value").to_pylist():
                held += (x or "").encode() + b"\n"
                n += 1
                if len(held) >= BLOCK:
                    yield block(held[:BLOCK]), n
                    held, n = held[BLOCK:], 0
        yield blocks(held) + EOF, n

    return _write_parts(lines.select("value"), path, encode, ".gz").agg(F.sum("rows")).first()[0] or 0


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]]) -> int:
    """Aligned reads (columns of the sources) as BAM parts, each with the header and its partition's records; returns how many records."""
    place = {c: i for i, (c, _) in enumerate(contigs)}
    text = b"@HD\tVN:1.6\n" + b"".join(f"@SQ\tSN:{c}\tLN:{n}\n".encode() for c, n in contigs)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)
    code = bytes(BASES.find(chr(i)) if chr(i) in BASES else 15 for i in range(256))  # of each base
    score = bytes((i - 33) & 255 for i in range(256))

    def record(q, flag, contig, start, mapq, cigar, seq, qual) -> bytes:
        ops, n = [], ""
        for x in cigar:
            if x.isdigit():
                n += x
            else:
                ops.append(int(n) << 4 | OPS.index(x))
                n = ""
        name, seq = (q or "*").encode() + b"\0", seq or ""
        # a hexadecimal digit a base, so two bases make a byte
        packed = bytes.fromhex((seq.encode("latin-1", "replace").translate(code) + b"\0" * (len(seq) % 2)).translate(DIGITS).decode())
        if qual and min(qual) < "!":
            raise ValueError(f"quality text of {q} isn't printable")
        scores = qual.encode("latin-1").translate(score) if qual else b"\xff" * len(seq)
        body = struct.pack("<iiBBHHHiiii", place[contig], start - 1, len(name), 255 if mapq is None else mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *ops) + packed + scores
        return struct.pack("<i", len(body)) + body

    def encode(batches):
        held, n = head, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                held += record(*row)
                n += 1
                if len(held) >= BLOCK:
                    yield block(held[:BLOCK]), n
                    held, n = held[BLOCK:], 0
        yield blocks(held) + EOF, n

    return _write_parts(reads.select(*COLUMNS), path, encode, ".bam").agg(F.sum("rows")).first()[0] or 0


COLUMNS = ["qname", "flag", "contig", "start", "mapq", "cigar", "seq", "qual"]
