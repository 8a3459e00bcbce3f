"""Byte ranges of block-compressed files (gzip members that state their size), each read by a task of its own.

A range owns what starts in its blocks: a line belongs to the range that holds
the newline before it, a record to the range that holds its first byte. A task
finds the first block at or after its range's start, and reads past its end
until what it owns is whole. Nothing else of the file is read. Files are opened
through pyarrow.fs by URI, so they may lie in any store that it and Spark reach.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes of a range, of a read, and the most that a block can have.
SPLIT_BYTES, READ_BYTES, MOST_BLOCK = 64 << 20, 1 << 18, 1 << 16
#: Tasks at most, whatever the number of ranges.
MOST_TASKS = 50_000


def block_size(head: bytes) -> int | None:
    """Bytes of the block that starts with head (BSIZE of the BC field), None for a member without it."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class BlockFile:
    """An open file of blocks, read through a window; bytes_read says how much was asked of the store."""

    def __init__(self, f, size: int, read_bytes: int = READ_BYTES):
        self.f, self.size, self.step = f, size, read_bytes
        self.base, self.window, self.bytes_read = 0, b"", 0

    def bytes_at(self, at: int, n: int) -> bytes:
        """n bytes at a place, fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if at < self.base or at + n > self.base + len(self.window):
            have = self.window[at - self.base :] if self.base <= at < self.base + len(self.window) else b""
            more = self.f.read_at(min(max(n - len(have), self.step), self.size - at - len(have)), at + len(have))
            self.bytes_read += len(more)
            self.base, self.window = at, have + more
        return self.window[at - self.base : at - self.base + n]

    def block(self, at: int) -> tuple[bytes, int]:
        """Inflated bytes of the block at a place, and the place of the next one."""
        size = block_size(self.bytes_at(at, 18))
        if size is None:
            raise ValueError(f"no block starts at byte {at}")
        return zlib.decompress(self.bytes_at(at, size), 31), at + size

    def is_block(self, at: int) -> bool:
        """Whether a block starts here that inflates to its checksum and is followed by another one or the file's end."""
        size = block_size(self.bytes_at(at, 18))
        if size is None or at + size > self.size:
            return False
        if at + size < self.size and block_size(self.bytes_at(at + size, 18)) is None:
            return False
        try:
            zlib.decompress(self.bytes_at(at, size), 31)
        except zlib.error:
            return False
        return True

    def find_block(self, at: int) -> int | None:
        """Place of the first block at or after a place; None at the end."""
        if at == 0:
            return 0 if self.size else None
        while at < self.size:
            raw = self.bytes_at(at, MOST_BLOCK + 18)
            k = raw.find(b"\x1f\x8b\x08\x04")
            while k >= 0:
                if self.is_block(at + k):
                    return at + k
                k = raw.find(b"\x1f\x8b\x08\x04", k + 1)
            at += max(1, len(raw) - 3)
        return None


class GzipStream:
    """A gzip file without block sizes under the same interface: its places are ordinals, and it can only be read from 0 on."""

    def __init__(self, f):
        f.seek(0)
        self.bytes_read, self.pieces = 0, self._pieces(f)
        self.held = next(self.pieces, None)
        self.size = 0 if self.held is None else 1 << 40

    def _pieces(self, f):
        z, data = zlib.decompressobj(31), f.read(READ_BYTES)
        while data:
            self.bytes_read += len(data)
            if out := z.decompress(data):
                yield out
            data, z = (z.unused_data, zlib.decompressobj(31)) if z.eof else (b"", z)
            data = data or f.read(READ_BYTES)

    def block(self, at: int) -> tuple[bytes, int]:
        data, self.held = self.held, next(self.pieces, None)
        if self.held is None:
            self.size = at + 1
        return data, at + 1

    def find_block(self, at: int) -> int | None:
        return at if at < self.size else None


def owned_lines(blocks: BlockFile, start: int, end: int):
    """Lists of whole lines (bytes) whose preceding newline, or the file's start, lies in a block of [start, end)."""
    at, held = blocks.find_block(start), [] if start == 0 else None
    while at is not None and at < blocks.size:
        beyond = at >= end
        if beyond and held is None:
            return
        data, at = blocks.block(at)
        first, *rest = data.split(b"\n")
        if held is not None:
            held.append(first)
            if rest:
                yield [b"".join(held)]
        if rest:
            if beyond:
                return
            if len(rest) > 1:
                yield rest[:-1]
            held = [rest[-1]]
    if held and (last := b"".join(held)):
        yield [last]


def file_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, pattern: str | None = None) -> DataFrame:
    """path, size, start, end: ranges of the files under a path, from their metadata alone."""
    files = spark.read.format("binaryFile").options(**({"pathGlobFilter": pattern} if pattern else {})).load(path).select("path", F.col("length").alias("size"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    return files.withColumn("start", start).withColumn("end", F.least(F.col("start") + split_bytes, "size"))


def spread(ranges: DataFrame, length: Column | None = None, per_core: int = 4) -> DataFrame:
    """A task a range; with the length of each, short ranges share tasks of SPLIT_BYTES, or per_core tasks a core if those are more, so that a task's own cost isn't paid for each."""
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if length is None else length), F.lit(0))).first()
    if length is not None:
        n = min(n, max(per_core * ranges.sparkSession.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES)))
    return ranges.repartition(max(1, min(n, MOST_TASKS)))


def open_at(uri: str):
    system, at = fs.FileSystem.from_uri(uri)
    return system.open_input_file(at)


def read_block_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """value: lines of block-compressed text, many tasks a file. A gzip file without block sizes can't be cut and is one task's."""

    def task(batches):
        for batch in batches:
            for uri, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with open_at(uri) as f:
                    blocks = BlockFile(f, size)
                    cut = block_size(blocks.bytes_at(0, 18)) is not None
                    if not cut and start:
                        continue
                    for lines in owned_lines(blocks, start, end) if cut else owned_lines(GzipStream(f), 0, size + 1):
                        yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode() for x in lines], pa.string())], ["value"])

    return spread(file_ranges(spark, path, split_bytes), F.col("end") - F.col("start")).mapInArrow(task, "value string")
