"""Byte offsets of FASTA contigs, and regions read by seeking: no other bytes of a file are touched.

The index is made by byte ranges, many tasks a file. A range owns the lines
whose preceding newline lies in it and streams them, so a contig on one line of
any length is held by no task; what a contig has in several ranges is put
together in order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.errors import guards
from strandmill.sources.bgzf import SPLIT_BYTES, file_ranges, open_at, spread

#: Bytes of a read, and of a header that are kept for its name.
READ_BYTES, HEADER_BYTES = 1 << 20, 4096
PART_DDL = "path string, start long, k int, name string, offset long, bases long, lines long, first_bases long, first_width long, hi long, hi_lines long, last_bases long"


class _Part:
    """What a range has of one contig."""

    def __init__(self, name: str | None, offset: int):
        self.name, self.offset, self.bases, self.lines, self.first, self.hi, self.hi_lines, self.last = name, offset, 0, 0, None, 0, 0, 0

    def add(self, offset: int, bases: int, width: int) -> None:
        if not bases:
            return  # an empty line
        if self.first is None:
            self.first, self.offset = (bases, width), offset
        self.bases, self.lines, self.last = self.bases + bases, self.lines + 1, bases
        if bases > self.hi:
            self.hi, self.hi_lines = bases, 0
        self.hi_lines += bases == self.hi

    def row(self, path: str, start: int, k: int) -> tuple:
        return path, start, k, self.name, self.offset, self.bases, self.lines, *(self.first or (0, 0)), self.hi, self.hi_lines, self.last


def range_parts(f, size: int, start: int, end: int) -> list[_Part]:
    """Parts of the lines that a range owns, in order; the first has no name where a contig goes on."""
    parts, at = [_Part(None, start)], start
    begin = 0 if start == 0 else None  # of the owned line that is open
    bases = width = 0
    head: bytes | None = None

    def close() -> None:
        nonlocal head
        if head is not None:
            parts.append(_Part((head[1:].split() or [b""])[0].decode("utf-8", "replace"), begin + width))
        else:
            parts[-1].add(begin, bases, width)
        head = None

    while at < size:
        # up to the range's end, and then, for the line that goes on, ever more
        data = f.read_at(min(READ_BYTES, size - at, end - at if at < end else max(HEADER_BYTES, at - end)), at)
        here = 0
        while here < len(data):
            if begin is None:
                k = data.find(b"\n", here)
                if k < 0 or at + k >= end:
                    if k >= 0 or at + len(data) >= end:
                        return parts
                    break
                begin, here, bases, width, head = at + k + 1, k + 1, 0, 0, None
                continue
            k = data.find(b"\n", here)
            piece = data[here : k if k >= 0 else len(data)]
            if width == 0 and piece[:1] == b">":
                head = b""
            if head is not None:
                head = (head + piece)[:HEADER_BYTES]
            else:
                bases += len(piece.translate(None, b" \t\r\v\f"))
            width += len(piece) + (k >= 0)
            if k < 0:
                break
            close()
            here = k + 1
            if at + k >= end:
                return parts
            begin, bases, width = at + k + 1, 0, 0
        at += len(data)
    if begin is not None and width:
        close()
    return parts


def byte_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, name, length, offset, line_bases, line_width, even: of each contig; even: all of its lines but the last are as long as the first."""

    def task(batches):
        for batch in batches:
            rows = []
            for uri, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with open_at(uri) as f:
                    rows += [p.row(uri, start, k) for k, p in enumerate(range_parts(f, size, start, end)) if p.name is not None or p.lines]
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 12, types)], [c.split()[0] for c in PART_DDL.split(", ")])

    parts = spread(file_ranges(spark, path, split_bytes), F.col("end") - F.col("start")).mapInArrow(task, PART_DDL)
    order = F.struct("start", "k")
    by = Window.partitionBy("path").orderBy("start", "k")
    parts = parts.withColumn("contig", F.count("name").over(by))
    full = F.when(F.col("lines") > 0, order)
    rows = parts.where("contig > 0").groupBy("path", "contig").agg(
        F.max("name").alias("name"), F.sum("bases").alias("length"), F.coalesce(F.min_by("offset", full), F.min("offset")).alias("offset"), F.coalesce(F.min_by("first_bases", full), F.lit(0)).alias("line_bases"), F.coalesce(F.min_by("first_width", full), F.lit(0)).alias("line_width"),
        F.sum("lines").alias("lines"), F.collect_list(F.struct("hi", "hi_lines")).alias("widest"), F.max_by("last_bases", full).alias("last_bases"),
    )
    same = F.aggregate("widest", F.lit(0).cast("long"), lambda a, x: a + F.when(x["hi"] == F.col("line_bases"), x["hi_lines"]).otherwise(0))
    odd = F.col("lines") - same
    even = (odd == 0) | ((odd == 1) & (F.col("last_bases") < F.col("line_bases")))
    return rows.select("path", "name", F.col("length").cast("long").alias("length"), "offset", F.col("line_bases").cast("int").alias("line_bases"), F.col("line_width").cast("int").alias("line_width"), F.coalesce(even, F.lit(True)).alias("even"))


def place_of(position, offset, line_bases, line_width):
    """Byte of a 1-based position; for columns as for numbers."""
    return offset + (position - 1) // line_bases * line_width + (position - 1) % line_bases


def read_regions(regions: DataFrame, index: DataFrame) -> DataFrame:
    """regions (contig, start, end; 1-based, both included; further columns are kept) with seq, upper case, clipped to the contig. Unknown contigs and contigs of uneven lines are errors."""
    known = index.select(F.col("name").alias("contig"), "path", "length", "offset", "line_bases", "line_width", "even")
    rows = regions.join(known, "contig", "left")
    guards(rows, [(F.col("path").isNull(), "a region's contig is not in the index", "E101"), (~F.col("even"), "a contig has lines of unequal length", "E101")], ["contig", "start", "end"])
    rows = rows.withColumn("_from", F.greatest("start", F.lit(1))).withColumn("_to", F.least("end", "length"))
    kept = regions.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema) + ", seq string"

    def task(batches):
        files = {}
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("path", "offset", "line_bases", "line_width", "_from", "_to")}
            out = []
            for uri, offset, bases, width, lo, hi in zip(*cols.values()):
                if hi is None or lo is None or hi < lo:
                    out.append("")
                    continue
                if uri not in files:
                    files[uri] = open_at(uri)
                first, last = (place_of(p, offset, bases, width) for p in (lo, hi))
                out.append(files[uri].read_at(last - first + 1, first).translate(None, b"\r\n \t").decode().upper())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "seq"])
        for f in files.values():
            f.close()

    return rows.mapInArrow(task, schema)
