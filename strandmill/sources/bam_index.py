"""Bin and linear indexes of coordinate-sorted alignment files: built by Spark, read to plan the ranges of a region.

A virtual offset is the place of a block in the file, shifted by 16 bits, plus a
place in its inflated bytes.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyarrow import fs

#: First bin of each level and its bits, from the finest on; bits of a linear window; first bytes of an index.
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
LINEAR_BITS, MAGIC = 14, b"BAI\1"
#: Compressed bytes between two chunks that are read through rather than opened anew.
NEAR = 1 << 15


def bin_of(start: int, end: int) -> int:
    """Smallest bin that holds [start, end), 0-based."""
    return next(first + (start >> bits) for first, bits in LEVELS if start >> bits == max(start, end - 1) >> bits)


def bins_over(start: int, end: int) -> set[int]:
    """All bins that may hold records over [start, end)."""
    return {b for first, bits in LEVELS for b in range(first + (start >> bits), first + (max(start, end - 1) >> bits) + 1)}


def pack_index(contigs: int, chunks: dict, linear: dict) -> bytes:
    """Bytes of an index. chunks: (contig, bin) to [(from, to)]; linear: (contig, window) to the smallest offset over it."""
    out = [MAGIC, struct.pack("<i", contigs)]
    for c in range(contigs):
        own = sorted((b, v) for (k, b), v in chunks.items() if k == c)
        out.append(struct.pack("<i", len(own)))
        for b, v in own:
            out.append(struct.pack("<Ii", b, len(v)) + b"".join(struct.pack("<QQ", *x) for x in sorted(v)))
        windows = {w: v for (k, w), v in linear.items() if k == c}
        top, last = max(windows, default=-1) + 1, 0
        out.append(struct.pack("<i", top))
        for w in range(top):
            last = windows.get(w, last)
            out.append(struct.pack("<Q", last))
    return b"".join(out)


def unpack_index(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Per contig: its bins' chunks and its linear offsets."""
    if data[:4] != MAGIC:
        raise ValueError("not an alignment index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins = {}
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            b, k = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            bins[b] = list(zip(flat[::2], flat[1::2]))
            at += 8 + 16 * k
        (n,) = struct.unpack_from("<i", data, at)
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def region_chunks(entry: tuple[dict, list], start: int, end: int) -> list[tuple[int, int]]:
    """Merged virtual ranges that hold every record over [start, end) of a contig. What ends before the first record over the start's window, or begins behind the region, can't."""
    bins, linear = entry
    window = start >> LINEAR_BITS
    floor = linear[min(window, len(linear) - 1)] if linear else 0
    if window >= len(linear):
        floor = 0
    # the first record that lies in a finest bin behind the region: none of the region's follow it
    behind = min((b for b in bins if b > LEVELS[0][0] + (max(start, end - 1) >> LINEAR_BITS)), default=None)
    ceiling = bins[behind][0][0] if behind is not None else 1 << 63
    found = sorted((max(a, floor), min(z, ceiling)) for b in bins_over(start, end) for a, z in bins.get(b, []) if z > floor and a < ceiling)
    out: list[tuple[int, int]] = []
    for a, z in found:
        if out and (a >> 16) - (out[-1][1] >> 16) <= NEAR:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def index_path(uri: str) -> str | None:
    """The index beside a file: name.bam.bai or name.bai."""
    system, at = fs.FileSystem.from_uri(uri)
    for name, as_uri in ((at + ".bai", uri + ".bai"), (at.removesuffix(".bam") + ".bai", uri.removesuffix(".bam") + ".bai")):
        if system.get_file_info(name).type == fs.FileType.File:
            return as_uri
    return None


def load_index(uri: str, contigs: int) -> tuple[list, str | None]:
    """The index of a file, and what is wrong with it: absent, unreadable, older than the file, or of another file."""
    at = index_path(uri)
    if at is None:
        return [], "has no index"
    system, own = fs.FileSystem.from_uri(uri)
    other, index = fs.FileSystem.from_uri(at)
    file, table = system.get_file_info(own), other.get_file_info(index)
    if file.mtime and table.mtime and table.mtime < file.mtime:
        return [], "is newer than its index"
    with other.open_input_file(index) as f:
        try:
            entries = unpack_index(f.read())
        except (ValueError, struct.error):
            return [], "has an unreadable index"
    last = max((z >> 16 for bins, _ in entries for v in bins.values() for _, z in v), default=0)
    if len(entries) != contigs or last > file.size:
        return [], "has an index of another file"
    return entries, None


CHUNK_DDL = "path string, kind int, contig int, at int, lo long, hi long"


def write_indexes(batches):
    """Rows of CHUNK_DDL, files one after the other (kind 0: chunk of a bin; 1: linear offset; 2: number of contigs, in lo), to an index beside each file."""

    def save(path, contigs, chunks, linear):
        system, at = fs.FileSystem.from_uri(path)
        with system.open_output_stream(f"{at}.bai", compression=None) as f:
            f.write(pack_index(contigs, chunks, linear))
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sum(map(len, chunks.values()))], pa.int64())], ["path", "chunks"])

    path, contigs, chunks, linear = None, 0, {}, {}
    for batch in batches:
        for p, kind, contig, at, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if p != path:
                if path is not None:
                    yield save(path, contigs, chunks, linear)
                path, chunks, linear = p, {}, {}
            if kind == 2:
                contigs = lo
            elif kind == 1:
                linear[contig, at] = min(lo, linear.get((contig, at), lo))
            else:
                own = chunks.setdefault((contig, at), [])
                if own and own[-1][1] >= lo:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
    if path is not None:
        yield save(path, contigs, chunks, linear)
