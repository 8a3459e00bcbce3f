"""WARC archives: a writer with revisit records, and a splittable reader of gzip-member archives.

Writing: pages are digested once (slim rows), the digest groups are aggregated
to the page that answers (the largest identifier), and each task writes one
archive with one gzip member per record, first under an attempt's own name,
then renamed, so lost or repeated tasks leave whole files only.

Reading: archives are cut into byte ranges. A task scans its range for the gzip
magic, validates each candidate member by inflating its start and parsing the
WARC header, and owns the records whose member starts inside its range, reading
past the end where the last one goes on. After an owned record the scan goes on
at its end, so bytes inside a record are never candidates again. A first
candidate must also be whole (its checksum is read) and be followed by another
member or the end of the file.

Archives are opened through pyarrow.fs by URI, in the shared folder.

Defined results: null html is the empty payload; a null page_id is smaller than
all others; of rows that repeat page_id and payload one is the response, the
others revisit it; null url is written as an empty target; an empty table gives
no archive rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, scratch_path, skew_safe_join, text_bytes

MAGIC = b"\x1f\x8b\x08"
#: Bytes of one range, of one read, and of the start of a member that is inflated to validate it; pages that are broadcast at most.
SPLIT_BYTES, READ_BYTES, PEEK_BYTES, BROADCAST_PAGES = 8 << 20, 1 << 20, 4096, 100_000
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
RECORD_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == record_id(None) else int(urn[len("<urn:page:") : -1])


def make_record(page_id: int | None, url: str | None, payload: bytes, revisit_of: tuple | None) -> bytes:
    """One WARC/1.1 record. revisit_of: None, or a tuple of the page_id of the response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit_of else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit_of else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?=&%#+,;@!$()*[]~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit_of:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisit_of[0])}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and the offset of the block, or None if data doesn't start with a whole WARC header."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    try:
        lines = data[:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        return None
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    return (fields, end + 4) if "WARC-Type" in fields and fields.get("Content-Length", "").isdigit() else None


def read_record(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of an inflated record; digests of responses are checked."""
    fields, at = parse_head(data)
    block = data[at : at + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (payload_digest(payload) != said or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest or length")
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": said, "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To")), "url": unquote(fields["WARC-Target-URI"])}


class _Window:
    """Bytes of a file from a position on, read as needed; what lies before the position is dropped."""

    def __init__(self, f, size: int, at: int):
        self.f, self.size, self.base, self.data = f, size, at, b""

    def fill(self, upto: int) -> bool:
        """Reads until the window reaches upto or the file ends; True if there are bytes at upto - 1."""
        upto = min(upto, self.size)
        while self.base + len(self.data) < upto:
            at = self.base + len(self.data)
            more = self.f.read_at(min(READ_BYTES, self.size - at), at)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, at: int) -> None:
        if at > self.base:
            self.data, self.base = self.data[at - self.base :], at

    def find(self, at: int, end: int) -> int:
        """Position of the first magic in [at, end), or -1."""
        while at < end:
            self.drop(at)
            self.fill(min(at + READ_BYTES, end + len(MAGIC) - 1))
            k = self.data.find(MAGIC, 0, min(len(self.data), end + len(MAGIC) - 1 - self.base))
            if k >= 0:
                return self.base + k
            nxt = self.base + max(1, len(self.data) - len(MAGIC) + 1)
            if self.base + len(self.data) >= min(self.size, end + len(MAGIC) - 1):
                return -1
            at = nxt
        return -1

    def looks_whole(self, at: int) -> bool:
        """The first bytes at this position inflate to a WARC header."""
        self.fill(at + PEEK_BYTES)
        try:
            return zlib.decompressobj(31).decompress(self.data[at - self.base : at - self.base + PEEK_BYTES], 1 << 16).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The member at this position and where it ends; None if it is not one."""
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if pos >= self.size:
                    return None
                self.fill(pos + READ_BYTES)
                part = self.data[pos - self.base : pos - self.base + READ_BYTES]
                out.append(z.decompress(part))
                pos += len(part)
        except zlib.error:
            return None
        return b"".join(out), pos - len(z.unused_data)


def read_range(f, size: int, start: int, end: int):
    """Inflated records whose member starts in [start, end)."""
    w, at, synced = _Window(f, size, start), start, start == 0
    while (at := w.find(at, min(end, size))) >= 0:
        found = w.inflate(at) if w.looks_whole(at) else None
        if found and parse_head(found[0]) and (synced or found[1] >= size or (w.fill(found[1] + len(MAGIC)) and w.data[found[1] - w.base :].startswith(MAGIC))):
            yield found[0]
            at, synced = found[1], True
        else:
            at += 1


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def digest_rows(pages: DataFrame) -> DataFrame:
    """page_id, digest (of the UTF-8 payload), bytes of every page: slim rows, native functions."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return materialize(pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")), "digests")


def decide_types(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to, revisit, k (rows) per distinct page_id and digest: the largest page_id of equal payloads of at least min_bytes answers."""
    one = materialize(digests.groupBy("digest", "page_id", "bytes").agg(F.count(F.lit(1)).alias("k")), "pages")
    groups = one.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("answer"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("rows"))
    groups = materialize(groups.where("rows > 1"), "groups")
    rows = skew_safe_join(one, groups, "digest", "n", total=one.count())
    return rows.select("page_id", "digest", F.col("answer").alias("refers_to"), F.coalesce(~F.col("answer").eqNullSafe(F.col("page_id")) & F.col("n").isNotNull(), F.lit(False)).alias("revisit"), "k")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes the archives under folder (a URI executors can open) and returns path and bytes of each. Pages move once, to meet their type by page_id."""
    types = decide_types(digest_rows(pages), min_bytes)
    fs_, top = _open(folder)
    fs_.create_dir(top, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest"))
    meet = lambda of: own.alias("a").join(of.alias("b"), same).select("a.page_id", "a.url", "a.html", "a.digest", "b.refers_to", "b.revisit")
    # rows that repeat the page_id and payload of an answer are written once with a number: the first answers, wherever they meet
    repeats = materialize(types.where("k > 1 and not revisit"), "repeats")
    n = repeats.count()
    joined = meet(types.where("k = 1 or revisit") if n else types)
    if n:
        rows = materialize(meet(F.broadcast(repeats) if n <= BROADCAST_PAGES else repeats).withColumn("rid", F.monotonically_increasing_id()), "repeated")
        first = rows.groupBy("page_id", "digest").agg(F.min("rid").alias("rid")).select("rid", F.lit(False).alias("again"))
        joined = joined.unionByName(rows.join(first, "rid", "left").withColumn("revisit", F.coalesce("again", F.lit(True))).drop("rid", "again"))

    def task(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, path = _open(folder)
        name, temp = f"{path}/part-{part:06d}.warc.gz", f"{path}/.part-{part:06d}-{attempt}"
        out, size = None, 0
        for batch in batches:
            ids, urls, refers, revisits = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit"))
            for i, html in enumerate(text_bytes(batch.column("html"))):
                out = out or system.open_output_stream(temp)
                data = gzip_member(make_record(ids[i], urls[i], html, (refers[i],) if revisits[i] and min_bytes <= len(html) else None), level)
                out.write(data)
                size += len(data)
        if out:
            out.close()
            system.move(temp, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{os.path.basename(name)}"], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return materialize(joined.mapInArrow(task, "path string, bytes long"), "archives")


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in files (path, bytes), read by byte ranges: RECORD_DDL."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start"))
    spread = ranges.repartition(max(1, min(100_000, ranges.count())))

    def task(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                system, at = _open(path)
                with system.open_input_file(at) as f:
                    rows = []
                    for data in read_range(f, size, start, start + split_bytes):
                        rows.append(read_record(data))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    return spread.mapInArrow(task, RECORD_DDL)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    spark: SparkSession = pages.sparkSession
    return read_archives(write_archives(pages, scratch_path(spark, "warc"), min_bytes), split_bytes)
