"""Removal of repeated passages by longest-previous-factor arrays over suffixes that Spark deals to groups.

A suffix has an earlier match if, in suffix order, the nearest suffix before or
behind it that starts at a smaller place shares at least `length` bytes with it:
in an order by the first `length` bytes and then by place, the neighbour before
(the previous smaller position). Later matches go and their first occurrence
stays; with keep_first=False the matched first occurrence goes too.

One suffix order of a corpus can't be held anywhere, so suffixes are dealt to
groups in which all matches of a suffix meet. Each window of `length` bytes
names its smallest hashed k-gram; equal windows name the same gram at the same
place. Consecutive windows with one such gram form a stretch. A corpus has about
one stretch for each (length - k) / 2 bytes, and only those whose gram occurs
twice can hold a match:

* grams are counted; a bitmap of bounded size sorts out the stretches of most
  unique grams before anything else is moved (what slips through is dropped by
  the exact counts);
* stretches that are the same bytes are one suffix group by themselves: the
  first occurrence stands for all;
* different stretches of a gram are read from their texts, and tasks build
  suffix arrays over blocks of whole groups;
* a gram that more than MOST_STRETCHES different stretches share (a common line
  in many contexts) is not held in one group: its stretches are cut anew by
  longer grams, at last by the window itself, when a group is one string.

Defined results: null text is empty; texts below `length` bytes keep all; a null
doc_id comes before all others; rows that agree in doc_id and text are each
other's copies, and share their answer (with keep_first both stay, if they are
the first); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import map_batches, materialize, skew_safe_join, text_bytes, text_key
from strandmill.llm.hashing import RunHash, bitmap_of, in_bitmap, mix

#: Windows of a text that are scanned at once, bytes of texts that are scanned end to end, anchors held in a task before they are counted, bytes of a suffix array.
SEGMENT, PACK, HELD, ARRAY_BYTES = 1 << 19, 1 << 16, 1 << 20, 1 << 20
#: Different stretches of one gram that meet in a task; rows of a table that is broadcast, and of the items in it.
MOST_STRETCHES, SENT_ROWS, SENT_ITEMS = 2048, 500_000, 2_000_000
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
STRETCH_DDL = "doc_id long, th long, h long, f long, s int, c int"


def gram_lengths(length: int) -> list[int]:
    """Grams of the levels: a third of the window, three quarters of it, all of it."""
    return sorted({max(1, length // 3), max(1, length * 3 // 4), length})


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima of blocks of w."""
    if w == 1:
        return x
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def stretches(parts: list, length: int, k: int, hashes: RunHash):
    """Per run of windows with one smallest gram, over byte arrays laid end to end: hash of the gram, first window, number of windows; and the prefix sums.

    A part holds at least length bytes, all of them less than 2^20; no window spans two parts.
    """
    data = np.concatenate(parts) if len(parts) > 1 else parts[0]
    sums = hashes.sums(data)
    h = hashes.grams(sums, k)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)
    at = (_window_minima((h & ~low) | place, length - k + 1) & low).astype(np.int64)
    windows = None
    if len(parts) > 1:
        whole, end = np.ones(len(at), bool), 0
        for part in parts[:-1]:
            end += len(part)
            whole[end - length + 1 : end] = False
        windows = np.flatnonzero(whole)
        at = at[windows]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], first if windows is None else windows[first], np.diff(np.append(first, len(at))), sums


def _segments(text: bytes, length: int):
    """(place, bytes) of parts of a text that hold each of its windows once."""
    for at in range(0, len(text) - length + 1, SEGMENT):
        yield at, np.frombuffer(text, np.uint8, min(len(text) - at, SEGMENT + length - 1), at)


def _packs(pieces):
    """Lists of (owner, place, bytes) to be scanned end to end: of PACK bytes at most, or one piece."""
    held, size = [], 0
    for piece in pieces:
        if held and size + len(piece[2]) > PACK:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


def _gram_counts(length: int, k: int):
    def task(batches):
        hashes, held, size = RunHash(BASE), [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for pack in _packs((0, at, data) for text in text_bytes(batch.column(0)) for at, data in _segments(text or b"", length)):
                held.append(stretches([data for _, _, data in pack], length, k, hashes)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return task


def _stretches_of(pieces, doc_id: pa.Array, th: pa.Array, length: int, k: int, hashes: tuple[RunHash, RunHash], passes, salts: np.ndarray | None = None):
    """Batches of the stretches of pieces (owner, place, bytes) whose grams pass; doc_id, th and salts are those of the owners. Under a salt, grams of different parents differ."""
    for pack in _packs(pieces):
        parts = [data for _, _, data in pack]
        h, first, count, sums = stretches(parts, length, k, hashes[0])
        size = np.array([len(x) for x in parts])
        base = np.cumsum(size) - size
        part = np.searchsorted(base, first, "right") - 1
        owner = np.array([x[0] for x in pack])[part]
        if salts is not None:
            h = mix(h + salts[owner])
        on = np.flatnonzero(passes(h))
        if not len(on):
            continue
        h, first, count, part, owner = h[on], first[on], count[on], part[on], owner[on]
        s = first - base[part] + np.array([x[1] for x in pack])[part]
        # a stretch is told from others of its gram by the hashes of its bytes under two bases
        end = first + count + (length - 1)
        f = mix(hashes[0].runs(sums, first, end) * np.uint64(SECOND_BASE) + hashes[1].runs(hashes[1].sums(np.concatenate(parts)), first, end))
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays([doc_id.take(take), th.take(take), pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(count.astype(np.int32))], ["doc_id", "th", "h", "f", "s", "c"])


def _hashes() -> tuple[RunHash, RunHash]:
    return RunHash(BASE), RunHash(SECOND_BASE)


def _repeated_stretches(length: int, k: int, sent, bits: int):
    def task(batches):
        hashes, bitmap = _hashes(), sent.value
        for batch in batches:
            pieces = ((i, at, data) for i, text in enumerate(text_bytes(batch.column(2))) for at, data in _segments(text or b"", length))
            yield from _stretches_of(pieces, batch.column(0), batch.column(1), length, k, hashes, lambda h: in_bitmap(h, bitmap, bits))

    return task


def _dense(key: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of less than 2^bits keys below 2^(2 * bits): a key is sorted with its place in one word, if they fit."""
    if 3 * bits <= 64:
        key = key << np.uint64(bits)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        place = (key & np.uint64((1 << bits) - 1)).astype(np.uint32)
        key >>= np.uint64(bits)
    else:
        place = np.argsort(key)
        key = key[place]
    new = np.zeros(len(key), np.uint32)
    np.cumsum(key[1:] != key[:-1], out=new[1:])
    rank = np.empty(len(key), np.uint32)
    rank[place] = new
    return rank


def _places(starts: np.ndarray | None, steps: list[int], n: int) -> list[np.ndarray | None]:
    """The places that each doubling has to rank for those that the next one ranks, at last starts; None for all, also where most are needed."""
    asked = [starts]
    for have, want in zip(steps[-2::-1], steps[:0:-1]):
        at = asked[-1]
        if at is not None:
            needed = np.zeros(n, bool)
            needed[at] = True
            behind = at + (want - have)
            needed[behind[behind < n]] = True
            at = np.flatnonzero(needed).astype(np.uint32) if 4 * np.count_nonzero(needed) < 3 * n else None
        asked.append(at)
    return asked[::-1]


def suffix_ranks(data: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Rank of each suffix (or of those at starts) among them by its first `length` bytes (0 behind the end), equal for equal prefixes: prefix doubling, from words of as many bytes as fit.

    The last doublings only rank the places that starts are made of.
    """
    n = len(data)
    bits = n.bit_length()
    used = np.bincount(data, minlength=256) > 0
    wide = max(1, int(used.sum() - 1).bit_length())
    step = min(length, max(1, (64 - bits) // wide))
    code = np.zeros(n + step, np.uint8)
    code[:n] = (np.cumsum(used) - 1).astype(np.uint8)[data]
    word = np.zeros(n, np.uint64)
    for j in range(step):
        word <<= np.uint64(wide)
        word |= code[j : j + n]
    steps = [step]
    while steps[-1] < length:
        steps.append(min(2 * steps[-1], length))
    asked = _places(starts, steps, n)
    rank = np.zeros(n, np.uint32)
    at = slice(None) if asked[0] is None else asked[0]
    rank[at] = _dense(word[at], bits)
    del word
    for have, want, places in zip(steps, steps[1:], asked[1:]):
        shift, at = want - have, slice(None) if places is None else places
        key = rank[at].astype(np.uint64)
        key <<= np.uint64(bits)
        # a suffix that ends before the second half comes first
        if places is None:
            key[: max(0, n - shift)] += rank[shift:] + np.uint64(1)
        else:
            inside = places < max(0, n - shift)
            key[inside] += rank[places[inside] + shift] + np.uint64(1)
        rank[at] = _dense(key, bits)
        del key
    return (rank if starts is None else rank[starts]).astype(np.int64)


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each suffix start (ascending) a smaller start that shares `length` bytes, or -1: longest previous factors, of which only those of `length` and more matter.

    Suffixes are in order of their first `length` bytes, ties by place, so where the
    previous smaller position shares them, it is the neighbour before; the next
    smaller one never does.
    """
    rank = suffix_ranks(data, length, starts)
    order = np.sort(rank << 32 | np.arange(len(rank)))
    rank, order = order >> 32, order & 0xFFFFFFFF
    same = np.flatnonzero(rank[1:] == rank[:-1])
    found = np.full(len(starts), -1, np.int64)
    found[order[same + 1]] = starts[order[same]]
    return found


def _match_groups(length: int, keep_first: bool):
    def marks(rows):
        """Spans (doc_id, th, a, b) of the repeated windows of stretches (doc_id, th, s, bytes) of whole groups, in text order within each."""
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        base = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + base[owner]
        source = previous_factors(data, starts, length)
        gone = np.zeros(len(data) + 1, bool)
        gone[starts[source >= 0]] = True
        if not keep_first:
            gone[source[source >= 0]] = True
        hit = gone[starts]
        # runs of marked starts within one stretch
        edge = np.ones(len(starts), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(starts)) - 1
        for i, j in zip(first.tolist(), last.tolist()):
            if hit[i]:
                doc_id, th, s, _ = rows[owner[i]]
                at = s - int(base[owner[i]])
                yield doc_id, th, at + int(starts[i]), at + int(starts[j]) + length

    def task(batches):
        held, size, last = [], 0, None

        def out():
            spans = list(marks(held))
            cols = list(zip(*spans)) if spans else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "th", "a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for h, doc_id, th, s, part in zip(*cols, text_bytes(batch.column(4))):
                if h != last and size >= ARRAY_BYTES:
                    yield out()
                    held, size = [], 0
                if h == last and held and held[-1][:3] == (doc_id, th, s):
                    continue  # repeated rows share their answer
                held.append((doc_id, th, s, part))
                size += len(part)
                last = h
        if held:
            yield out()

    return task


def _requested(length: int, k: int | None):
    """Reads requested stretches (h, s, c) from texts: their bytes, or their own stretches by grams of k."""

    def parts(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for doc_id, th, asked, text in zip(*cols, text_bytes(batch.column(2))):
                for r in asked:
                    yield doc_id, th, r["h"], r["s"], r["s"] + r["c"] + length - 1, text

    def cut(batches):
        hashes = _hashes()
        for batch in batches:
            asked = batch.column(3)
            owner = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())
            salts = pc.struct_field(asked.flatten(), "h").to_numpy().view(np.uint64) | np.uint64(1)
            pieces = ((i, s + at, data) for i, (_, _, _, s, e, text) in enumerate(parts([batch])) for at, data in _segments(text[s:e], length))
            yield from _stretches_of(pieces, batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), length, k, hashes, lambda x: np.ones(len(x), bool), salts)

    def read(batches):
        names = ["h", "doc_id", "th", "s", "part"]
        held, size = [], 0

        def out():
            c = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary())], names)

        for doc_id, th, h, s, e, text in parts(batches):
            held.append((h, doc_id, th, s, text[s:e]))
            size += e - s
            if size >= ARRAY_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return cut if k else read


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")


def _joined(texts: DataFrame, rows: DataFrame, items: int, how: str) -> DataFrame:
    """texts (doc_id, th, text) joined to a written table with a row per (doc_id, th) and a column of items: by broadcast within the bounds, else by a shuffle that splits keys of many rows."""
    key = F.struct(F.col("doc_id"), F.col("th"))
    if rows.count() <= SENT_ROWS and items <= SENT_ITEMS:
        other = rows.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "items")
        return texts.join(F.broadcast(other), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")), how).drop("d_", "t_")
    counted = texts.groupBy(key.alias("key")).agg(F.count("*").alias("rows_"))
    index = materialize(counted.join(rows.select(key.alias("key"), "items"), "key"), "texts-by-key")
    out = skew_safe_join(texts.withColumn("key", key), index, "key", "rows_", how=how)
    return out.select("doc_id", "th", "text", "items")


def _ask(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Texts of the wanted stretches (doc_id, th, h, s, c), with those of each text as items."""
    asked = materialize(wanted.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "s", "c")).alias("items")), name)
    items = asked.agg(F.sum(F.size("items"))).first()[0] or 0
    return _joined(_keyed(docs), asked, items, "inner").select("doc_id", "th", "text", "items")


def repeated_spans(docs: DataFrame, length: int = 200, keep_first: bool = True) -> DataFrame:
    """doc_id, th, a, b: byte ranges that cover what is to go of each text; they may overlap or repeat."""
    spark, levels = docs.sparkSession, gram_lengths(length)
    texts = _keyed(docs)
    grams = map_batches(texts.select("text"), _gram_counts(length, levels[0]), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    bitmap, bits = bitmap_of(grams.where("n > 1"), "h", "repeated-grams")
    sent = spark.sparkContext.broadcast(bitmap)
    found = materialize(map_batches(texts, _repeated_stretches(length, levels[0], sent, bits), STRETCH_DDL), "stretches")
    span = lambda rows: rows.select("doc_id", "th", F.col("s").alias("a"), (F.col("s") + F.col("c") + F.lit(length - 1)).alias("b"))
    out = []
    for level, k in enumerate(levels):
        index = found.groupBy("h").agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).where("n > 1")
        index = materialize(index, "grams")
        met = materialize(skew_safe_join(found, index, "h", "n", how="inner"), "met")
        # of equal stretches the first stands for all; where all of a gram are equal and none is to stay, nothing is left to tell
        pool = met
        if not keep_first:
            out.append(span(met.where("lo = hi")))
            pool = met.where("lo <> hi")
        same = pool.groupBy("h", "f", (F.col("lo") != F.col("hi")).alias("mixed")).agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "th", "s", "c")).alias("first"))
        same = materialize(same, "distinct-stretches")
        copies = skew_safe_join(pool.withColumn("id", F.struct("h", "f")), same.where("m > 1").select(F.struct("h", "f").alias("id"), "m", "first"), "id", "m", how="inner")
        if keep_first:
            copies = copies.where(~F.struct("doc_id", "th", "s", "c").eqNullSafe(F.col("first")))
        out.append(span(copies))
        mixed = same.where("mixed").select("h", "first.*")
        sizes = materialize(mixed.groupBy("h").agg(F.count("*").alias("g")), "group-sizes")
        last = level == len(levels) - 1
        heavy = sizes.where(F.col("g") > MOST_STRETCHES)
        groups = skew_safe_join(mixed, sizes, "h", "g", how="inner")
        small = groups if last else groups.where(F.col("g") <= MOST_STRETCHES)
        parts = map_batches(_ask(docs, small, "asked"), _requested(length, None), "h long, doc_id long, th long, s int, part binary")
        spans = map_batches(parts.repartition("h").sortWithinPartitions("h", "doc_id", "th", "s"), _match_groups(length, keep_first), "doc_id long, th long, a int, b int")
        out.append(materialize(spans, "matches"))
        if last or heavy.isEmpty():
            break
        large = groups.where(F.col("g") > MOST_STRETCHES)
        found = materialize(map_batches(_ask(docs, large, "asked-again"), _requested(length, levels[level + 1]), STRETCH_DDL), "stretches")
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def _merged(batches):
    for batch in batches:
        spans = batch.column(2)
        owner = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())
        a, b = (pc.struct_field(spans.flatten(), x).to_numpy().astype(np.int64) for x in ("a", "b"))
        order = np.argsort(owner << 32 | a)
        a, b = a[order], b[order]
        # the largest end so far in a text: those of later texts count from a larger base
        top = np.maximum.accumulate(owner << 32 | b) - (owner << 32)
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (a[1:] > top[:-1]))) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        ends = top[np.append(first[1:], len(a)) - 1] if len(a) else top
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(spans))))).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a[first], ends)], ["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), items)], ["doc_id", "th", "items"])


def _with_spans(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    spans = repeated_spans(docs, length, keep_first)
    grouped = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("items"))
    merged = materialize(map_batches(grouped, _merged, "doc_id long, th long, items array<struct<a: int, b: int>>"), "spans")
    items = merged.agg(F.sum(F.size("items"))).first()[0] or 0
    return _joined(_keyed(docs), merged, items, "left").select("doc_id", "text", "items")


def _kept_bytes(text: bytes, spans: list | None) -> bytes:
    kept, at = [], 0
    for s in spans or []:
        kept.append(text[at : s["a"]])
        at = s["b"]
    return b"".join([*kept, text[at:]])


def _digests(batches):
    for batch in batches:
        rows = []
        for doc_id, spans, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(1))):
            text = text or b""
            kept = _kept_bytes(text, spans)
            rows.append((doc_id, len(text), len(text) - len(kept), len(spans or []), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row of docs."""
    return map_batches(_with_spans(docs, length, keep_first), _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned_texts(docs: DataFrame, length: int = 200, keep_first: bool = True) -> DataFrame:
    """doc_id, text: what is left of each text; bytes that no longer form a character are left out."""

    def task(batches):
        for batch in batches:
            texts = [_kept_bytes(t or b"", s).decode("utf-8", "ignore") for s, t in zip(batch.column(2).to_pylist(), text_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(_with_spans(docs, length, keep_first), task, "doc_id long, text string")
