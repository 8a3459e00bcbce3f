"""Phrase collocation mining: counts of all phrases from one count of padded longest windows, by ROLLUP.

Each word starts one window: itself and the words that follow it in its piece,
as columns w1 to w5 made by shifting the words' columns (no shuffle), padded
with 0 behind the piece's end. Only distinct windows are counted. The count of
a shorter phrase is the sum over the windows that begin with it, so
ROLLUP(lang, w1, ..., w5) gives every phrase's count, and the words of a
language as well; nothing is exploded per length.

Most windows are unique and would only be moved to be dropped. A phrase can't
be more frequent than its pairs of adjacent words, so a window is padded from
its first pair on that occurs less than `least` times. Rare pairs are told by a
bitmap of hashed pairs, of at most 2^27 bits whatever the corpus: a pair
that shares a bit with a frequent one only stays in a window for nothing. Counts
of phrases of `least` or more are the same with any bitmap.

Words are moved as 64-bit hashes; those of windows of two or more words come
with their spelling, and if two spellings share a hash another base is taken.

Defined results: null text is empty, null lang counts as `und` (together with
the language of that name); doc_id isn't read, repeated rows count as often as
they occur; a piece may be as long as a text; an empty table gives no phrases;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, skew_safe_join, text_bytes
from strandmill.llm.hashing import RunHash, bitmap_of, in_bitmap, mix

#: Bytes handled at once; words whose pairs or windows are counted in a task before they are passed on; parts of a language that are ranked by themselves.
BLOCK, HELD_WORDS, RANK_PARTS = 1 << 20, 1 << 20, 64
#: Odd bases of the word hash, tried in turn.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(_ENDS)] = 2


def _cut(text: bytes):
    """text in parts of about BLOCK bytes that end between pieces; a longer piece stays whole."""
    at = 0
    while len(text) - at > BLOCK:
        end = max(text.rfind(c, at + 1, at + BLOCK) for c in (_ENDS[i : i + 1] for i in range(len(_ENDS))))
        if end < 0:
            later = [k for k in (text.find(_ENDS[i : i + 1], at + BLOCK) for i in range(len(_ENDS))) if k >= 0]
            if not later:
                break
            end = min(later)
        yield text[at:end]
        at = end
    yield text[at:]


def _blocks(batches):
    """Lists of (lang, part of a text) of about BLOCK bytes."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            for part in _cut(text or b""):
                held.append((lang, part))
                size += len(part) + 1
                if size >= BLOCK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class Words:
    """Words of blocks: hashes, languages, and which words follow within a piece."""

    def __init__(self, base: int):
        self.hash, self.langs, self.codes, self.salts = RunHash(base), [], {}, np.zeros(0, np.uint64)

    def _code(self, lang: str) -> int:
        if lang not in self.codes:
            self.codes[lang] = len(self.langs)
            self.langs.append(lang)
            salt = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
            self.salts = np.append(self.salts, np.uint64(salt))
        return self.codes[lang]

    def read(self, block: list):
        """The block's bytes, then of each word: start, end, hash, language code; and whether word i + 1 follows word i in its piece."""
        raw = b"\n".join(x[1] for x in block).translate(_LOWER)
        data = np.frombuffer(raw, np.uint8)
        kind = _CLASS[data]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind == 0
        edges = np.diff(inside)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        h = self.hash.runs(self.hash.sums(data), start, end)
        h[h == 0] = 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        firsts = np.cumsum([0] + [len(x[1]) + 1 for x in block[:-1]])
        code = np.array([self._code(x[0]) for x in block], np.int32)[np.searchsorted(firsts, start, "right") - 1]
        return raw, start, end, h, code, piece[1:] == piece[:-1]

    def pairs(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return mix(mix(h[:-1] + self.salts[code[:-1]]) + h[1:])


def _count_pairs(base: int):
    def task(batches):
        words, held, size = Words(base), [], 0

        def out():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

        for block in _blocks(batches):
            _, _, _, h, code, follows = words.read(block)
            held.append(words.pairs(h, code)[follows])
            size += len(held[-1])
            if size >= HELD_WORDS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return task


def frequent_pairs(texts: DataFrame, least: int, base: int) -> tuple[np.ndarray, int]:
    """A bitmap of the hashed pairs that occur at least `least` times, and the number of bits of its positions."""
    counted = texts.mapInArrow(_count_pairs(base), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return bitmap_of(counted.where(F.col("n") >= least), "g", "pairs")


def _count_windows(base: int, sent, bits: int, longest: int):
    names = ["lang", *(f"w{i + 1}" for i in range(longest)), "n", "word"]

    def task(batches):
        words, held, size, told = Words(base), [], 0, set()
        bitmap = sent.value

        def out():
            code, cols = np.concatenate([x[0] for x in held]), [np.concatenate([x[1][i] for x in held]) for i in range(longest)]
            key = words.salts[code]
            for c in cols:
                key = mix(key + c)
            order = np.argsort(key, kind="stable")
            code, cols = code[order], [c[order] for c in cols]
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(code)))
            lang = pa.array(words.langs, pa.string()).take(pa.array(code[at]))
            return pa.RecordBatch.from_arrays([lang, *(pa.array(c[at].view(np.int64)) for c in cols), pa.array(n.astype(np.int64)), pa.nulls(len(at), pa.binary())], names)

        def spell(raw, start, end, h, joined):
            used = np.zeros(len(h), bool)
            used[:-1] |= joined
            used[1:] |= joined
            at = np.flatnonzero(used)
            _, first = np.unique(h[at], return_index=True)
            fresh = [i for i in at[first].tolist() if int(h[i]) not in told]
            told.update(int(h[i]) for i in fresh)
            if fresh:
                k, none = h[fresh].view(np.int64), pa.nulls(len(fresh), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(fresh), pa.string()), pa.array(k), *[none] * longest, pa.array([raw[start[i] : end[i]] for i in fresh], pa.binary())], names)

        for block in _blocks(batches):
            raw, start, end, h, code, follows = words.read(block)
            if not len(h):
                continue
            joined = follows & in_bitmap(words.pairs(h, code), bitmap, bits)
            yield from spell(raw, start, end, h, joined)
            cols, chain = [h], np.ones(len(h), bool)
            for i in range(1, longest):
                # the i-th word of a window is there if all pairs up to it are
                chain = chain[: len(h) - i] & joined[i - 1 :] if len(h) > i else np.zeros(0, bool)
                lead = np.zeros(len(h), np.uint64)
                lead[: len(chain)] = np.where(chain, h[i:], 0) if len(chain) else 0
                cols.append(lead)
            held.append((code, cols))
            size += len(h)
            if size >= HELD_WORDS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return task


def count_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, p, n): words and phrases that occur at least `least` times, as arrays of word hashes, and the number of all words of a language, as the empty array; (h, word): their spelling."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    cols = [f"w{i + 1}" for i in range(longest)]
    ddl = "lang string, " + ", ".join(f"{c} long" for c in cols) + ", n long, word binary"
    for base in BASES:
        bitmap, bits = frequent_pairs(texts, least, base)
        sent = docs.sparkSession.sparkContext.broadcast(bitmap)
        windows = materialize(texts.mapInArrow(_count_windows(base, sent, bits, longest), ddl), "windows")
        spelled = windows.where("word is not null").groupBy(F.col("w1").alias("h")).agg(F.min("word").alias("word"), F.max("word").alias("other"))
        spelled = materialize(spelled, "spelling")
        if spelled.where("word <> other").isEmpty():
            break
    else:
        raise ValueError("two words share a hash under every base")
    counted = windows.where("word is null").groupBy("lang", *cols).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *cols).agg(F.sum("n").alias("n"))
    p = F.filter(F.array(*cols), lambda x: x.isNotNull())
    whole = (F.size("p") == 0) | ((F.col("n") >= least) & (F.element_at("p", -1) != 0))
    phrases = rolled.where("lang is not null").select("lang", p.alias("p"), "n").where(whole)
    return materialize(phrases, "phrases"), spelled.select("h", F.col("word").cast("string").alias("word"))


def _looked_up(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """rows joined to values, which has one row a key; keys that hold many rows are broadcast."""
    index = materialize(rows.groupBy(key).agg(F.count("*").alias("rows_")).join(values, key), "looked-up")
    return skew_safe_join(rows, index, key, "rows_", how="inner")


def _slices(p: Column) -> Column:
    """All runs of 2 or more words of p that are shorter than p."""
    by_length = F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(p) - m + 1), lambda s: F.slice(p, s, m)))
    return F.flatten(by_length)


def mine_collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, absorb: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language; absorb: share of a phrase's count, in hundredths, at which a longer phrase takes its place."""
    phrases, spelled = count_phrases(docs, longest, least)
    key = lambda p: F.struct(F.col("lang"), p)
    counts = phrases.where("size(p) > 0").select(F.struct("lang", "p").alias("key"), "n")
    whole = phrases.where("size(p) = 0").select("lang", "n")
    found = phrases.where("size(p) >= 2").select("lang", "p", F.col("n").alias("a"))

    longer = found.where("size(p) >= 3").select("lang", F.col("a").alias("m"), F.explode(_slices(F.col("p"))).alias("p"))
    longer = longer.groupBy("lang", "p").agg(F.max("m").alias("m"))
    alone = found.join(longer, ["lang", "p"], "left").where(F.col("m").isNull() | (100 * F.col("m") < absorb * F.col("a"))).drop("m")
    cuts = alone.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("lang", "p", "a", "k", key(F.slice("p", F.lit(1), F.col("k")).alias("p")).alias("left"), key(F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("p")).alias("right"))
    cuts = materialize(cuts, "cuts")
    cuts = materialize(_looked_up(cuts, "left", counts.select(F.col("key").alias("left"), F.col("n").alias("l"))).select("lang", "p", "a", "k", "l", "right"), "cuts")
    cuts = materialize(_looked_up(cuts, "right", counts.select(F.col("key").alias("right"), F.col("n").alias("r"))).select("lang", "p", "a", "k", "l", "r"), "cuts")
    cuts = _looked_up(cuts, "lang", whole)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", (product * wide("n")).cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = materialize(best.select("lang", "p", "a", "n", "cut.score", "cut.l", "cut.r"), "scored")

    words = best.select("lang", "p", F.posexplode("p").alias("at", "h"))
    words = _looked_up(materialize(words, "phrase-words"), "h", spelled)
    texts = words.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(texts, ["lang", "p"]).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
