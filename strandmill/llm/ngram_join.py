"""Exact Jaccard self-join on word n-grams by multiple-global-order prefix filtering.

Two sets of Jaccard similarity t share a token among their first
s - ceil(t * s) + 1 tokens under every global order of the tokens. Candidates
come from one order (frequent tokens last, then by hash): documents are posted
under their prefix tokens, and pairs of a posting list must pass the length and
position bounds. A pair must then also share prefix tokens under two further
orders (independent hashes); only pairs that pass all filters are verified on
their whole sets. Before that, a parity sketch of each set (one bit a token)
bounds the symmetric difference from below, which drops most chance pairs
without moving any set. Links are joined to components by label propagation.

Skew and size. Equal sets are one class from the start, and a class is posted
once a task. Frequent tokens, found over all documents (at most
HEAVY_TOKENS of them, broadcast), come last in the order, and their posting
lists are split. A long list is not paired out: its members meet its first
pivots, which connects a group of near copies; then a sweep pairs exactly those
members of long lists that are still in different components. Split lists count
as long however few members a part has: parts follow the copies of a token, of
which exact ones are a single class. So no link is lost, and there is no cap on
candidates.

Tokens are 64-bit hashes of n-grams of whole texts. A set has two 64-bit hashes,
and equality of both stands for equality: a class is named by the first, and by
the second where sets that differ in it share the first (the few such names are
looked for over all documents and sent to the tasks).

Defined results: ASCII letters are folded, words are split at ASCII white
space; a text of fewer words than n has its whole sequence as one token; null
and wordless texts have no set and link with nothing; equal texts link; null
identifiers are larger than all others; repeated rows are classed each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import ascii_words, keep_rows, map_batches, materialize, skew_safe_join, text_bytes, text_key

#: Broadcast tokens at most; copies of a token in a task that make it known; posting lists paired out; pivots of longer ones; rows of a split list.
HEAVY_TOKENS, LOCAL_COPIES, SHORT_LIST, PIVOTS, LIST_ROWS = 500_000, 3, 32, 8, 8192
#: Least frequency of a frequent token; identifiers that are broadcast at most; distinct words remembered by a task.
HEAVY_LEAST, BROADCAST_IDS, WORD_CACHE = 64, 1_000_000, 300_000
SKETCH_BITS = 1024
#: Tokens among which a task looks for frequent ones.
HELD_TOKENS = 4_000_000
#: Odd multipliers of the word places of an n-gram, and of the further orders.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)
ORDERS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class WordHash(dict):
    """Word to 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct tokens of a text."""
    split = ascii_words(text)
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=1)], np.uint64)
    m = len(h) - n + 1
    acc = h[:m] * PLACES[0]
    for i in range(1, n):
        acc = acc + h[i : m + i] * PLACES[i % len(PLACES)] * np.uint64(2 * (i // len(PLACES)) + 1)
    return np.unique(_mixed(acc))


def class_hashes(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set: together they stand for it."""
    raw = tokens.tobytes()
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64)), int(np.uint64(xxhash.xxh64_intdigest(raw, seed=7)).astype(np.int64))


def class_of(tokens: np.ndarray, clashes: frozenset = frozenset()) -> int:
    """Identity of a set: its first hash, or the second where the first one is shared by different sets."""
    one, two = class_hashes(tokens)
    return two if one in clashes else one


def prefix_length(s: int, num: int, den: int) -> int:
    return s + num * -s // den + 1


def _prefixes(tokens: np.ndarray, p: int) -> list[bytes]:
    """First p tokens under each further order, as sorted 32-bit values."""
    out = []
    for o in ORDERS:
        h = _mixed(tokens * o) >> np.uint64(32)
        out.append(np.sort((np.partition(h, p - 1)[:p] if p < len(h) else h).astype(np.uint32)).tobytes())
    return out


def sketch_of(tokens: np.ndarray) -> bytes:
    """Parity of the tokens by their lowest bits: sketches differ in at most as many bits as sets differ in tokens.

    The bits grow with the set (a power of two, at least SKETCH_BITS), so that chance pairs of long texts go as well.
    """
    bits = SKETCH_BITS
    while bits * 3 < len(tokens) * 2:
        bits *= 2
    return np.packbits((np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row differing bits of two blocks of sketches (uint64 words); the longer ones are folded to the shorter."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    return np.bitwise_count(x ^ y).sum(1)


def _blocks(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bytes of a sketch to (row numbers, words of those rows)."""
    size = np.array([len(s) for s in sketches])
    out = {}
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        out[int(k)] = (at, np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1))
    return out


def repeated(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that occur at least so often, and how often. They are sorted in place: a task holds them once."""
    tokens.sort()
    many = tokens[least - 1 :] == tokens[: max(0, len(tokens) - least + 1)]  # a run goes on for so long from here
    many[1:] &= tokens[1 : len(many)] != tokens[: max(0, len(many) - 1)]  # and starts here
    first = np.flatnonzero(many)
    found = tokens[first]
    return found, np.searchsorted(tokens, found, side="right") - first


def class_rows(docs: DataFrame, n: int) -> DataFrame:
    """One written table of two kinds: kind 0 a row per row of docs (doc_id, th, cls, n, sketch), kind 1 tokens frequent in a task (cls, n)."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("th", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("chk", pa.int64())])

    def frequent(tokens):
        tok, count = repeated(tokens, LOCAL_COPIES)
        k = len(tok)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(tok.view(np.int64)), pa.array(count.astype(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], schema=schema)

    def task(batches):
        words, held, size = WordHash(), np.empty(HELD_TOKENS, np.uint64), 0
        for batch in batches:
            cls, ns, sketches, chk = [], [], [], []
            for text in text_bytes(batch.column("text")):
                t = shingles(text, n, words)
                one, two = class_hashes(t) if len(t) else (None, None)
                cls.append(one)
                chk.append(two)
                ns.append(len(t))
                sketches.append(sketch_of(t) if len(t) else None)
                if size + len(t) > len(held):
                    yield frequent(held[:size])
                    held, size = held if len(t) <= len(held) else np.empty(len(t), np.uint64), 0
                held[size : size + len(t)] = t
                size += len(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int8)), batch.column("doc_id"), batch.column("th"), pa.array(cls, pa.int64()), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()), pa.array(chk, pa.int64())], schema=schema)
        if size:
            yield frequent(held[:size])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    return materialize(map_batches(own, task, "kind byte, doc_id long, th long, cls long, n long, sketch binary, chk long"), "classes")


def split_clashes(table: DataFrame) -> tuple[DataFrame, frozenset]:
    """(table with cls as class_of names it, first hashes that different sets share: none or a few)."""
    by = table.where("kind = 0 and cls is not null").groupBy("cls").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi"))
    clashes = frozenset(r.cls for r in by.where("lo <> hi").select("cls").collect())
    cls = F.when((F.col("kind") == 0) & F.col("cls").isin(*clashes), F.col("chk")).otherwise(F.col("cls")) if clashes else F.col("cls")
    return table.withColumn("cls", cls).drop("chk"), clashes


def heavy_tokens(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens met often in the whole corpus, and how often: at least HEAVY_LEAST times, or as often as it takes for at most HEAVY_TOKENS of them."""
    counts = materialize(table.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST), "frequent")
    step = F.floor(F.log2("n") * 8).cast("int")
    least, room = HEAVY_LEAST, HEAVY_TOKENS
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top")).orderBy(F.desc("step")).collect():
        room -= r.k
        if room < 0:
            least = r.top + 1
            break
    rows = counts.where(F.col("n") >= least).toArrow()
    tok, n = rows.column("cls").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tok)
    return tok[order], n[order]


def postings(docs: DataFrame, n: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray], list_rows: int = LIST_ROWS, clashes: frozenset = frozenset()) -> DataFrame:
    """token, sub (0, or the part of a split list, from 1), cls, n, pos: every class under its prefix tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = pa.schema([("token", pa.int64()), ("sub", pa.int32()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def flush(held):
        tok, sub, cls, size, pos = (np.concatenate([h[i] for h in held]) for i in range(5))
        return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(sub), pa.array(cls), pa.array(size), pa.array(pos)], schema=schema)

    def task(batches):
        top, count = sent.value
        words, seen, held, rows = WordHash(), set(), [], 0
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                t = shingles(text, n, words)
                if not len(t):
                    continue
                c = class_of(t, clashes)
                if c in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                s, p = len(t), prefix_length(len(t), num, den)
                parts = np.ones(p, np.int64)
                if len(top):
                    at = np.minimum(np.searchsorted(top, t), len(top) - 1)
                    often = top[at] == t
                    order = np.argsort(often, kind="stable")[:p]
                    t, at, often = t[order], at[order], often[order]
                    parts[often] = -(-count[at[often]] // list_rows)
                held.append((t[:p], np.where(parts > 1, (c & 0x7FFFFFFF) % parts + 1, 0).astype(np.int32), np.full(p, c, np.int64), np.full(p, s, np.int32), np.arange(p, dtype=np.int32)))
                rows += p
                if rows > 50_000:
                    yield flush(held)
                    held, rows = [], 0
        if held:
            yield flush(held)

    return map_batches(docs.select("text"), task, "token long, sub int, cls long, n int, pos int")


def _passes(n1, p1, n2, p2, num: int, den: int) -> np.ndarray:
    """Length and position bounds, with the common token as the first common one."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    need = -(-num * (n1 + n2) // (num + den))
    return (np.minimum(n1, n2) * den >= num * np.maximum(n1, n2)) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= need)


def _pairs(cls, i, j) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new]


CANDIDATE = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
CANDIDATE_DDL = "kind byte, a long, b long, n int, pos int"


def scan_lists(posted: DataFrame, num: int, den: int, short: int = SHORT_LIST, pivots: int = PIVOTS) -> DataFrame:
    """CANDIDATE rows of posting lists: kind 0 pairs (a < b), kind 1 members of long lists and of all parts of split ones (a token, b class), kind 2 their pivots."""

    def task(batches):
        held, rows, open_ = [], 0, None  # open_: (token, sub, pivots) of a long list that goes on
        pa_, pb = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def flush_pairs(last: bool):
            nonlocal pa_, pb
            if last or sum(map(len, pa_)) > 1_000_000:
                a, b = _distinct(np.concatenate(pa_), np.concatenate(pb))
                pa_, pb = [a], [b]
                if last or len(a) > 500_000:
                    pa_, pb = [a[:0]], [b[:0]]
                    k = len(a)
                    return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), pa.array(a), pa.array(b), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())], schema=CANDIDATE)
            return None

        def work(tok, sub, cls, n, pos, end: bool):
            """Handles all whole lists, and the rows so far of a last one that is long; returns rows to keep and rows to emit."""
            nonlocal open_
            out = []
            new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (sub[1:] != sub[:-1])))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(tok)))
            group = np.cumsum(new) - 1
            goes_on = open_ is not None and open_[0] == tok[0] and open_[1] == sub[0]
            stop = len(tok) if end or size[-1] > 4096 or (goes_on and len(first) == 1) else first[-1]
            small = (size >= 2) & (size <= short)
            if goes_on:
                small[0] = False
            use = np.flatnonzero(small[group] & (np.arange(len(tok)) < stop))
            g, c, m, p = group[use], cls[use], n[use], pos[use]
            for d in range(1, short):
                if d >= len(use):
                    break
                i = np.flatnonzero(g[d:] == g[:-d])
                if not len(i):
                    break
                i = i[_passes(m[i], p[i], m[i + d], p[i + d], num, den) & (c[i] != c[i + d])]
                a, b = _pairs(c, i, i + d)
                pa_.append(a)
                pb.append(b)
            for k in np.flatnonzero((size > short) | (sub[first] > 0) | ((np.arange(len(size)) == 0) & goes_on)):
                lo, hi = first[k], first[k] + size[k]
                if lo >= stop:
                    continue
                mine = (cls[lo:hi], n[lo:hi], pos[lo:hi])
                if k == 0 and goes_on:
                    piv = open_[2]
                else:
                    piv = tuple(x[:pivots] for x in mine)
                    s = (len(piv[0]) + 1) // 2
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(s, 2, np.int8)), pa.array(np.full(s, tok[lo])), pa.array(piv[0][:s]), pa.array(piv[1][:s]), pa.array(piv[2][:s])], schema=CANDIDATE))
                open_ = (tok[lo], sub[lo], piv)
                for q in range(len(piv[0])):
                    ok = _passes(mine[1], mine[2], piv[1][q], piv[2][q], num, den) & (mine[0] != piv[0][q])
                    pa_.append(np.minimum(mine[0][ok], piv[0][q]))
                    pb.append(np.maximum(mine[0][ok], piv[0][q]))
                r = hi - lo
                out.append(pa.RecordBatch.from_arrays([pa.array(np.ones(r, np.int8)), pa.array(tok[lo:hi]), pa.array(mine[0]), pa.array(mine[1]), pa.array(mine[2])], schema=CANDIDATE))
            return stop, out

        def drain(end: bool):
            nonlocal held, rows
            cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
            tok, sub, cls = cols[:3]
            same = np.concatenate(([False], (tok[1:] == tok[:-1]) & (sub[1:] == sub[:-1]) & (cls[1:] == cls[:-1])))  # a class posted by several tasks
            cols = [c[~same] for c in cols]
            stop, out = work(*cols, end)
            held = [tuple(c[stop:] for c in cols)] if stop < len(cols[0]) else []
            rows = len(held[0][0]) if held else 0
            return out

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("token", "sub", "cls", "n", "pos")))
            rows += len(held[-1][0])
            if rows > 200_000:
                yield from drain(False)
                if found := flush_pairs(False):
                    yield found
        if rows:
            yield from drain(True)
        yield flush_pairs(True)

    lists = posted.repartition(F.col("token"), F.col("sub")).sortWithinPartitions("token", "sub", "pos", "cls")
    return map_batches(lists, task, CANDIDATE_DDL)


def verify(pairs: DataFrame, docs: DataFrame, table: DataFrame, n: int, num: int, den: int, broadcast_ids: int = BROADCAST_IDS, clashes: frozenset = frozenset()) -> DataFrame:
    """Of the written pairs (a, b), those that pass the further orders and are similar on their whole sets. A written table."""
    own = table.where("kind = 0 and cls is not null")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "n", "sketch")).alias("m")
    ends = lambda of: of.select(F.col("a").alias("cls")).union(of.select("b")).distinct()
    heads = own.join(ends(pairs), "cls", "left_semi").groupBy("cls").agg(one)
    heads = materialize(heads.select("cls", "m.n", "m.sketch", F.col("m.doc_id").alias("wid"), F.col("m.th").alias("wth")), "heads")
    end = lambda s: heads.select(F.col("cls").alias(s), F.col("n").alias("n" + s), F.col("sketch").alias("sketch" + s))

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            most = both - 2 * -(-num * both // (num + den))
            apart, sa, sb = np.zeros(batch.num_rows, np.int64), batch.column("sketcha").to_pylist(), batch.column("sketchb").to_pylist()
            for at, words in _blocks(sa).values():
                for k, other in _blocks([sb[i] for i in at]).values():
                    apart[at[k]] = bits_apart(words[k], other)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most))

    pairs = materialize(map_batches(pairs.join(end("b"), "b").join(end("a"), "a").select("a", "b", "na", "nb", "sketcha", "sketchb"), near, "a long, b long"), "near")
    wanted = materialize(heads.select("cls", "wid", "wth").join(ends(pairs), "cls", "left_semi"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    texts = own.join(side, own["doc_id"].eqNullSafe(side["wid"]) & (own["th"] == side["wth"])).select("cls", "text")

    def sets(batches):
        words = WordHash()
        schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("p1", pa.binary()), ("p2", pa.binary()), ("tokens", pa.binary())])
        for batch in batches:
            rows = []
            for cls, text in zip(batch.column("cls").to_pylist(), text_bytes(batch.column("text")), strict=True):
                t = shingles(text, n, words)
                if len(t) and class_of(t, clashes) == cls:
                    rows.append((cls, len(t), *_prefixes(t, prefix_length(len(t), num, den)), t.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = materialize(map_batches(texts, sets, "cls long, n long, p1 binary, p2 binary, tokens binary"), "sets")
    side_of = lambda s, *cols: found.select(F.col("cls").alias(s), *(F.col(c).alias(c + s) for c in cols))

    def shares(batches):
        for batch in batches:
            keep = []
            for x1, y1, x2, y2 in zip(*(batch.column(c).to_pylist() for c in ("p1a", "p1b", "p2a", "p2b")), strict=True):
                keep.append(all(len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) for x, y in ((x1, y1), (x2, y2))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(side_of("b", "p1", "p2"), "b").join(side_of("a", "p1", "p2"), "a").select("a", "b", "p1a", "p1b", "p2a", "p2b")
    passed = materialize(map_batches(left, shares, "a long, b long"), "passed")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokensa").to_pylist(), batch.column("tokensb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = passed.join(side_of("b", "tokens"), "b").join(side_of("a", "tokens"), "a").select("a", "b", "tokensa", "tokensb")
    return materialize(map_batches(full, similar, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable), by minimum labels with pointer jumping; each round is a written table.

    A hub of a thousandth of all edges, or a component of a thousandth of all
    nodes, is joined by broadcast, so no task gets it whole.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = edges.count()
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("deg"))
    labels = materialize(first.select("node", F.least("node", "m").alias("comp"), "deg"), "labels")
    while True:
        ends = labels.select(F.col("node").alias("b"), "comp", "deg")
        near = skew_safe_join(edges, ends, "b", "deg", total=total, how="inner").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = materialize(labels.join(near, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"), "deg"), "labels")
        sizes = step.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        heads = materialize(sizes.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp"), "heads")
        jump = skew_safe_join(step, heads, "comp", "size", how="inner")
        labels = materialize(jump.select("node", F.least("comp", "next").alias("comp"), "old", "deg"), "labels")
        if labels.where("comp <> old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.drop("old")


def sweep_lists(members: DataFrame, labels: DataFrame, table: DataFrame, num: int, den: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """Pairs of long lists whose members are in different components.

    Sets of similar size only are similar, so a list is cut into zones of two
    neighbouring size classes, a zone into blocks, and each two blocks of a zone
    meet in one task, where the bounds and the sketches are tested, so that only
    likely pairs are made. Two members meet in the zone of the larger one.
    """
    known = labels.select(F.col("node").alias("cls"), "comp")
    own = materialize(members.join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "members")
    mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    step = max(1e-3, float(np.log(den / num)) * 1.001)  # a little more than the ratio of sizes that can be similar
    zoned = own.join(mixed, "token").withColumn("size", F.floor(F.log("n") / step)).withColumn("zone", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    zones = zoned.groupBy("token", "zone").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("top")).where("top = zone")
    zones = zones.select("token", "zone", F.ceil(F.col("rows") / (list_rows // 2)).cast("int").alias("nb"))
    cut = materialize(zoned.join(zones, ["token", "zone"]).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")), "mixed")
    sketches = table.where("kind = 0").join(cut.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("sketch").alias("sketch"))
    cut = cut.join(sketches, "cls")
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")).select("token", "zone", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk", "size", "cls", "n", "pos", "comp", "sketch")

    def meet(key, t):
        zone, x, y = key[1].as_py(), key[2].as_py(), key[3].as_py()
        blk, cls, n, pos, comp, large = (t.column(c).to_numpy() for c in ("blk", "cls", "n", "pos", "comp", "size"))
        large = large == zone
        blocks = _blocks(t.column("sketch").to_pylist())
        bits, row = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        for k, (at, _) in blocks.items():
            bits[at], row[at] = k, np.arange(len(at))
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(cls)):
            if blk[i] != x:
                continue
            j = np.flatnonzero((blk == y) & (large | large[i]) & (comp != comp[i]) & ((cls > cls[i]) if x == y else True) & _passes(n, pos, n[i], pos[i], num, den))
            if len(j):
                both = n[j].astype(np.int64) + n[i]
                apart, own = np.zeros(len(j), np.int64), blocks[int(bits[i])][1][row[i]][None, :]
                for k in np.unique(bits[j]):
                    at = np.flatnonzero(bits[j] == k)
                    apart[at] = bits_apart(blocks[int(k)][1][row[j[at]]], own)
                j = j[apart <= both - 2 * -(-num * both // (num + den))]
            out_a.append(np.minimum(cls[j], cls[i]))
            out_b.append(np.maximum(cls[j], cls[i]))
        a, b = _distinct(np.concatenate(out_a), np.concatenate(out_b))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("token", "zone", "x", "y").applyInArrow(meet, "a long, b long").distinct()


def link_documents(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, short: int = SHORT_LIST, pivots: int = PIVOTS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, th, n_shingles, component_id, kept (one row a component). Sets link when den * intersection >= num * union."""
    table, clashes = split_clashes(class_rows(docs, n))
    heavy = heavy_tokens(table)
    posted = postings(docs, n, num, den, heavy, list_rows, clashes)
    found = materialize(scan_lists(posted, num, den, short, pivots), "candidates")
    again = found.where("kind = 2").select(F.col("a").alias("token"), F.lit(0).alias("sub"), F.col("b").alias("cls"), "n", "pos")
    pairs = found.where("kind = 0").select("a", "b")
    if len(heavy[1]) and heavy[1].max() > list_rows:  # split lists: their pivots meet
        second = materialize(scan_lists(again, num, den, short, pivots), "pivots")
        pairs = pairs.union(second.where("kind = 0").select("a", "b"))
    links = verify(materialize(pairs.distinct(), "pairs"), docs, table, n, num, den, clashes=clashes)
    labels = components(links)
    members = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cls"), "n", "pos").distinct()
    swept = materialize(sweep_lists(members, labels, table, num, den, list_rows), "swept")
    if not swept.isEmpty():
        labels = components(links.union(verify(swept, docs, table, n, num, den, clashes=clashes)))
    return _answers(table, materialize(labels, "components"))


def _answers(table: DataFrame, labels: DataFrame) -> DataFrame:
    rows = materialize(table.where("kind = 0").select("doc_id", "th", "cls", "n", F.monotonically_increasing_id().alias("rid")), "rows")
    one = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(one).alias("first"), F.count(F.lit(1)).alias("size"))
    known = labels.select(F.col("node").alias("cls"), "comp")
    classes = materialize(classes.join(known, "cls", "left").where("comp is not null or size > 1").withColumn("comp", F.coalesce("comp", "cls")), "classes")
    heads = materialize(classes.groupBy("comp").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("members")), "heads")
    index = materialize(skew_safe_join(classes.select("cls", "size", "comp"), heads, "comp", "members").select("cls", "size", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("head_rid")), "index")
    joined = skew_safe_join(rows, index, "cls", "size", total=rows.count())
    alone = F.col("head_rid").isNull()
    return joined.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("head_rid") == F.col("rid"))).alias("kept"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: the smallest identifier's, columns as they were."""
    rows = materialize(link_documents(docs, n, num, den).select("doc_id", "th", "kept"), "near")
    return keep_rows(docs, rows)
