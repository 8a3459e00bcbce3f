"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Word counts cover all training documents. The model's vocabulary is the most
frequent VOCAB_SCALE * sqrt(training tokens) words (and as many as a single
class holds at least), so it grows with the corpus while a token's cost grows
by the sixth root of it; all other words share one unknown class, whose words
are told apart by their smoothed counts. The representation of the next word is
predicted from the representations of the two words before it through diagonal
context matrices; each task trains on all its training documents by minibatch
NCE with noise from the unigram distribution (several passes where it has few
tokens), and the tasks' parameters are averaged word by word, by how often each
task used the word. A task sends the words that it used USES times, so what is
sent is bounded by its own tokens.

Scores are normalised. Words are dealt by rank to the leaves of a tree of up to
three levels with equal branching; every level has vectors and NCE of its own,
and a word's probability is the product of its nodes' probabilities among their
siblings, so a token costs three sums of the cube root of the vocabulary. A
vocabulary of at most DENSE words is one class: with both context terms in the
logit, the normaliser of every context pair is one entry of a matrix product of
the exponentiated terms, so a token's log-probability is four table look-ups.

Counts of frequent words (those of the model, and the words that are frequent
enough for at most TOP_WORDS of them) are broadcast; the other words of a
document are joined to their counts, none of them holding more than 1/TOP_WORDS
of all tokens.

Defined results: null text is empty and consists of the end token alone; rows
are scored each for itself; with no training document every count is 0; null
identifiers are never held out.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import ascii_words, held_out, materialize, text_bytes

#: Words whose counts are broadcast at most, beside the model's; words of the model by the root of the training tokens; words of one class at most.
TOP_WORDS, VOCAB_SCALE, DENSE = 300_000, 2.0, 1024
#: Width, noise words a batch, tokens a batch, learning rate; tokens that a task trains on at least, by up to PASSES passes; uses that make a task send a word.
WIDTH, NOISE, BATCH, RATE, PASS_TOKENS, PASSES, USES = 24, 48, 1024, 0.3, 2_000_000, 8, 4
BEGIN, UNKNOWN, FIRST = 0, 1, 2
END = b""
#: Words of a counting table; tokens scored at once.
COUNTER_WORDS, SCORED = 300_000, 1 << 18
#: Tokens whose sums are taken together when scoring.
ROWS = 4096
SMOOTH = 0.1


def count_words(train: DataFrame) -> DataFrame:
    """word (binary; the empty one is the end token), n of all training texts."""

    def task(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                seen.update(ascii_words(text))
                seen[END] += 1
                if len(seen) > COUNTER_WORDS:
                    yield _batch(seen)
                    seen = Counter()
        if seen:
            yield _batch(seen)

    def _batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return materialize(train.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


class Vocabulary:
    """Broadcast side: index of the top words, the first of them the model's, their counts, and totals over all training tokens."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, inside: int):
        self.words, self.counts, self.total, self.distinct = words, np.array(counts, np.int64), total, distinct
        self.inside, self.size = inside, inside + FIRST
        base = self.total + SMOOTH * (self.distinct + 1)
        self.base = np.log10((self.counts + SMOOTH) / base)
        self.base_log_total = float(np.log10(base))
        rest = self.total - int(self.counts[: self.inside].sum())
        self.unknown_log_total = float(np.log10(rest + SMOOTH * (max(0, self.distinct - self.inside) + 1)))
        self.within = np.log10(self.counts + SMOOTH) - self.unknown_log_total
        p = np.empty(self.size)
        p[BEGIN], p[UNKNOWN], p[FIRST:] = 0, rest + SMOOTH, self.counts[: self.inside] + SMOOTH
        self.unigram = p / p.sum()
        self._index: dict[bytes, int] | None = None

    def model(self) -> Vocabulary:
        """The same without the words that only have counts: a small table of words is searched faster."""
        return Vocabulary(self.words[: self.inside], self.counts[: self.inside].tolist(), self.total, self.distinct, self.inside)

    def index(self) -> dict[bytes, int]:
        if self._index is None:
            self._index = {w: i for i, w in enumerate(self.words)}
        return self._index

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Place among the top words, -1 for others."""
        return np.fromiter(map(self.index().get, words, repeat(-1)), np.int32, len(words))

    def model_ids(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids >= 0) & (ids < self.inside), ids + FIRST, UNKNOWN)


class LogBilinear:
    """Parameters: word vectors for context and target, two diagonal context matrices, biases. Inner nodes are targets behind the words."""

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 3, dense: int = DENSE):
        rng, v = np.random.default_rng(seed), len(unigram)
        depth = 1 if v <= dense else 2 if v <= 4 * dense else 3
        self.branch = v if depth == 1 else int(np.ceil(v ** (1 / depth)))
        #: Words below a node of each level, from the leaves up, and the number of targets before the level.
        self.span = [self.branch**j for j in range(depth)]
        levels = [np.add.reduceat(unigram, np.arange(0, v, n)) for n in self.span]
        self.before = np.cumsum([0, *map(len, levels)])
        out = np.concatenate(levels)
        self.p = {
            "r": rng.normal(0, 0.3, (v, width)).astype(np.float32),
            "q": rng.normal(0, 0.1, (len(out), width)).astype(np.float32),
            "c": np.ones((2, width), np.float32) * np.array([[1.0], [0.5]], np.float32),
            "b": np.log(np.maximum(out, 1e-12)).astype(np.float32),
        }
        self.log_noise = self.p["b"].copy()
        self.steps = [np.cumsum(u) / u.sum() for u in levels]
        self.sq = {k: np.full_like(x, 1e-2) for k, x in self.p.items()}
        self.uses = np.zeros(len(out), np.int64)
        self.ready = None

    def step(self, ctx: np.ndarray, target: np.ndarray, rng: np.random.Generator, noise: int = NOISE, rate: float = RATE) -> None:
        """One NCE step of all levels. ctx: (n, 2) model ids, nearest first; noise words are shared by the batch, half as many a level up."""
        p, levels, w = self.p, len(self.span), self.p["q"].shape[1]
        near, far = p["r"].take(ctx[:, 0], 0), p["r"].take(ctx[:, 1], 0)
        h = near * p["c"][0] + far * p["c"][1]
        draws = [max(8, noise >> j) for j in range(levels)]  # upper levels have fewer nodes to tell apart
        log_kn = np.log(np.array(draws, np.float32))
        goal = np.concatenate([target // span + before for span, before in zip(self.span, self.before, strict=False)])
        k = np.concatenate([before + np.minimum(np.searchsorted(steps, rng.random(n), side="right"), len(steps) - 1) for n, before, steps in zip(draws, self.before, self.steps, strict=False)])
        qg, qk = p["q"].take(goal, 0).reshape(levels, -1, w), p["q"].take(k, 0)
        with np.errstate(over="ignore"):  # an infinite weight is a probability of 0
            st = np.einsum("nd,lnd->ln", h, qg) + (p["b"].take(goal) - self.log_noise.take(goal)).reshape(levels, -1) - log_kn[:, None]
            gn = h @ qk.T
            gn += p["b"].take(k) - self.log_noise.take(k) - np.repeat(log_kn, draws)
            np.exp(np.negative(gn, out=gn), out=gn)
            gn += 1
            np.reciprocal(gn, out=gn)
            gt = 1 / (1 + np.exp(-st)) - 1  # of the loss by the score
        gh = gn @ qk
        gh += np.einsum("ln,lnd->nd", gt, qg)
        gq = np.empty((len(goal) + len(k), w + 1), np.float32)
        np.multiply(gt[:, :, None], h, out=gq[: len(goal), :w].reshape(levels, -1, w))
        gq[: len(goal), w] = gt.ravel()
        gq[len(goal) :, :w] = gn.T @ h
        gq[len(goal) :, w] = gn.sum(0)
        at, gq, times = _rows(np.concatenate((goal, k)), gq)
        near_far, gr, used = _rows(np.concatenate((ctx[:, 0], ctx[:, 1])), np.concatenate((gh * p["c"][0], gh * p["c"][1])))
        gc = np.stack((np.einsum("nd,nd->d", gh, near), np.einsum("nd,nd->d", gh, far)))
        self.uses[at] += times
        self.uses[near_far] += used
        for name, rows, g in (("q", at, gq[:, :-1]), ("b", at, gq[:, -1]), ("r", near_far, gr), ("c", np.arange(2), gc)):
            g = g * np.float32(1 / np.sqrt(len(target)))
            sq = self.sq[name].take(rows, 0)
            sq += g * g
            self.sq[name][rows] = sq
            np.divide(g, np.sqrt(sq, out=sq), out=sq)
            sq *= np.float32(-rate)
            sq += p[name].take(rows, 0)
            p[name][rows] = sq

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, norm) of a single class: log10 p(w | near a, far b) = near[a, w] + far[b, w] - norm[a, b]; the begin mark has probability 0."""
        p = {k: x.astype(np.float64) for k, x in self.p.items()}
        near = (p["r"] * p["c"][0]) @ p["q"].T + p["b"]
        far = (p["r"] * p["c"][1]) @ p["q"].T
        near[:, BEGIN] = -1e4
        a, b = near.max(1, keepdims=True), far.max(1, keepdims=True)
        norm = np.log(np.exp(near - a) @ np.exp(far - b).T) + a + b.T
        return tuple((x / np.log(10)).astype(np.float32) for x in (near, far, norm))

    def log_probs(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 p of each target after its context."""
        one = len(self.span) == 1
        if self.ready is None:  # the parameters are final
            self.ready = self.tables() if one else self._paths()
        if one:
            near, far, norm = self.ready
            return near[ctx[:, 0], target] + far[ctx[:, 1], target] - norm[ctx[:, 0], ctx[:, 1]]
        near, far, path, nodes = self.ready
        order = _order(target)  # siblings lie side by side at every level
        ctx, target, logs = ctx.take(order, 0), target.take(order), np.empty(len(order), np.float32)
        for s in range(0, len(target), ROWS):  # what a few thousand tokens need stays in the processor's cache
            t = target[s : s + ROWS]
            h = near.take(ctx[s : s + ROWS, 0], 0)
            h += far.take(ctx[s : s + ROWS, 1], 0)
            x = np.einsum("nd,nd->n", h, path.take(t, 0))
            for j, (span, before) in enumerate(zip(self.span, self.before, strict=False)):
                last, end = j + 1 == len(self.span), self.before[j + 1]
                group = t // (span * self.branch) if not last else np.zeros(len(t), t.dtype)
                first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(t)], strict=True):
                    k = before + int(group[lo]) * self.branch
                    x[lo:hi] -= _log_total(h[lo:hi], nodes[k : end if last else min(k + self.branch, end)])
            logs[s : s + ROWS] = x
        out = np.empty(len(logs), np.float32)
        out[order] = logs / np.float32(np.log(10))
        return out

    def _paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, path, nodes): context words by their matrices, with a 1 for the biases, sums of the nodes over each word, and nodes with their biases."""
        v = len(self.p["r"])
        near = np.column_stack((self.p["r"] * self.p["c"][0], np.ones(v, np.float32)))
        far = np.column_stack((self.p["r"] * self.p["c"][1], np.zeros(v, np.float32)))
        nodes = np.column_stack((self.p["q"], self.p["b"]))
        nodes[BEGIN, -1] = -1e4
        path = sum(nodes.take(np.arange(v) // span + before, 0) for span, before in zip(self.span, self.before, strict=False))
        return near, far, path, nodes


def _log_total(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exp(h . q) over the rows of q."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        x = h @ q.T
        total = np.exp(x) @ np.ones(len(q), np.float32)
        if 0 < total.min() <= total.max() < np.inf:
            return np.log(total)
        top = x.max(1)  # out of range: relative to the largest
        return np.log(np.exp(x - top[:, None]).sum(1)) + top


def _order(at: np.ndarray) -> np.ndarray:
    """Places in the order of the indices; two bytes are sorted without comparisons."""
    return np.argsort(at.astype(np.uint16) if 0 <= at.min() and at.max() < 1 << 16 else at, kind="stable")


def _rows(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct indices, the sums of their rows of g, and how often they occur. Most occur once, and such a row is its own sum."""
    order = _order(at)
    at = at.take(order)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    times = np.diff(np.append(first, len(at)))
    out, many = g.take(order.take(first), 0), times > 1
    if many.any():
        n = times[many]
        out[many] = np.add.reduceat(g.take(order[np.repeat(many, times)], 0), np.cumsum(n) - n, axis=0)
    return at.take(first), out, times


def contexts(ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """(n, 2): the word before and the one before that, in one text, or in texts of so many words that lie end to end."""
    pad = np.concatenate((np.full(2, BEGIN, ids.dtype), ids))
    out = np.stack((pad[1:-1], pad[:-2]), 1)
    if sizes is not None and len(sizes):
        start = np.cumsum(sizes) - sizes
        out[start[sizes > 0]] = BEGIN
        out[start[sizes > 1] + 1, 1] = BEGIN
    return out


def token_lists(texts, most: int):
    """(tokens of whole texts end to end, tokens of each text), at least `most` tokens at a time where there are as many."""
    tokens, sizes = [], []
    for text in texts:
        words = ascii_words(text)
        tokens += words
        tokens.append(END)
        sizes.append(len(words) + 1)
        if len(tokens) >= most:
            yield tokens, np.array(sizes)
            tokens, sizes = [], []
    if sizes:
        yield tokens, np.array(sizes)


def train_model(train: DataFrame, vocabulary: Vocabulary, dense: int = DENSE) -> LogBilinear:
    """NCE over the texts of every task. A task sends the rows that it used: word or node (-1: context matrices), uses, values."""
    spark = train.sparkSession
    model = LogBilinear(vocabulary.unigram, dense=dense)
    sent = spark.sparkContext.broadcast(vocabulary.model())
    v, width = len(model.p["r"]), 2 * WIDTH + 1
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64()), ("w", pa.binary())])

    def task(batches):
        vocab = sent.value
        m = LogBilinear(vocab.unigram, dense=dense)
        rng, ctx, tgt, held, n, again = np.random.default_rng(TaskContext.get().partitionId()), [], [], 0, 0, []

        def learn():
            c, t = np.concatenate(ctx), np.concatenate(tgt)
            for s in range(0, len(t), BATCH):
                m.step(c[s : s + BATCH], t[s : s + BATCH], rng)
            if n <= PASS_TOKENS:
                again.append((c, t))
            else:
                again.clear()
            return len(t)

        for batch in batches:
            for tokens, sizes in token_lists(text_bytes(batch.column("text")), 16 * BATCH):
                ids = vocab.model_ids(vocab.ids(tokens))
                near = contexts(ids, sizes)
                for s in range(0, len(ids), 1 << 16):
                    ctx.append(near[s : s + (1 << 16)])
                    tgt.append(ids[s : s + (1 << 16)])
                    held += len(tgt[-1])
                    if held >= 16 * BATCH:
                        n, ctx, tgt, held = n + learn(), [], [], 0
        if held:
            n += learn()
        if n:
            for _ in range(min(PASSES, -(-PASS_TOKENS // n)) - 1 if n <= PASS_TOKENS else 0):
                for c, t in again:
                    for s in range(0, len(t), BATCH):
                        m.step(c[s : s + BATCH], t[s : s + BATCH], rng)
            yield pack(np.array([-1]), np.array([n]), np.column_stack((m.p["c"].reshape(1, -1), [[0.0]])))
            used = np.flatnonzero(m.uses >= USES)
            for s in range(0, len(used), 10_000):
                at = used[s : s + 10_000]
                r = np.zeros((len(at), WIDTH), np.float32)
                r[at < v] = m.p["r"][at[at < v]]
                yield pack(at, m.uses[at], np.column_stack((r, m.p["q"][at], m.p["b"][at])))

    def pack(at, n, w):
        w = np.ascontiguousarray(w, np.float32)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in w], pa.binary())], schema=schema)

    def add(batches):
        held, rows = [], 0

        def merged():
            at, w, _ = _rows(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return [(at, w)], len(at)

        limit = 50_000
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy().astype(np.float64)[:, None]
                w = np.frombuffer(b"".join(batch.column("w").to_pylist()), np.float32).reshape(-1, width)
                held.append((batch.column("id").to_numpy(), np.column_stack((w * n, n))))
                rows += batch.num_rows
                if rows > limit:
                    held, rows = merged()
                    limit = 50_000 + 2 * rows
        if held:
            (at, w), = merged()[0]
            yield pack(at, w[:, -1], w[:, :-1] / w[:, -1:])

    ddl = "id int, n long, w binary"
    rows = materialize(train.select("text").mapInArrow(task, ddl).repartition("id").mapInArrow(add, ddl), "parameters").select("id", "w").toArrow()
    if rows.num_rows:
        at = rows.column("id").to_numpy()
        w = np.frombuffer(b"".join(rows.column("w").to_pylist()), np.float32).reshape(-1, width)
        word, target = (at >= 0) & (at < v), at >= 0
        model.p["r"][at[word]] = w[word, :WIDTH]
        model.p["q"][at[target]], model.p["b"][at[target]] = w[target, WIDTH:-1], w[target, -1]
        model.p["c"] = w[at < 0][0, :-1].reshape(2, WIDTH)
    model.sq = model.uses = model.log_noise = None
    sent.unpersist()
    return model


def frequent_words(words: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """Words, most frequent first, that occur often enough for at most `most` of them to do so, whatever the ties; no task holds more than it sends."""
    step = F.floor(F.log2("n") * 16).cast("int")
    least, room = 1, most
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top")).orderBy(F.desc("step")).collect():
        room -= r.k
        if room < 0:
            least = r.top + 1
            break
    top = words.where(F.col("n") >= least).toArrow()
    names, counts = top.column("word").to_pylist(), top.column("n").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
    return [names[i] for i in order], [counts[i] for i in order]


def score_documents(docs: DataFrame, folds: int = 10, top_words: int = TOP_WORDS, vocab_scale: float = VOCAB_SCALE, dense: int = DENSE) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), "text")
    train = marked.where(~F.col("held_out"))
    words = count_words(train)
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    wanted = min(total.v, max(dense - FIRST, int(vocab_scale * np.sqrt(total.n or 0))))
    names, counts = frequent_words(words, max(top_words, wanted))
    inside = min(wanted, len(names))
    if END not in names:  # no training document, or too many words as frequent as the end
        known = words.where(F.col("word") == F.lit(END)).first()
        names, counts = [*names, END], [*counts, known.n if known else 0]
    vocab = Vocabulary(names, counts, total.n or 0, total.v, inside)
    model = train_model(train, vocab, dense)
    sent = spark.sparkContext.broadcast((vocab, model))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("tf", pa.int64())])

    def task(batches):
        v, m = sent.value
        for batch in batches:
            row = 0
            for tokens, sizes in token_lists(text_bytes(batch.column("text")), SCORED):
                rows, k = batch.slice(row, len(sizes)), len(sizes)
                row += k
                ids, of = v.ids(tokens), np.repeat(np.arange(k), sizes)
                known = np.flatnonzero(ids >= 0)
                at, top, place = ids.take(known), v.model_ids(ids), of.take(known)
                n_known, base = np.bincount(place, v.counts.take(at) > 0, k).astype(np.int64), np.bincount(place, v.base.take(at), k)
                rare = at >= v.inside
                ctx = contexts(top, sizes)
                logs = np.concatenate([m.log_probs(ctx[s : s + SCORED], top[s : s + SCORED]) for s in range(0, len(top), SCORED)])
                score = np.bincount(of, logs, k) + np.bincount(place[rare], v.within.take(at[rare]), k)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("rid", "doc_id", "held_out")), *map(pa.array, (sizes, n_known, base, score)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], schema=schema)
                lost = np.flatnonzero(ids < 0)
                if len(lost):
                    tf = Counter(zip(of.take(lost).tolist(), map(tokens.__getitem__, lost.tolist()), strict=True))
                    n, none = len(tf), [pa.nulls(len(tf), f.type) for f in list(schema)[1:7]]
                    rid = rows.column("rid").to_numpy().take(np.fromiter((r for r, _ in tf), np.int64, n))
                    yield pa.RecordBatch.from_arrays([pa.array(rid), *none, pa.array([w for _, w in tf], pa.binary()), pa.array(list(tf.values()), pa.int64())], schema=schema)

    ddl = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, tf long"
    scored = materialize(marked.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(task, ddl), "scored")
    n = F.coalesce("n", F.lit(0)).cast("long")
    tail = scored.where("word is not null").select("rid", "word", "tf").join(words, "word", "left")
    log = F.log10(n + SMOOTH)
    tail = tail.groupBy("rid").agg(
        F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * (log - vocab.base_log_total)).alias("b"),
        F.sum(F.col("tf") * (log - vocab.unknown_log_total)).alias("s"),
    )
    both = scored.where("word is null").drop("word", "tf").join(tail, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).cast("long").alias("n_known"), F.lit(total.n or 0).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))
