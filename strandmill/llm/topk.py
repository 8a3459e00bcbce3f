"""Exact top-k inner-product search over norm-sorted, SVD-rotated vectors.

Vectors are integers (floor of a scaled component), so scores are exact.
Candidates are range-partitioned by dimension and descending length, a bounded
number of rows a partition, and each task walks its part in that order. Queries
are written in blocks of a bounded number of rows, a file each, in the shared
folder; a task reads one block after the other, so no query passes the driver
and no block is held by more than the tasks at work on it. Each query starts
from its k-th score among the longest vectors of the whole table. A batch is
skipped when |q| |v| can't reach it, and a candidate when the partial inner
product over the first rotated coordinates plus the product of the residual
lengths (Cauchy-Schwarz) can't; the others are scored exactly in integers.

The rotation comes from the singular vectors of a bounded sample (about SAMPLE
rows; any rotation prunes correctly), for the DIMENSIONS most frequent
dimensions; other ones are searched unrotated.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, nor do rows without an identifier; vectors of other dimensions
than a query's are no candidates of it; rows that repeat an identifier are
queries and candidates each for itself; an empty table gives no rows; scores
beyond a long are clipped to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, scratch_path

SAMPLE, SEEDS, QUERY_BLOCK, BATCH, DIMENSIONS = 4096, 2048, 4096, 2048, 16
#: Components of the vectors of one partition, which a task holds.
PART_CELLS = 8_000_000
#: Shares of the coordinates after which bounds are tested.
STAGES = (0.25, 0.5, 0.75)
VEC = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("v", pa.binary())])
VEC_DDL = "vec_id long, dim int, norm double, v binary"
LONG = 2**63


def as_integers(rows: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """VEC_DDL of the vectors that take part: floor(scale * x) as doubles that hold integers."""

    def task(batches):
        for batch in batches:
            col, ids = batch.column("vec"), batch.column("vec_id").to_pylist()
            dims = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()
            x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ok_flat = np.isfinite(x)
            ends = np.cumsum(dims)
            bad = np.concatenate(([0], np.cumsum(~ok_flat)))
            out = []
            for i, (e, d) in enumerate(zip(ends, dims, strict=True)):
                if ids[i] is None or not col[i].is_valid or bad[e] != bad[e - d]:
                    continue
                v = x[e - d : e]
                out.append((ids[i], int(d), float(np.sqrt((v * v).sum())), v.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), VEC, strict=True)], schema=VEC)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vec")).mapInArrow(task, VEC_DDL)


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim) if dim else np.zeros((len(raw), 0))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row integer inner products: in doubles where every partial sum is exact, else in Python integers, clipped to a long."""
    if not a.shape[0] or not a.shape[1]:
        return np.zeros(len(a), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return np.einsum("nd,nd->n", a, b).astype(np.int64)
    return np.array([max(-LONG, min(LONG - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


class Searcher:
    """A block of queries of one dimension with the rotation and the best k + 1 scores so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k + 1  # one more: a query's own row is taken out at the end
        self.rotation = rotation
        self.qr = q @ rotation
        self.norm = np.sqrt((q * q).sum(1))
        d = q.shape[1]
        self.cuts = sorted({max(1, int(d * s)) for s in STAGES if d > 1})
        self.rest = [np.sqrt(np.maximum(0, (self.qr[:, c:] ** 2).sum(1))) for c in self.cuts]
        self.floor = np.full(len(ids), -np.inf)

    def reach(self, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, candidate rows, scores) of the pairs that may be among the best."""
        vn = np.sqrt((v * v).sum(1))
        slack = 1e-9 * np.outer(self.norm, vn) + 1e-6
        live = np.outer(self.norm, vn) + slack >= self.floor[:, None]
        if not live.any():
            e = np.empty(0, np.int64)
            return e, e, e
        cols = np.flatnonzero(live.any(0))
        v, live, slack = v[cols], live[:, cols], slack[:, cols]
        vr = v @ self.rotation
        part, before = np.zeros(live.shape), 0
        for c, qrest in zip(self.cuts, self.rest, strict=True):
            part += self.qr[:, before:c] @ vr[:, before:c].T
            live &= part + np.outer(qrest, np.sqrt(np.maximum(0, (vr[:, c:] ** 2).sum(1)))) + slack >= self.floor[:, None]
            before = c
            keep = live.any(0)
            if keep.mean() < 0.7:
                cols, vr, v, live, slack, part = cols[keep], vr[keep], v[keep], live[:, keep], slack[:, keep], part[:, keep]
        qi, ci = np.nonzero(live)
        if not len(qi):
            return qi, ci, qi
        return qi, cols[ci], np.concatenate([exact_scores(self.q[qi[s : s + 65536]], v[ci[s : s + 65536]]) for s in range(0, len(qi), 65536)])

    def raise_floor(self, best: np.ndarray, qi: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """best: (queries, k) scores so far, descending; returns it with the new scores merged and raises the floor."""
        order = np.lexsort((-scores, qi))
        qi, scores = qi[order], scores[order]
        first = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1]))) if len(qi) else np.empty(0, np.int64)
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi)))) if len(qi) else qi
        near = place < self.k
        add = np.full(best.shape, -np.inf)
        add[qi[near], place[near]] = scores[near]
        best = -np.sort(-np.concatenate((best, add), 1), 1)[:, : self.k]
        self.floor = np.maximum(self.floor, best[:, -1])
        return best


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vector: str = "embedding", query_block: int = QUERY_BLOCK, part_cells: int = PART_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose identifier is divisible by every; ties to the smaller vec_id."""
    spark = rows.sparkSession
    plain = materialize(as_integers(rows, scale, vector), "integers")
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("dim", F.lit(1)).cast("long")).alias("cells"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    if not size.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = max(1, -(-size.cells // part_cells), min(spark.sparkContext.defaultParallelism, size.n // BATCH))
    # equal lengths are dealt by identifier, so that many copies of a vector spread over tasks
    order = [F.asc("dim"), F.desc("norm"), F.asc("vec_id")]
    vectors = materialize(plain.repartitionByRange(parts, *order).sortWithinPartitions(*order), "vectors")
    rotations, seeds = {}, {}
    for r in plain.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("norm", F.lit(max(0.0, 1 - SEEDS / size.n)), F.lit(10_000)).alias("long")).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect():
        same = plain.where(F.col("dim") == r.dim)
        share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(2**31)) < int(2**31 * min(1.0, SAMPLE / r.n))  # about SAMPLE rows, never more than a few above
        sample = _matrix([x.v for x in same.where(share).select("v").limit(2 * SAMPLE).collect()], r.dim)
        rotations[r.dim] = np.linalg.svd(sample.T @ sample)[0] if r.dim and len(sample) and np.isfinite(sample.T @ sample).all() else np.eye(r.dim)
        top = same.where(F.col("norm") >= r.long).select("vec_id", "v").limit(SEEDS).collect()
        seeds[r.dim] = (np.array([x.vec_id for x in top], np.int64), _matrix([x.v for x in top], r.dim))
    sent = spark.sparkContext.broadcast((rotations, seeds))
    at = _write_blocks(vectors.where(F.col("vec_id") % every == 0), size.q, sent, k, query_block)
    found = vectors.select("vec_id", "dim", "v").mapInArrow(_walk(at, sent, k), "qid long, query_id long, vec_id long, score long, own int")
    order = [F.desc("score"), F.asc("vec_id"), F.desc("own")]
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("place") <= k + 1)
    # of a query's copies (own = 1) one is itself
    mine = F.min(F.when(F.col("own") == 1, F.col("place"))).over(Window.partitionBy("qid"))
    kept = first.withColumn("mine", mine).where("mine is null or place <> mine")
    rank = F.col("place") - F.when(F.col("mine") < F.col("place"), 1).otherwise(0)
    return kept.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


BLOCK = pa.schema([("vec_id", pa.int64()), ("qid", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), ("floor", pa.float64())])


def _write_blocks(queries: DataFrame, n: int, sent, k: int, query_block: int) -> str:
    """Writes the queries, with the score that each has to reach, in files of at most query_block or so rows of few dimensions; returns the folder."""
    spark = queries.sparkSession
    blocks = max(1, -(-n // max(1, query_block * 7 // 8)))

    def task(batches):
        rotations, seeds = sent.value
        for batch in batches:
            ids, dims, raw = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            floor = np.full(len(ids), -np.inf)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                if d in rotations and len(seeds[d][0]):
                    for s in range(0, len(mine), query_block):
                        part = mine[s : s + query_block]
                        search = Searcher(ids[part], _matrix([raw[i] for i in part], d), rotations[d], k)
                        qi, _, score = search.reach(*seeds[d])
                        search.raise_floor(np.full((len(part), k + 1), -np.inf), qi, score)
                        floor[part] = search.floor
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "qid", "dim", "v")), pa.array(floor), batch.column("blk")], schema=BLOCK.append(pa.field("blk", pa.int32())))

    marked = queries.withColumn("qid", F.monotonically_increasing_id()).withColumn("blk", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    path = scratch_path(spark, "queries")
    marked.select("vec_id", "qid", "dim", "v", "blk").mapInArrow(task, "vec_id long, qid long, dim int, v binary, floor double, blk int").repartitionById(blocks, F.col("blk")).sortWithinPartitions("dim").drop("blk").write.parquet(path)
    return path


def _walk(path: str, sent, k: int):
    schema = pa.schema([("qid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.int32())])

    def task(batches):
        own: dict[int, list] = {}  # dimension to (ids, vectors) in order of length; bounded by the partition
        for batch in batches:
            ids, dims, raw = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                for s in range(0, len(mine), BATCH):
                    part = mine[s : s + BATCH]
                    own.setdefault(int(d), []).append((ids[part], _matrix([raw[i] for i in part], d)))
        if not own:
            return
        rotations, _ = sent.value
        files, folder = fs.FileSystem.from_uri(path)
        for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
            if not info.path.endswith(".parquet"):
                continue
            with files.open_input_file(info.path) as f:
                block = pq.read_table(f, schema=BLOCK)
            dims = block.column("dim").to_numpy()
            for d in np.unique(dims):
                if int(d) not in own:
                    continue
                t = block.filter(pa.array(dims == d))
                qid = t.column("qid").to_numpy()
                s = Searcher(t.column("vec_id").to_numpy(), _matrix(t.column("v").to_pylist(), d), rotations.get(int(d), np.eye(d)), k)
                s.floor = t.column("floor").to_numpy().copy()
                best, held = np.full((len(qid), k + 1), -np.inf), []
                for part, v in own[int(d)]:
                    qi, ci, score = s.reach(part, v)
                    if not len(qi):
                        continue
                    best = s.raise_floor(best, qi, score)
                    near = score >= s.floor[qi]
                    qi, ci, score = qi[near], ci[near], score[near]
                    same = (s.ids[qi] == part[ci]) & (s.q[qi] == v[ci]).all(1)
                    held.append((qi, part[ci], score, same))
                    if sum(len(h[0]) for h in held) > 1_000_000:
                        held = [_trim(held, k)]
                if held:
                    qi, vec, score, same = _trim(held, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[qi]), pa.array(s.ids[qi]), pa.array(vec), pa.array(score), pa.array(same.astype(np.int32))], schema=schema)

    return task


def _trim(held: list, k: int) -> tuple:
    """The best k + 1 of each query."""
    qi, vec, score, own = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((~own, vec, -score, qi))
    qi, vec, score, own = qi[order], vec[order], score[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1])))
    near = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi)))) <= k
    return qi[near], vec[near], score[near], own[near]
