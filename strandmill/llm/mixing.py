"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Target words per source come from weights, capped at a multiple of the source's
own size, the excess reshared. Every source is put in a random order (a 60-bit
key of the md5 of its identifiers) and cut into blocks of that order. A target
is met by whole passes over the source and a prefix of the order for the rest.
The drawn blocks of all sources form the root of a binary tree over the output
shards; every node draws its left child's exact block quotas from a
multivariate hypergeometric distribution, down to subtrees on the driver and
below them in tasks. Shards then own disjoint runs of permuted blocks, which an
equi-join deals to them, one partition a shard, and are shuffled locally by a
second key.

The prefix is found by narrowing: words are summed per sub-range of the order,
the range in which a source's rest ends is cut again, so no source is ever
sorted or gathered in one task.

Defined results: null text has size 0; the null source is a source of its own,
last in order; a source of size 0 has target 0 and its rows are not drawn; rows
that repeat a doc_id within a source share a key and are drawn alike; an empty
table gives an empty mix. Seeds are fixed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, word_count

#: Bits of the permutation key, bits cut a step, and rows below which the last range is summed row by row.
KEY_BITS, STEP_BITS, LEAF_ROWS = 60, 10, 4096
#: Sources up to which weights and quotas are computed on the driver (some 50 bytes each); beyond, tables are used.
DRIVER_SOURCES = 100_000
#: Least bits of a source's blocks; words of an output shard and shards at most, where their number isn't given (layout only: nothing is left out).
BLOCK_BITS, SHARD_WORDS, SHARDS = 8, 8_000_000, 65_536
#: Shards times sources of a tree that the driver splits itself, and rows of a dealt table that are broadcast at most.
DRIVER_CELLS, BROADCAST_ROWS = 2_000_000, 500_000
PLAN = "src string, sid long, weight double, source_size long, n long, target double"


def order_key(seed: str, *cols: Column) -> Column:
    text = F.concat_ws("\x1f", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def fill_targets(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above cap * size, the excess reshared by weight until none is above."""
    sizes, limit = sizes.astype(float), cap * sizes.astype(float)
    target, total = np.zeros(len(sizes)), sizes.sum()
    free = np.ones(len(sizes), bool)
    while free.any():
        rate = max(0.0, total - limit[~free].sum()) / weights[free].sum()
        over = free & (rate * weights > limit)
        if not over.any():
            target[free] = rate * weights[free]
            break
        free &= ~over
    target[~free] = limit[~free]
    return target


def plan_sources(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """PLAN rows: a source's rank by code point (null last), weight (repeating), size, rows, target. sizes: src, source_size, n."""
    spark = sizes.sparkSession
    if sizes.count() <= driver_sources:
        rows = sorted(sizes.collect(), key=lambda r: (r.src is None, r.src or ""))
        w = np.array([weights[i % len(weights)] for i in range(len(rows))], float)
        t = fill_targets(np.array([r.source_size for r in rows], float), w, cap)
        return spark.createDataFrame([(r.src, i, float(w[i]), r.source_size, r.n, float(t[i])) for i, r in enumerate(rows)], PLAN)
    # more sources than the driver should hold: rank by range partitions, then reshare by repeated sums
    n = spark.sparkContext.defaultParallelism
    parts = materialize(sizes.repartitionByRange(n, F.col("src").asc_nulls_last()).sortWithinPartitions(F.col("src").asc_nulls_last()).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "sources")
    before, at = 0, []
    for r in sorted(parts.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("lo")).collect(), key=lambda r: r.p):
        at.append((r.p, before - r.lo))
        before += r.k
    ranked = parts.join(F.broadcast(spark.createDataFrame(at, "p int, off long")), "p").withColumn("sid", F.col("m") + F.col("off"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("src", "sid", w.alias("weight"), "source_size", "n"), "ranked")
    limit, total, rate, last = F.lit(cap) * F.col("source_size"), ranked.agg(F.sum("source_size")).first()[0], 0.0, None
    while True:
        capped = F.lit(rate) * F.col("weight") > limit if last is not None else F.lit(False)
        r = ranked.agg(F.sum(F.when(capped, limit).otherwise(0.0)).alias("held"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w"), F.count(F.when(capped, 1)).alias("k")).first()
        if r.k == last or not r.w:
            break
        last, rate = r.k, max(0.0, total - r.held) / r.w
    return ranked.withColumn("target", F.least(F.lit(rate) * F.col("weight"), limit))


def find_cuts(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with passes (whole passes), cut (keys below it are drawn once more) and cut_id (of the rows at the cut: ids up to it).

    keyed: src, doc_id, size, key. A row is drawn while at least half of it fits
    in the rest, so a source ends within half a document of its target.
    """
    small = plan.count() <= DRIVER_SOURCES
    send = F.broadcast if small else (lambda x: x)  # one short row a source
    same = keyed["src"].eqNullSafe(F.col("p.src"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = materialize(plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("lo", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("double")), "cuts")
    bits = KEY_BITS
    while bits > 0:
        bits -= STEP_BITS
        # only rows of the range that holds the end of a source's rest, summed by sub-range: at most 2**STEP_BITS a source
        inside = keyed.join(send(state.select("src", "lo").alias("p")), same & (F.shiftright("key", bits + STEP_BITS) == F.shiftright("lo", bits + STEP_BITS)), "inner")
        sums = inside.groupBy(keyed["src"].alias("s"), F.shiftright("key", bits).alias("sub")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("s").orderBy("sub")
        run = sums.withColumn("upto", F.sum("w").over(order)).withColumn("below", F.col("upto") - F.col("w"))
        hit = run.join(send(state.alias("p")), F.col("s").eqNullSafe(F.col("p.src"))).where("used + below < rest and (used + upto >= rest)")
        hit = hit.groupBy("p.src").agg(F.min(F.struct("sub", "below", "rows")).alias("h")).select(F.col("src").alias("hs"), "h.*")
        state = state.join(hit, F.col("src").eqNullSafe(F.col("hs")), "left")
        state = state.withColumn("lo", F.coalesce(F.shiftleft("sub", bits), F.col("lo"))).withColumn("used", F.col("used") + F.coalesce("below", F.lit(0)))
        state = materialize(state.withColumn("leaf", F.coalesce("rows", F.lit(0))).drop("hs", "sub", "below", "rows"), "cuts")
        if (state.agg(F.max("leaf")).first()[0] or 0) <= LEAF_ROWS:
            break
        state = state.drop("leaf")
    leaf = keyed.join(send(state.select("src", "lo", "used", "rest").alias("p")), same & (F.shiftright("key", bits) == F.shiftright("lo", bits)) & (F.col("rest") > 0), "inner")
    ids = leaf.groupBy(keyed["src"].alias("s"), "key", "doc_id", "used", "rest").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_first())
    drawn = ids.withColumn("mid", F.col("used") + F.sum("size").over(order) - F.col("size") / 2).where("mid <= rest")
    last = drawn.groupBy("s").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("end"))
    state = state.join(last, F.col("src").eqNullSafe(F.col("s")), "left")
    none = F.col("end").isNull()
    cut = F.when(F.col("rest") <= 0, F.lit(-1)).when(none, F.col("lo") - 1).otherwise(F.col("end.key"))
    return state.select("src", "sid", "weight", "source_size", "n", "target", "passes", cut.cast("long").alias("cut"), F.when(none, F.lit(2**63 - 1)).otherwise(F.col("end.id")).alias("cut_id"))


def subtree(have: np.ndarray, total: int, shards: int, lo: int, hi: int, seed: int, leaf: int = 1):
    """(first shard, end, block quotas) of the nodes of at most leaf shards below the node of the shards lo to hi - 1, in shard order.

    A node draws its left child's quotas from the multivariate hypergeometric
    distribution by a seed of its own, so driver and tasks draw alike. total:
    blocks of the whole tree, which its shards share to within one.
    """
    todo = [(lo, hi, have)]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo <= leaf:
            yield lo, hi, have
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, total * mid // shards - total * lo // shards, method="marginals")
        todo += [(mid, hi, have - left), (lo, mid, left)]


def split_tree(quotas: np.ndarray, shards: int, seed: int = 7) -> np.ndarray:
    """Matrix (shards, sources) of block quotas: rows have the same sum to within one, columns sum to quotas."""
    quotas = quotas.astype(np.int64)
    return np.stack([have for _, _, have in subtree(quotas, int(quotas.sum()), shards, 0, shards, seed)])


def deal_blocks(cuts: DataFrame, shards: int, block_bits: int, seed: int = 7, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Rows (sid, from, to, shard): which draws of a source's permuted blocks a shard owns.

    One number a source passes the driver. A tree of more than driver_cells
    shards times sources is split there down to a few subtrees only, which
    tasks split further.
    """
    spark, size = cuts.sparkSession, 1 << block_bits
    ddl = "sid long, from long, to long, shard int"
    quota = F.when(F.col("source_size") > 0, F.col("passes") * size + F.when(F.col("cut") >= 0, F.shiftright("cut", KEY_BITS - block_bits) + 1).otherwise(0)).otherwise(0)
    rows = cuts.select("sid", quota.alias("q")).where("q > 0").orderBy("sid").collect()
    sids, quotas = np.array([r.sid for r in rows], np.int64), np.array([r.q for r in rows], np.int64)
    total = int(quotas.sum())
    if not total:
        return spark.createDataFrame([], ddl)
    if shards * len(rows) <= driver_cells:
        deal = split_tree(quotas, shards, seed)
        ends = deal.cumsum(0)
        at, own = np.nonzero(deal)
        out = zip(sids[own].tolist(), (ends - deal)[at, own].tolist(), ends[at, own].tolist(), at.tolist(), strict=True)
        return spark.createDataFrame(list(out), ddl)
    parts, before = [], np.zeros(len(quotas), np.int64)
    for lo, hi, have in subtree(quotas, total, shards, 0, shards, seed, leaf=max(1, -(-shards // max(2, driver_cells // len(rows) // 2)))):
        parts.append((lo, hi, have.tobytes(), before.tobytes()))
        before = before + have
    schema = pa.schema([("sid", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("shard", pa.int32())])

    def task(batches):
        for batch in batches:
            for lo, hi, have, start in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "have", "start")), strict=True):
                start = np.frombuffer(start, np.int64)
                for shard, _, own in subtree(np.frombuffer(have, np.int64), total, shards, lo, hi, seed):
                    k = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(sids[k]), pa.array(start[k]), pa.array((start + own)[k]), pa.array(np.full(len(k), shard, np.int32))], schema=schema)
                    start = start + own

    return spark.createDataFrame(parts, "lo int, hi int, have binary, start binary").repartition(min(len(parts), 64)).mapInArrow(task, ddl)


def mix(docs: DataFrame, source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(keyed, cuts): the slim table src, doc_id, size, key, rid (a number) of all rows, and the plan with its cuts."""
    keyed = materialize(docs.select(F.col(source).cast("string").alias("src"), "doc_id", word_count(F.col("text")).alias("size"), order_key(seed, F.col(source), F.col("doc_id")).alias("key"), F.monotonically_increasing_id().alias("rid")), "sizes")
    sizes = materialize(keyed.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "totals")
    return keyed, find_cuts(keyed, plan_sources(sizes, weights, cap))


def draws(key: Column, doc_id: Column) -> Column:
    """How often a row is drawn, given its source's passes, cut and cut_id."""
    once = (key < F.col("cut")) | ((key == F.col("cut")) & (F.coalesce(doc_id, F.lit(-(2**63))) <= F.col("cut_id")))
    return F.when(F.col("source_size") > 0, F.col("passes") + F.when(once, 1).otherwise(0)).otherwise(0).cast("long")


def mix_counts(docs: DataFrame, source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, times, key."""
    keyed, cuts = mix(docs, source, weights, cap, seed)
    small = cuts.count() <= DRIVER_SOURCES
    side = (F.broadcast(cuts) if small else cuts).alias("p")
    rows = keyed.join(side, keyed["src"].eqNullSafe(F.col("p.src")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * draws(F.col("key"), F.col("doc_id"))).alias("taken"), draws(F.col("key"), F.col("doc_id")).alias("times"), "key")


def mix_rows(docs: DataFrame, shards: int | None = None, source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", shard_column: str | None = "shard") -> DataFrame:
    """The mix itself: the columns of docs, a row per draw, and its shard under shard_column (None: without it); each shard is one partition in a shuffled order of its own."""
    if shard_column and shard_column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {shard_column} already; name another shard_column")
    _, cuts = mix(docs, source, weights, cap, seed)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).cast("string").alias("s"), F.col("doc_id").alias("id"), order_key(seed, F.col(source), F.col("doc_id")).alias("key"))
    return deal_rows(own, cuts, shards, seed).select("row.*", *([F.col("shard").alias(shard_column)] if shard_column else []))


def dealt_counts(docs: DataFrame, shards: int | None = None, source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, times, key, as counted from the draws that the shards of the mix hold."""
    keyed, cuts = mix(docs, source, weights, cap, seed)
    own = keyed.select(F.struct("rid").alias("row"), F.col("src").alias("s"), F.col("doc_id").alias("id"), "key")
    drawn = materialize(deal_rows(own, cuts, shards, seed).select("row.rid", "shard"), "draws")
    times = drawn.groupBy("rid").agg(F.count(F.lit(1)).alias("k"))
    side = (F.broadcast(cuts) if cuts.count() <= DRIVER_SOURCES else cuts).alias("p")
    rows = keyed.join(side, keyed["src"].eqNullSafe(F.col("p.src"))).join(times, "rid", "left")
    k = F.coalesce("k", F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * k).alias("taken"), k.alias("times"), "key")


def deal_rows(own: DataFrame, cuts: DataFrame, shards: int | None, seed: str) -> DataFrame:
    """row and shard, a row per draw of own (row, s, id, key): a shard is a partition, shuffled within."""
    n = cuts.count()
    words = cuts.agg(F.sum("target")).first()[0] or 0
    shards = shards or min(SHARDS, max(16, -(-int(words) // SHARD_WORDS)))
    # blocks fine enough for the shards to differ, and some two million of all sources at most
    bits = max(1, min(max(BLOCK_BITS, int(np.log2(16 * shards))), int(np.log2(max(2, 2_000_000 // max(1, n))))))
    deal = materialize(deal_blocks(cuts, shards, bits).select(F.col("sid").alias("_sid"), F.explode(F.sequence("from", F.col("to") - 1)).alias("_draw"), "shard"), "deal")
    side = (F.broadcast(cuts) if n <= DRIVER_SOURCES else cuts).select("src", "sid", "source_size", "passes", "cut", "cut_id").alias("p")
    rows = own.join(side, F.col("s").eqNullSafe(F.col("p.src"))).withColumn("times", draws(F.col("key"), F.col("id")))
    copies = rows.where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
    at = copies.withColumn("draw", F.col("pass") * (1 << bits) + F.shiftright("key", KEY_BITS - bits))
    dealt = at.join(F.broadcast(deal) if deal.count() <= BROADCAST_ROWS else deal, (F.col("sid") == F.col("_sid")) & (F.col("draw") == F.col("_draw")))
    local = order_key(seed + "-local", F.col("id"), F.col("pass"))
    return dealt.withColumn("local", local).repartitionById(shards, F.col("shard")).sortWithinPartitions("local").select("row", "shard")
