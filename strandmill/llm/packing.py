"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Pieces are dealt by hash into groups of a bounded number of pieces; each group
is packed by best-fit decreasing: a piece goes to the open bin with the least
room that holds it. Where none does, a new bin opens at the permitted length of
least expected cost per word: for each length the pieces still to come are
filled in greedily, and the cost of the bin, downsized to that content, is
divided by the content. So a length is only opened if what is left can use it.
Bins are finally downsized to the smallest length that holds their contents. A
group is packed once for every largest length that may be opened, and the
cheapest of the plans is kept. Cost of a bin: its length plus a fixed overhead
for a sequence.

Documents longer than the largest length are cut into pieces of that length and
a rest; nothing is dropped. Defined results: null text is empty; a document of
size 0 gives one piece of size 0 in no bin (bin_id null, capacity 0); repeated
rows, and rows without an identifier, are packed each for itself; among pieces
of one length the smaller identifier goes first, null last; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
GROUP_PIECES = 4096
OUT = "doc_id long, piece int, start long, length long, bin_id long, capacity long, bin_offset long"


def _cost(capacity: int, overhead: int) -> int:
    return capacity + overhead


def opening(i: int, falling: list[int], sizes: list[int], rest: list[int], fits: list[int], capacities: tuple[int, ...], overhead: int) -> int:
    """The length of least expected cost per word for a bin that opens with piece i.

    sizes are in decreasing order, falling are their negatives, rest[j] is the
    sum of sizes[j:]; fits are the lengths that may be opened.
    """
    best = None
    for c in fits:
        room, j = c - sizes[i], i + 1
        while True:
            j = bisect_left(falling, -room, j)  # the largest of the pieces to come that fits
            if j == len(sizes):
                break
            if rest[j] <= room:
                room -= rest[j]
                break
            room -= sizes[j]
            j += 1
        fill = c - room
        cost = _cost(next(x for x in capacities if x >= fill), overhead) / fill
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def best_fit(sizes: list[int], allowed: tuple[int, ...], capacities: tuple[int, ...], overhead: int) -> tuple[int, list[int], list[int]]:
    """(cost, bin of each piece, capacity of each bin). sizes are positive and in decreasing order; only allowed lengths are opened where they hold the piece."""
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    opened: list[int] = []
    where = []
    falling, rest = [-s for s in sizes], list(accumulate(reversed(sizes), initial=0))[::-1]
    for i, s in enumerate(sizes):
        k = bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            fits = [c for c in allowed if c >= s] or [min(c for c in capacities if c >= s)]
            room = opening(i, falling, sizes, rest, fits, capacities, overhead)
            b = len(opened)
            opened.append(room)
        where.append(b)
        insort(free, (room - s, b))
    filled = [0] * len(opened)
    for s, b in zip(sizes, where, strict=True):
        filled[b] += s
    final = [min(c for c in capacities if c >= f) for f in filled]
    return sum(_cost(c, overhead) for c in final), where, final


def pack_group(pieces: pd.DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> pd.DataFrame:
    """Bins of one group: all choices of the largest length that may be opened are tried, the cheapest is kept."""
    p = pieces.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = p["length"].astype(int).tolist()
    cost, where, final = min((best_fit(sizes, capacities[: i + 1], capacities, overhead) for i in range(len(capacities))), key=lambda x: x[0])
    group = int(p["grp"].iloc[0])
    p["bin"] = where
    p["bin_offset"] = p.groupby("bin")["length"].cumsum() - p["length"]
    return pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "piece": p["piece"], "start": p["start"], "length": p["length"], "bin_id": group * 1_000_000 + p["bin"], "capacity": [final[b] for b in where], "bin_offset": p["bin_offset"]})


def pack(sized: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """sized: doc_id, size. One row per piece: OUT. bin_id is unique over all groups."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    last = F.greatest(F.ceil(F.col("size") / top), F.lit(1)).cast("int") - 1
    pieces = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = materialize(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(top)).cast("long").alias("length"), F.rand(11).alias("r")), "pieces")
    full = pieces.where("length > 0")
    groups = max(1, -(-full.count() // group_pieces))
    keyed = full.withColumn("grp", F.floor(F.col("r") * groups).cast("long")).drop("r")
    packed = keyed.groupBy("grp").applyInPandas(lambda p: pack_group(p, capacities, overhead), OUT)
    none = pieces.where("length = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("capacity"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """pack() of the word counts of whole texts."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("size")), capacities, overhead)
