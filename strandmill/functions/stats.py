"""Columns for Fisher's exact test and linkage of two-by-two tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.dna import count_to, let

TOLERANCE = 1e-7


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-tailed p of the table ((a, b), (c, d)): tables no likelier than the observed one, judged relatively.

    Tables are weighed against the observed one by the ratio of neighbours, up
    and down from it, so a row costs as many steps as it has tables.
    """
    row = F.struct(a.cast("double").alias("a"), (a + b).cast("double").alias("r1"), (c + d).cast("double").alias("r2"), (a + c).cast("double").alias("c1"))

    def p_of(x: Column) -> Column:
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("le"), F.lit(0.0).alias("all"))

        def add(s: Column, w: Column) -> Column:
            return F.struct(w.alias("w"), (s["le"] + F.when(w <= 1 + TOLERANCE, w).otherwise(0.0)).alias("le"), (s["all"] + w).alias("all"))

        up_n = F.least(x["r1"], x["c1"]) - x["a"]
        down_n = x["a"] - F.greatest(x["c1"] - x["r2"], F.lit(0.0))
        up = lambda s, i: add(s, s["w"] * (x["r1"] - (x["a"] + i - 1)) * (x["c1"] - (x["a"] + i - 1)) / ((x["a"] + i) * (x["r2"] - x["c1"] + x["a"] + i)))
        down = lambda s, i: add(s, s["w"] * (x["a"] - i + 1) * (x["r2"] - x["c1"] + x["a"] - i + 1) / ((x["r1"] - (x["a"] - i)) * (x["c1"] - (x["a"] - i))))
        both = F.struct(F.aggregate(count_to(up_n), zero, up).alias("u"), F.aggregate(count_to(down_n), zero, down).alias("d"))
        return let(both, lambda t: F.least((1 + t["u"]["le"] + t["d"]["le"]) / (1 + t["u"]["all"] + t["d"]["all"]), F.lit(1.0)))

    return let(row, p_of)


def linkage(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Struct of d_prime, r_squared and molecules; null without variance at either site."""
    n = (both + first + second + neither).cast("double")
    p, q = F.try_divide(both + first, n), F.try_divide(both + second, n)
    vp, vq, d = p * (1 - p), q * (1 - q), F.try_divide(both, n) - p * q
    top = F.when(d >= 0, F.least(p * (1 - q), (1 - p) * q)).otherwise(F.least(p * q, (1 - p) * (1 - q)))
    clip = lambda x, lo: F.least(F.greatest(x, F.lit(lo)), F.lit(1.0))
    value = F.struct(clip(F.try_divide(d, top), -1.0).alias("d_prime"), clip(F.try_divide(d * d, vp * vq), 0.0).alias("r_squared"), n.cast("long").alias("molecules"))
    return F.when((n > 0) & (vp > 0) & (vq > 0) & (top > 0), value)
