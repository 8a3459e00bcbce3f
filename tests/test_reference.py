"""The chunk table and what is cut from it."""

import os
import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_short_slices_from_pieces(spark):
    from strandmill.operators.reference import CHUNK, PIECE, chunk_sequences, lookup

    rng = random.Random(5)
    seq = "".join(rng.choice("ACGTé") for _ in range(2 * CHUNK + 700))
    edges = [1, 2, PIECE - 63, PIECE - 1, PIECE, PIECE + 1, CHUNK - 64, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK + 600, len(seq) - 1, len(seq), len(seq) + 1, len(seq) + PIECE + 5, 3 * CHUNK + 1, 0, -5]
    at = [(("c", "d")[i % 7 == 6], p) for i, p in enumerate(edges * 3 + [rng.randint(1, len(seq)) for _ in range(300)])]
    ref = chunk_sequences(spark.createDataFrame([("c", seq)], "contig string, seq string"))
    rows = spark.createDataFrame(at, "contig string, pos long")
    slices = {"a": (F.col("pos"), F.lit(3)), "b": (F.col("pos") + 2, F.lit(63))}
    whole = sorted(map(tuple, lookup(rows, ref, slices).collect()), key=str)
    seen = lookup(rows, ref, slices, reach=65)
    assert seen.columns == ["contig", "pos", "a", "b"]
    assert sorted(map(tuple, seen.collect()), key=str) == whole
    inside = [x for x in map(tuple, whole) if x[0] == "c" and 1 <= x[1] <= len(seq)]
    assert len(inside) > 250 and all(x[2:] == (seq[x[1] - 1 : x[1] + 2], seq[x[1] + 1 : x[1] + 64]) for x in inside)


def test_odd_codons(spark):
    from strandmill.functions import dna

    for table, residues in dna.GENETIC_CODES.items():
        codons = [x + y + z for x in "TCAG" for y in "TCAG" for z in "TCAG"]
        want = dict(zip(codons, residues, strict=True)) | dict.fromkeys(["", "T", "TT", "TTTT", "TTN", "T,T", ",TT", "TT,", "TTT,TTC", None], "X") | {"aug": residues[codons.index("ATG")], "uUu": residues[0]}
        rows = spark.createDataFrame([(c,) for c in want], "c string").select("c", dna.codon_residue(F.col("c"), table).alias("r")).collect()
        assert {r.c: r.r for r in rows} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_derived_reference(spark):
    """The bases are those of the SQL, and the genome is never broadcast, whatever the planner takes its size for."""
    from strandmill.plans.catalogue import QUERIES
    from strandmill.plans.fixture import Genome, refbase

    ref = Genome(spark, SF).reference()
    bases = ref.selectExpr("contig", "cast(contig as int) as chrom", "posexplode(split(seq, '')) as (i, base)", "chunk_start").withColumn("pos", F.expr("chunk_start + i"))
    clen = Genome(spark, SF).relation("dims").first()[0]
    assert bases.where(F.expr(f"base <> {refbase('pos', 'chrom', 'div')}")).isEmpty()
    assert bases.select("contig", "pos").distinct().count() == 5 * clen == bases.where("i < 16384").count()
    for name, joins in (("q83_change_type_texts", 1), ("q69_left_anchor_insertions", 0)):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= joins, name  # the genes may be sent
