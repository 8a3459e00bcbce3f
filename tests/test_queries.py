"""Queries against their SQL on the smallest tables, and the entry module."""

import os

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = """q01_reference_lookup q06_decompose_alleles q13_codon_mnv q18_hgvs q25_junction_codon_mnv q29_indel_overlap_flag q30_indel_protein_effect
q33_fallback_class q37_mnv_support q41_strand_bias_fisher q42_indel_support q50_info_string q52_contig_and_global_summary
q55_fasta_scan q57_vcf_scan q58_vcf_gzip_cohort q61_caller_table_scan q62_annotation_scan q68_normalise_alleles q84_number_texts
q91_bam_round_trip q92_bam_region q94_frameshift_rows q97_vcf_block_ranges q98_spliced_frame_rows q99_spliced_indel_nmd q100_phased_indel_effects q101_frameshift_phasing q104_supported_rows q105_fasta_regions""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    from strandmill.plans.catalogue import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    c = con.execute(ORACLES[name])
    cols = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(cols)
    assert table(df.collect(), df.columns) == table(c.fetchall(), cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_interval_join_is_not_nested_loops(spark):
    from strandmill.operators.intervals import interval_join

    left = spark.createDataFrame([("c", i * 700, i * 700 + 900, i) for i in range(50)], "contig string, a long, b long, i int")
    right = spark.createDataFrame([("c", j * 500, j * 500 + 3000, j) for j in range(60)], "contig string, x long, y long, j int")
    found = interval_join(left, right, "contig", "a", "b", "x", "y")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, j) for i in range(50) for j in range(60) if i * 700 <= j * 500 + 3000 and j * 500 <= i * 700 + 900)
    assert sorted((r.i, r.j) for r in found.collect()) == want
