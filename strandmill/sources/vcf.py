"""VCF text (plain, gzip or block gzip) to alleles. Plain and block-compressed files are read by many tasks each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.errors import EngineError, guards
from strandmill.functions.alleles import normalise
from strandmill.operators.filters import as_fraction, carried
from strandmill.operators.phase import parse_phase
from strandmill.sources.bgzf import SPLIT_BYTES, read_block_lines

IUPAC = "^[ACGTURYKMSWBDHVNacgturykmswbdhvn]+$"


def header(spark: SparkSession, path: str) -> list[str]:
    """Header lines; the last one names the columns."""
    if path.endswith(".bcf"):
        raise EngineError("BCF input is not read; convert it to VCF first", "E102", path=path)
    names = spark.read.format("binaryFile").load(path).select("path")
    first = names.agg(F.min("path")).first()[0]  # of several parts the first one holds the header
    top = spark.read.text(first or path).where("_metadata.file_block_start = 0")
    n = 1024
    while True:  # only the head of the file is read
        lines = [r.value for r in top.limit(n).collect()]
        at = next((i for i, x in enumerate(lines) if x.startswith("#CHROM")), None)
        if at is not None:
            return lines[: at + 1]
        if len(lines) < n or not lines[-1].startswith("#"):
            raise EngineError("VCF has no #CHROM line", "E102", path=path)
        n *= 8


def lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """value: lines of the files under a path; compressed ones by ranges of blocks."""
    zipped = F.col("path").rlike(r"\.b?gz$")
    kinds = [r[0] for r in spark.read.format("binaryFile").load(path).select(zipped).distinct().collect()]
    if kinds == [True]:
        return read_block_lines(spark, path, split_bytes)
    if True in kinds:
        raise EngineError("compressed and plain files are mixed under one path", "E102", path=path)
    return spark.read.text(path)


def missing_contigs(alleles: DataFrame, reference: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """contig and the source that lacks it ("reference" or "variants"): contigs of the alleles without a reference, and wanted ones without an allele."""
    have = alleles.select("contig").distinct()
    known = reference.select("contig").distinct()
    out = have.join(known, "contig", "left_anti").select("contig", F.lit("reference").alias("source"))
    if wanted:
        asked = alleles.sparkSession.createDataFrame([(c,) for c in wanted], "contig string")
        out = out.unionByName(asked.join(have, "contig", "left_anti").select("contig", F.lit("variants").alias("source")))
    return out


def samples(spark: SparkSession, path: str) -> list[str]:
    return next(x for x in header(spark, path) if x.startswith("#CHROM")).split("\t")[9:]


def info_numbers(lines: list[str]) -> dict[str, str]:
    """Number of each INFO key that is declared per allele (A, R, G)."""
    import re

    found = (re.match(r"##INFO=<ID=([^,]+),Number=([^,]+)", x) for x in lines)
    return {m[1]: m[2] for m in found if m and m[2] in "ARG"}


def _info(key: str) -> Column:
    return F.element_at("info_map", F.lit(key))


def _format(key: str) -> Column:
    return F.element_at("format_map", F.lit(key))


def _nth(text: Column, i: Column) -> Column:
    return F.nullif(F.get(F.split(text, ","), i.cast("int")), F.lit("."))


def _allele_fraction(ad: Column, ao: Column, ro: Column, i: Column) -> Column:
    """Alternate depth over all depth from AD, else from AO and RO."""
    total = lambda x: F.aggregate(F.split(x, ","), F.lit(0.0), lambda a, v: a + F.coalesce(v.try_cast("double"), F.lit(0.0)))
    by_ad = F.when((total(ad) > 0) & (F.size(F.split(ad, ",")) > 1), _nth(ad, i).try_cast("double") / total(ad))
    depth = total(ao) + ro.try_cast("double")
    return F.coalesce(by_ad, F.when(depth > 0, _nth(ao, i - 1).try_cast("double") / depth))


def read_vcf(spark: SparkSession, path: str, sample: str | None = None, split: bool = False, normalised: bool = False, keep_info: bool = False, contigs: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alleles: contig, record_id, pos, ref, alt, alt_index, odp, ofreq, oinfo, phase, genotype, and sample.

    sample: a name, None for the first one, or "all" for a row per sample that
    carries the allele. More than one ALT is an error unless split.
    """
    head = header(spark, path)
    names = next(x for x in head if x.startswith("#CHROM")).split("\t")[9:]
    if sample and sample != "all" and sample not in names:
        raise EngineError("no such sample in the VCF", "E102", sample=sample)
    body = lines(spark, path, split_bytes).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"), "value")
    f = lambda i: F.get("f", F.lit(i))
    rows = body.select(f(0).alias("contig"), f(1).try_cast("long").alias("pos"), f(3).alias("ref"), f(4).alias("alts"), f(7).alias("info"), f(8).alias("format"), F.slice("f", 10, 1_000_000).alias("calls"), F.xxhash64("value").alias("record_id"), F.size("f").alias("columns"))
    if contigs:
        rows = rows.where(F.col("contig").isin(*contigs))
    odd = F.exists(F.split("alts", ","), lambda a: ~a.rlike(IUPAC) & ~a.rlike("^<.*>$") & (a != "."))
    checks = [
        (F.col("columns") < 8, "VCF line has fewer than 8 columns", "E102"),
        (F.col("pos").isNull() | (F.col("pos") < 1), "VCF position is not 1 or more", "E102"),
        (~F.col("ref").rlike(IUPAC) | odd, "VCF allele is not made of bases", "E102"),
    ]
    if not split:
        checks.append((F.col("alts").contains(","), "VCF record has several ALT alleles; split them", "E102"))
    guards(rows, checks, ["contig", "pos", "ref", "alts"])
    rows = rows.drop("columns")
    if sample == "all":
        which = F.explode(F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("sample"), F.col("calls").alias("call")))
        rows = rows.withColumn("_s", which).select("*", "_s.sample", "_s.call").drop("_s", "calls")
    else:
        at = names.index(sample) if sample else 0
        rows = rows.withColumn("sample", F.lit(names[at] if names else None)).withColumn("call", F.get("calls", F.lit(at))).drop("calls")
    rows = rows.select("*", F.posexplode(F.split("alts", ",")).alias("_i", "alt")).withColumn("alt_index", F.col("_i") + 1).drop("_i", "alts")
    rows = rows.where("alt <> '.'")
    empty = F.expr("map()").cast("map<string,string>")
    rows = rows.withColumn("info_map", F.when(F.col("info") == ".", empty).otherwise(F.expr("map_from_entries(transform(array_distinct(transform(split(info, ';'), x -> split(x, '=', 2)[0])), k -> struct(k, try_element_at(split(filter(split(info, ';'), x -> split(x, '=', 2)[0] = k)[0], '=', 2), 2))))")))
    keys, vals = F.split("format", ":"), F.split("call", ":")
    rows = rows.withColumn("format_map", F.when(F.col("format").isNotNull() & F.col("call").isNotNull(), F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.get(vals, i)))).otherwise(empty))
    i = F.col("alt_index")
    freq = lambda get: F.coalesce(as_fraction(_nth(get("FREQ"), i - 1)), as_fraction(_nth(get("AF"), i - 1)), _allele_fraction(get("AD"), get("AO"), get("RO"), i))
    info_freq = F.coalesce(as_fraction(_nth(_info("AF"), i - 1)), as_fraction(_nth(_info("FREQ"), i - 1)), _allele_fraction(_info("AD"), _info("AO"), _info("RO"), i))
    rows = rows.withColumn("odp", F.coalesce(_format("DP").try_cast("long"), _info("DP").try_cast("long"))).withColumn("ofreq", F.coalesce(freq(_format), info_freq))
    rows = rows.withColumn("genotype", _format("GT")).where(carried(F.col("genotype"), i))
    rows = rows.withColumn("phase", parse_phase(F.col("genotype"), _format("PS"), i))
    if keep_info:
        from strandmill.sinks.vcf import subset_info

        rows = rows.withColumn("oinfo", subset_info(F.col("info"), info_numbers(head), i))
    else:
        rows = rows.withColumn("oinfo", F.lit(None).cast("string"))
    rows = rows.drop("info", "format", "call", "info_map", "format_map")
    return normalise(rows) if normalised else rows
