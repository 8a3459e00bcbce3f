"""VCF records and INFO text of annotated rows, and the text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.reference import lookup

#: INFO keys of the engine in order.
INFO_KEYS = "GENE AA CT TYPE SO IMPACT GD MNVSHIFT DBS MNVPS MNVPR DPHASE LD LDP FSPH NMD HGVSG HGVSC SR SRF SRR MR MRF MRR SBP MSBP EC COMP ODP OFREQ DP FREQ ER ERF ERR EDP EFREQ".split()
ESCAPES = (("%", "%25"), (";", "%3B"), ("=", "%3D"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def escape(value: Column, keep_commas: bool = False) -> Column:
    for a, b in ESCAPES:
        if a == "," and keep_commas:
            continue
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def info_text(values: dict[str, Column], original: Column | None = None) -> Column:
    """KEY=value joined by semicolons in the order of INFO_KEYS; nulls are left out, an empty value writes the bare key."""
    parts = []
    for k in INFO_KEYS:
        if k in values:
            v = values[k]
            parts.append(F.when(v.isNull(), F.lit(None).cast("string")).when(v == "", k).otherwise(F.concat(F.lit(f"{k}="), escape(v))))
    if original is not None:
        own = F.filter(F.split(original, ";"), lambda x: ~F.split(x, "=")[0].isin(*INFO_KEYS))
        parts.append(F.when(F.size(own) > 0, F.array_join(own, ";")))
    return F.concat_ws(";", *parts)


def subset_info(info: Column, numbers: dict[str, str], alt_index: Column) -> Column:
    """INFO of one allele: Number=A takes its value, R the reference's and its own, G goes; the rest stays. alt_index counts from 1."""
    def one(x: Column) -> Column:
        key, values = F.split(x, "=", 2)[0], F.split(F.split(x, "=", 2)[1], ",")
        of = lambda n: key.isin(*[k for k, v in numbers.items() if v == n]) if any(v == n for v in numbers.values()) else F.lit(False)
        i = alt_index.cast("int")
        a = F.concat(key, F.lit("="), F.coalesce(F.get(values, i - 1), F.lit(".")))
        r = F.concat(key, F.lit("="), F.get(values, F.lit(0)), F.lit(","), F.coalesce(F.get(values, i), F.lit(".")))
        return F.when(of("G"), F.lit(None).cast("string")).when(of("A") & x.contains("="), a).when(of("R") & x.contains("="), r).otherwise(x)

    return F.array_join(F.array_compact(F.transform(F.split(info, ";"), one)), ";")


def expand_records(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """A record per base of each codon row, and for rows of several bases one record that spans them: contig, pos, ref, alt, type added."""
    one = F.transform("snvs", lambda s: F.struct(s["pos"].alias("pos"), s["ref"].alias("ref"), s["alt"].alias("alt"), F.lit("SNP").alias("type")))
    lo, hi = F.array_min(F.transform("snvs", lambda s: s["pos"])), F.array_max(F.transform("snvs", lambda s: s["pos"]))
    seen = lookup(rows.withColumn("_lo", lo).withColumn("_hi", hi), reference, {"_span": (F.col("_lo"), F.col("_hi") - F.col("_lo") + 1)})
    alt = F.aggregate("snvs", F.col("_span"), lambda c, s: F.overlay(c, s["alt"], (s["pos"] - F.col("_lo") + 1).cast("int"), F.lit(1)))
    whole = F.array(F.struct(F.col("_lo").alias("pos"), F.col("_span").alias("ref"), alt.alias("alt"), F.lit("MNV").alias("type")))
    every = F.when(F.size("snvs") > 1, F.concat(one, whole)).otherwise(one)
    return seen.withColumn("_r", F.explode(every)).drop("_lo", "_hi", "_span").select("*", "_r.*").drop("_r")


HEADER = [
    "##fileformat=VCFv4.2",
    *(f'##INFO=<ID={k},Number=.,Type=String,Description="{k} of the annotated row">' for k in INFO_KEYS),
]
FILTERS = {"LowSupport": "Supporting reads below the minimum", "LowFrequency": "Frequency below the minimum", "StrandSupport": "Reads of one strand below the minimum", "StrandBias": "Strand bias p below the minimum"}


def write_vcf(records: DataFrame, path: str, contigs: list[str] = (), emit_filtered: bool = False) -> None:
    """records: contig, pos, ref, alt, filter, info. Sorted text parts under path, header first."""
    spark = records.sparkSession
    kept = records if emit_filtered else records.where("filter = 'PASS'")
    head = [*HEADER, *(f'##FILTER=<ID={k},Description="{v}">' for k, v in FILTERS.items() if emit_filtered), *(f"##contig=<ID={c}>" for c in contigs), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", "info")
    body = kept.select(F.lit(1).alias("k"), "contig", "pos", line.alias("value"))
    top = spark.createDataFrame([(0, "", i, h) for i, h in enumerate(head)], "k int, contig string, pos long, value string")
    top.unionByName(body).orderBy("k", "contig", "pos", "value").select("value").write.text(path)
