"""Gene annotation: GFF3/GTF lines and gene tables to genes and transcript segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.errors import EngineError, guard, guards
from strandmill.operators.transcripts import build_transcripts, protein_offsets

NAMES = ("gene_name", "gene", "Name", "locus_tag", "gene_id", "ID")
BIOTYPES = ("gene_biotype", "biotype", "transcript_biotype")
#: The biotypes that are known, in lower case; other ones say nothing.
CODING = ("protein_coding", "coding", "cds", "mrna")
NON_CODING = ("ncrna", "rrna", "trna", "tmrna", "mirna", "snrna", "snorna", "misc_rna", "antisense_rna", "srp_rna", "rnase_p_rna", "non_coding", "pseudogene")


def attributes(text: Column) -> Column:
    """Map of column 9: key=value of GFF3 (percent-decoded) or key "value" of GTF; semicolons in quotes don't split."""
    parts = F.regexp_extract_all(text, F.lit(r"((?:[^;\"]|\"[^\"]*\")+)"), F.lit(1))
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    eq = lambda p: F.regexp_like(p, F.lit(r"^[\w.-]+\s*="))
    key = lambda p: F.when(eq(p), F.trim(F.regexp_extract(p, r"^([^=]+)=", 1))).otherwise(F.regexp_extract(p, r"^(\S+)", 1))
    raw = lambda p: F.when(eq(p), F.regexp_extract(p, r"^[^=]+=(.*)$", 1)).otherwise(F.regexp_extract(p, r"^\S+\s+(.*)$", 1))
    value = lambda p: F.try_url_decode(F.replace(F.regexp_replace(F.trim(raw(p)), '^"|"$', ""), F.lit("+"), F.lit("%2B")))
    entries = F.transform(clean, lambda p: F.struct(key(p).alias("k"), value(p).alias("v")))
    return F.aggregate(entries, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))


def _first(keys) -> Column:
    return F.coalesce(*(F.element_at("attrs", F.lit(k)) for k in keys))


def gene_name() -> Column:
    """First naming attribute without a gene- prefix; the locus tag is appended where it differs."""
    name = F.regexp_replace(_first(NAMES), "^gene-", "")
    tag = F.element_at("attrs", F.lit("locus_tag"))
    return F.when(tag.isNotNull() & (tag != name), F.concat(name, F.lit("_"), tag)).otherwise(name)


def biotype() -> Column:
    """The first declared biotype if it is a known one, else the feature type if it is one, else protein_coding."""
    known = lambda c: F.when(F.lower(F.trim(c)).isin(*CODING, *NON_CODING), F.lower(F.trim(c)))
    return F.coalesce(known(_first(BIOTYPES)), known(F.col("type")), F.lit("protein_coding"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """contig, type, start, end, strand, phase, attrs, name, biotype, transcript_id, line order."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"), "value", F.monotonically_increasing_id().alias("gene_order"))
    guard(lines.where(F.size("f") != 9).select("value"), "GFF line does not have 9 columns", "E104")
    f = lambda i: F.get("f", F.lit(i))
    rows = lines.select(f(0).alias("contig"), f(2).alias("type"), f(3).try_cast("long").alias("start"), f(4).try_cast("long").alias("end"), f(6).alias("strand"), f(7).alias("phase_text"), attributes(f(8)).alias("attrs"), "gene_order")
    disorder = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 1) | (F.col("start") > F.col("end"))
    guards(rows, [(disorder, "GFF interval is not in order", "E104"), (~F.col("phase_text").isin("0", "1", "2", ".", ""), "GFF phase is not 0, 1 or 2", "E104")], ["contig", "start", "end", "phase_text"])
    rows = rows.withColumn("phase", F.col("phase_text").try_cast("int")).drop("phase_text")
    rows = rows.withColumn("name", gene_name()).withColumn("biotype", biotype())
    owners = F.split(F.coalesce(F.element_at("attrs", F.lit("transcript_id")), F.element_at("attrs", F.lit("Parent"))), ",")
    return rows.select("*", F.explode_outer(owners).alias("transcript_id"))


def multi_exon_transcripts(rows: DataFrame) -> int:
    """Transcripts of more than one CDS row."""
    cds = rows.where("type = 'CDS' and transcript_id is not null")
    return cds.groupBy("contig", "transcript_id").count().where("count > 1").count()


def feature_types(rows: DataFrame) -> list[str]:
    return [r.type for r in rows.select("type").distinct().orderBy("type").collect()]


def select_features(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The wanted types; by default CDS where there are any, else gene and pseudogene."""
    if not features:
        features = ["CDS"] if not rows.where("type = 'CDS'").isEmpty() else ["gene", "pseudogene"]
    return rows.where(F.col("type").isin(*features))


def genes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, segments): spliced models from CDS rows with a transcript, other rows as they are.

    genes: gene_id, contig, start, end, strand, phase, name, biotype, coding, gene_order.
    """
    cds = rows.where("type = 'CDS' and transcript_id is not null")
    segments, loose = build_transcripts(cds)
    info = cds.withColumn("gene_id", F.concat_ws(":", "contig", "transcript_id")).groupBy("gene_id").agg(F.min_by("name", "gene_order").alias("name"), F.min_by("biotype", "gene_order").alias("biotype"), F.min("gene_order").alias("gene_order"))
    span = segments.groupBy("gene_id", "contig", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    models = span.join(info, "gene_id").withColumn("phase", F.lit(0))
    single = rows.where("type <> 'CDS' or transcript_id is null").unionByName(loose).withColumn("gene_id", F.concat_ws(":", "contig", F.col("gene_order").cast("string")))
    cols = ["gene_id", "contig", "start", "end", "strand", "phase", "name", "biotype", "gene_order"]
    every = models.select(*cols).unionByName(single.select(*cols))
    return every.withColumn("coding", ~F.col("biotype").isin(*NON_CODING)), protein_offsets(segments.withColumn("phase", F.lit(0)))


def read_gene_table(spark: SparkSession, path: str, contig: str) -> DataFrame:
    """Genes of a headerless table name, start, end, strand[, phase[, biotype]] on one contig."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"), "value", F.monotonically_increasing_id().alias("gene_order"))
    guard(lines.where(F.size("f") < 4).select("value"), "gene table line has fewer than 4 columns", "E105")
    f = lambda i: F.trim(F.get("f", F.lit(i)))
    rows = lines.select(f(0).alias("name"), F.lit(contig).alias("contig"), f(1).try_cast("long").alias("start"), f(2).try_cast("long").alias("end"), f(3).alias("strand"), F.coalesce(f(4).try_cast("int"), F.lit(0)).alias("phase"), F.lower(F.coalesce(f(5), F.lit("protein_coding"))).alias("biotype"), "gene_order")
    disorder = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 1) | (F.col("start") > F.col("end"))
    guards(rows, [(disorder, "gene interval is not in order", "E105"), (~F.trim("biotype").isin(*CODING, *NON_CODING), "gene biotype is not known", "E105")], ["name", "start", "end", "biotype"])
    return rows.withColumn("gene_id", F.col("name")).withColumn("coding", ~F.col("biotype").isin(*NON_CODING))


def detect_format(path: str, first_line: str = "") -> str:
    """gff or table, by extension, else by the number of columns."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".gff", ".gff3", ".gtf")):
        return "gff"
    if name.endswith((".txt", ".tsv")):
        return "table"
    if not first_line:
        raise EngineError("annotation format can't be told", "E104", path=path)
    return "gff" if first_line.count("\t") >= 8 else "table"
