"""Table, manifest and summary sinks."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_cell(c: Column) -> Column:
    """Percent, tab and line ends as percent codes; null as a dash."""
    for a, b in (("%", "%25"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit("-"))


#: Columns of the result table without reads, in order.
TABLE_COLUMNS = ("Chromosome", "Gene", "Positions", "Reference Bases", "Base Changes", "AA Changes", "SNP AA Changes", "Local AA Changes", "Local SNP AA Changes", "Variant Type", "Change Type", "Reference Codon", "SNP Codon", "MNV Codon", "Event Class", "Event Components", "SO Term", "Impact", "Grantham", "MNV Consequence Shift", "DBS Class", "Declared Phase", "MNV Phasing Support", "NMD Prediction", "HGVS g.", "HGVS c.")


def result_table(rows: DataFrame) -> DataFrame:
    """Cells of the result table, as text, from annotate() rows; declared_phase and phasing_support are shown where the rows have them."""
    return rows.select(*(c.alias(n) for c, n in zip(table_cells(rows), TABLE_COLUMNS, strict=True)))


def table_cells(rows: DataFrame) -> list[Column]:
    """A cell for each of TABLE_COLUMNS."""
    from strandmill.functions.aa import grantham_category
    from strandmill.functions.text import fixed

    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))
    many = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    local, local_snp = F.coalesce(has("local_aa_change"), F.col("aa_change")), F.coalesce(has("local_snp_aa_changes"), F.col("snp_aa_changes").cast("string"))
    return [
        F.col("contig"), F.col("gene_id").cast("string"), many("positions"), many("ref_bases"), many("alt_bases"),
        dash(F.col("aa_change")), dash(F.col("snp_aa_changes")), dash(local), dash(local_snp), F.col("variant_type"), F.col("change_type"),
        dash(F.col("ref_codon")), dash(F.col("snp_codons")), dash(F.col("alt_codon")), F.coalesce("event_class", F.lower("variant_type")), F.col("components"),
        F.col("so_term"), F.col("impact"), dash(F.concat(F.col("grantham").cast("string"), F.lit(" ("), grantham_category(F.col("grantham")), F.lit(")"))), dash(F.col("shift")), dash(F.col("dbs_class")),
        dash(has("declared_phase")), dash(fixed(has("phasing_support"))), dash(F.col("nmd")), dash(F.col("hgvs_g")), dash(F.col("hgvs_c")),
    ]


#: Columns that reads add, each behind the one named.
READ_COLUMNS = {
    "MNV Codon": ("SNP Reads", "SNP Forward Reads", "SNP Reverse Reads", "MNV Reads", "MNV Forward Reads", "MNV Reverse Reads", "Total Reads", "SNP Frequencies", "MNV Frequencies"),
    "Event Components": ("Event Reads", "Event Forward Reads", "Event Reverse Reads", "Event Depth", "Event Frequency"),
    "MNV Phasing Support": ("Haplotype LD", "Haplotype LD p", "MNV Phasing Reads", "Frameshift Phasing"),
}


def read_table(rows: DataFrame) -> DataFrame:
    """Cells of the result table of rows with read support (evidence.attach_support): 44 columns."""
    from strandmill.operators.evidence import read_cells

    cells = read_cells(rows)
    phasing = F.coalesce(F.nullif("frameshift_phasing", F.lit("")), F.lit("-")) if "frameshift_phasing" in rows.columns else F.lit("-")
    wide = rows.select("*", *(c.alias(f"_{n}") for n, c in cells.items()), phasing.alias("_Frameshift Phasing"))
    names = [n for c in TABLE_COLUMNS for n in (c, *READ_COLUMNS.get(c, ()))]
    base = dict(zip(TABLE_COLUMNS, table_cells(wide), strict=True))
    return wide.select(*((F.col(f"_{n}") if f"_{n}" in wide.columns else base[n]).alias(n) for n in names))


def write_tsv(rows: DataFrame, path: str, order: list | None = None) -> None:
    """Sorted tab-separated parts with a header each; all columns as text."""
    out = rows.orderBy(*order) if order else rows
    out.select(*(encode_cell(F.col(c).cast("string")).alias(c) for c in out.columns)).write.csv(path, sep="\t", header=True, quote="", escape="")


def read_tsv(spark: SparkSession, path: str, needed: list[str] = ()) -> DataFrame:
    """A table that write_tsv wrote: columns by header name as text, a dash as null, percent codes resolved. Compressed files and missing columns are errors."""
    from strandmill.errors import EngineError

    head = spark.read.text(path).limit(1).collect()
    if head and head[0].value[:2] in ("\x1f\x8b", "\x1f\ufffd"):
        raise EngineError("the result table is compressed", "E103", path=path)
    rows = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    if missing := [c for c in needed if c not in rows.columns]:
        raise EngineError("the result table lacks columns", "E103", missing=missing)

    def cell(c: str) -> Column:
        x = F.col(c)
        for a, b in (("%0D", "\r"), ("%0A", "\n"), ("%09", "\t"), ("%25", "%")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.when(F.col(c) != "-", x).alias(c)

    return rows.select(*map(cell, rows.columns))


def sha256_of(spark: SparkSession, path: str) -> dict[str, str]:
    """Path to SHA-256 of each file; contents stay on the executors."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"))
    return {r.path: r.sha for r in rows.collect()}


def manifest(spark: SparkSession, inputs: list[str], outputs: list[str], parameters: dict) -> str:
    return json.dumps({"schema": "1.0.0", "parameters": parameters, "inputs": {p: sha256_of(spark, p) for p in inputs}, "outputs": {p: sha256_of(spark, p) for p in outputs}}, sort_keys=True)


def summary_json(summary: DataFrame) -> str:
    """contig_summary() rows (one a contig, and the total) as JSON."""
    rows = [r.asDict() for r in summary.collect()]
    return json.dumps({"schema": "1.0.0", "contigs": [r for r in rows if r["contig"] is not None], "global": next((r for r in rows if r["contig"] is None), None)}, sort_keys=True)


def base_name(path: str) -> str:
    name = PurePosixPath(path).name
    for end in (".vcf.gz", ".vcf", ".gz"):
        if name.endswith(end):
            return name[: -len(end)]
    return name


def safe_name(sample: str) -> str:
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in sample)


def output_paths(folder: str, prefix: str, samples: list[str]) -> dict[str, str]:
    """Output of each sample; samples whose safe names collide are an error."""
    from strandmill.errors import EngineError

    out = {s: f"{folder.rstrip('/')}/{prefix}.sample_{safe_name(s)}" for s in samples}
    if len(set(out.values())) < len(out):
        raise EngineError("sample names collide in file names", "E106", samples=samples)
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
