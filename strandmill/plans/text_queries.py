"""Queries over text that is written from the derived genome and read back by the sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import alleles, consequence
from strandmill.operators import codons, filters, transcripts
from strandmill.operators.reference import CHUNK, OVERLAP, anchor_insertions, reference_mismatches
from strandmill.plans.fixture import Genome, base_table, refbase, spread_rows
from strandmill.plans.oracles import ORACLES, N, base, sql
from strandmill.plans.queries import query
from strandmill.scratch import scratch_path
from strandmill.sinks import tables
from strandmill.sources import alignments, annotation, fasta, fasta_ranges, ivar, vcf

LINE = 60


def _write(rows: DataFrame, by: str, order: list[str], name: str, **options: str) -> str:
    """Lines (column value) of each group of by in one file, in order; returns the folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.repartition(by).sortWithinPartitions(by, *order).select("value").write.options(**options).text(path)
    return path


#: Parts that a table's lines are written to at least, and rows of the table it derives from a part.
PARTS, PART_ROWS = 4, 500_000


def _parts(g: Genome, table: str = "lineitem") -> int:
    """Parts for the lines made of a table: a plain gzip file is one task's, so their number grows with the table."""
    return max(PARTS, -(-base_table(g.spark, g.sf_dir, table).count() // PART_ROWS))


def _with_head(rows: DataFrame, head: list[str], parts: int = PARTS) -> DataFrame:
    """Head lines, then lines (k, value) in order of k, over range-partitioned parts: the head is in the first."""
    top = rows.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "k long, value string")
    return top.unionByName(rows.select("k", "value")).repartitionByRange(parts, "k", "value").sortWithinPartitions("k", "value").select("value")


def _lines_in_parts(rows: DataFrame, head: list[str], name: str, parts: int = PARTS, **options: str) -> str:
    path = scratch_path(rows.sparkSession, name)
    _with_head(rows, head, parts).write.options(**options).text(path)
    return path


def _contig() -> F.Column:
    return F.concat(F.lit("c"), F.col("contig"))


def _fasta(g: Genome) -> str:
    """The genome in lines of 60 bases, odd contigs in lower case, headers with a description."""
    rows = g.relation("dims").select("clen", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chrom"))
    lines = spread_rows(rows.select("chrom", "clen", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("clen") - 1) / LINE))).alias("k")), "chrom", "k")
    seq = F.expr(f"array_join(transform(sequence(k * {LINE} + 1, least(clen, k * {LINE} + {LINE})), p -> {refbase('p', 'chrom', 'div')}), '')")
    body = lines.select("chrom", "k", F.when(F.col("chrom") % 2 == 1, F.lower(seq)).otherwise(seq).alias("value"))
    heads = rows.select("chrom", F.lit(-1).cast("long").alias("k"), F.concat(F.lit(">c"), F.col("chrom").cast("string"), F.lit(" derived from the parts")).alias("value"))
    return _write(heads.unionByName(body), "chrom", ["k"], "fasta")


@query
def q55_fasta_scan(g):
    """FASTA lines to reference chunks."""
    rows = fasta.read_fasta(g.spark, _fasta(g))
    return rows.select("contig", "chunk_id", "chunk_start", F.length("seq").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("digest"))


N["fchunk"] = f"SELECT chrom, k, unnest(generate_series(k * {CHUNK} + 1, least(clen, (k + 1) * {CHUNK} + {OVERLAP}))) AS p FROM (SELECT c.chrom, d.clen, unnest(generate_series(0, (d.clen - 1) // {CHUNK})) AS k FROM dims d, (SELECT unnest(generate_series(0, 4)) AS chrom) c)"
ORACLES["q55_fasta_scan"] = sql(f"SELECT 'c' || cast(chrom as varchar) AS contig, k AS chunk_id, k * {CHUNK} + 1 AS chunk_start, cast(count(*) as int) AS bases, md5(string_agg({base('p')}, '' ORDER BY p)) AS digest FROM fchunk GROUP BY chrom, k")


def _fasta_files(g: Genome) -> str:
    """A file a contig, so that places in it can be told from the contig alone."""
    rows = g.relation("dims").select("clen", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chrom"))
    lines = spread_rows(rows.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("clen") - 1) / LINE))).alias("k"), "clen"), "chrom", "k")
    seq = F.expr(f"array_join(transform(sequence(k * {LINE} + 1, least(clen, k * {LINE} + {LINE})), p -> {refbase('p', 'chrom', 'div')}), '')")
    heads = rows.select("chrom", F.lit(-1).cast("long").alias("k"), F.concat(F.lit(">c"), F.col("chrom").cast("string"), F.lit(" derived")).alias("value"))
    path = scratch_path(g.spark, "fasta-files")
    heads.unionByName(lines.select("chrom", "k", seq.alias("value"))).repartition("chrom").sortWithinPartitions("chrom", "k").select("chrom", "value").write.partitionBy("chrom").text(path)
    return path


@query
def q56_fasta_index(g):
    """Contigs with their places in bytes, from ranges that cut lines."""
    rows = fasta_ranges.byte_index(g.spark, _fasta_files(g), split_bytes=5000)
    return rows.select("name", "length", "offset", "line_bases", "line_width", "even")


ORACLES["q56_fasta_index"] = sql(f"SELECT 'c' || cast(chrom as varchar) AS name, cast(clen as bigint) AS length, cast(length('>c' || cast(chrom as varchar) || ' derived') + 1 as bigint) AS \"offset\", cast({LINE} as int) AS line_bases, cast({LINE} + 1 as int) AS line_width, true AS even FROM dims, (SELECT unnest(generate_series(0, 4)) AS chrom)")


@query
def q105_fasta_regions(g):
    """Bases of the genes, read by seeking in files of several contigs."""
    genes = g.genes().select("gene_id", _contig().alias("contig"), "start", "end")
    rows = fasta_ranges.read_regions(genes, fasta_ranges.byte_index(g.spark, _fasta(g), split_bytes=20_000))
    return rows.select("gene_id", "contig", F.length("seq").cast("int").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("digest"))


ORACLES["q105_fasta_regions"] = sql("SELECT gene_id, 'c' || cast(chrom as varchar) AS contig, cast(length(seq) as int) AS bases, md5(seq) AS digest FROM gseq")

HEAD = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">',
    '##INFO=<ID=AF,Number=A,Type=Float,Description="frequency">',
    '##INFO=<ID=XR,Number=R,Type=Integer,Description="depths">',
    '##INFO=<ID=XG,Number=G,Type=Integer,Description="likelihoods">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
]


def _vcf_lines(g: Genome) -> DataFrame:
    """One record a site with all its alternates; INFO per site, allele, and reference with alleles; two samples with genotypes, depths and phase sets by rule."""
    alts = F.array_sort(F.collect_set("alt"))
    rows = g.snvs().groupBy("contig", "pos", "ref").agg(alts.alias("alts")).withColumn("n", F.size("alts"))
    each = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), f), ",")
    p = F.col("pos")
    info = F.concat(F.lit("DP="), (p % 90 + 10).cast("string"), F.lit(";AF="), each(lambda i: F.concat(F.lit("0."), ((p + i) % 9 + 1).cast("string"))), F.lit(";XR="), F.concat_ws(",", (p % 7).cast("string"), each(lambda i: ((p + i) % 5).cast("string"))), F.lit(";XG=1,2,3;DB"))
    gt = lambda k: F.when((p + k) % 5 == 0, "0/0").when((p + k) % 5 == 1, "0|1").when((p + k) % 5 == 2, "./.").when((p + k) % 5 == 3, "1|1").otherwise(F.concat(F.lit("0/"), F.col("n").cast("string")))
    call = lambda k: F.concat_ws(":", gt(k), F.when((p + k) % 3 == 0, ".").otherwise((p % 50 + k).cast("string")), F.concat_ws(",", F.lit("10"), each(lambda i: ((p + i + k) % 10).cast("string"))), F.lit("77"))
    line = F.concat_ws("\t", _contig(), p.cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), info, F.lit("GT:DP:AD:PS"), call(0), call(1))
    return rows.select((F.col("contig").cast("long") * 10**12 + p).alias("k"), line.alias("value"))


def _vcf(g: Genome, **options: str) -> str:
    return _lines_in_parts(_vcf_lines(g), HEAD, "vcf", _parts(g), **options)


N["vrec"] = "SELECT chrom, pos, ref, alt, cast(row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY alt) as int) AS i, count(*) OVER (PARTITION BY chrom, pos, ref) AS n FROM (SELECT DISTINCT chrom, pos, ref, alt FROM snvs)"
_gt = lambda k: f"CASE (pos + {k}) % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '0|1' WHEN 2 THEN './.' WHEN 3 THEN '1|1' ELSE '0/' || cast(n as varchar) END"
_has = lambda k: f"CASE (pos + {k}) % 5 WHEN 0 THEN false WHEN 1 THEN i = 1 WHEN 2 THEN true WHEN 3 THEN i = 1 ELSE i = n END"
_dp = lambda k: f"cast(CASE WHEN (pos + {k}) % 3 = 0 THEN pos % 90 + 10 ELSE pos % 50 + {k} END as bigint)"
#: Depth of an allele over all depths: sums over one to three alternates.
_ad = lambda k: f"((pos + i + {k}) % 10) / (10 + (pos + 1 + {k}) % 10 + CASE WHEN n >= 2 THEN (pos + 2 + {k}) % 10 ELSE 0 END + CASE WHEN n >= 3 THEN (pos + 3 + {k}) % 10 ELSE 0 END)::double"
_vrow = "'c' || cast(chrom as varchar) AS contig, pos, ref, alt, i AS alt_index"


@query
def q57_vcf_scan(g):
    """Alleles of the second sample: split, with depth, frequency, genotype, and the INFO that is the allele's own."""
    rows = vcf.read_vcf(g.spark, _vcf(g), sample="s2", split=True, keep_info=True)
    return rows.select("contig", "pos", "ref", "alt", F.col("alt_index").cast("int").alias("alt_index"), "odp", F.round("ofreq", 6).alias("ofreq"), "genotype", "oinfo", F.col("phase.phase_set").alias("phase_set"))


ORACLES["q57_vcf_scan"] = sql(
    f"SELECT {_vrow}, {_dp(1)} AS odp, round({_ad(1)}, 6) AS ofreq, {_gt(1)} AS genotype, 'DP=' || cast(pos % 90 + 10 as varchar) || ';AF=0.' || cast((pos + i) % 9 + 1 as varchar) || ';XR=' || cast(pos % 7 as varchar) || ',' || cast((pos + i) % 5 as varchar) || ';DB' AS oinfo, "
    f"CASE WHEN (pos + 1) % 5 IN (1, 3) AND i = 1 THEN cast(77 as bigint) END AS phase_set FROM vrec WHERE {_has(1)}"
)


@query
def q58_vcf_gzip_cohort(g):
    """All samples of a compressed file in one pass: a row per sample that carries the allele."""
    rows = vcf.read_vcf(g.spark, _vcf(g, compression="gzip"), sample="all", split=True)
    return rows.select("sample", "contig", "pos", "alt", "odp", "genotype")


ORACLES["q58_vcf_gzip_cohort"] = sql(" UNION ALL ".join(f"SELECT 's{k + 1}' AS sample, 'c' || cast(chrom as varchar) AS contig, pos, alt, {_dp(k)} AS odp, {_gt(k)} AS genotype FROM vrec WHERE {_has(k)}" for k in (0, 1)))


@query
def q59_vcf_samples(g):
    names = vcf.samples(g.spark, _vcf(g))
    return g.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, sample string")


ORACLES["q59_vcf_samples"] = "SELECT cast(place as int) AS place, sample FROM (VALUES (0, 's1'), (1, 's2')) t(place, sample)"


@query
def q60_contig_presence(g):
    """Contigs that alleles have and the reference lacks, and contigs asked for that no allele has."""
    ref = g.reference().where("contig <> '3'")
    return vcf.missing_contigs(g.snvs(), ref, ["0", "9"])


ORACLES["q60_contig_presence"] = sql("SELECT DISTINCT cast(chrom as varchar) AS contig, 'reference' AS source FROM snvs WHERE chrom = 3 UNION ALL SELECT '9', 'variants'")


def _ivar(g: Genome) -> str:
    """SNVs as they are; at indel sites, +SEQ and -SEQ calls; every seventh call fails."""
    s = g.snvs().select("contig", "pos", "ref", "alt")
    i = g.indels().select("contig", "pos", F.substring("ref", 1, 1).alias("ref"), F.when(F.col("is_del") == 1, F.concat(F.lit("-"), F.substr("ref", F.lit(2)))).otherwise(F.concat(F.lit("+"), F.substr("alt", F.lit(2)))).alias("alt"))
    rows = s.unionByName(i)
    p = F.col("pos")
    total = F.when(p % 4 == 0, "").otherwise((p % 40 + 20).cast("string"))
    freq = F.when(p % 3 == 0, F.concat((p % 80 + 10).cast("string"), F.lit("%"))).when(p % 3 == 1, F.concat(F.lit("0."), (p % 9 + 1).cast("string"))).otherwise("")
    flag = F.when(p % 7 == 0, "FALSE").when(p % 7 == 1, "").otherwise("TRUE")
    cells = {"REGION": _contig(), "POS": p, "REF": F.col("ref"), "ALT": F.lower("alt"), "TOTAL_DP": total, "REF_DP": p % 11 + 9, "ALT_DP": p % 10 + 1, "ALT_FREQ": freq, "PASS": flag}
    path = scratch_path(g.spark, "ivar")
    rows.select(*(c.cast("string").alias(n) for n, c in cells.items())).repartitionByRange(_parts(g), "REGION", "POS").write.options(sep="\t", header=True, emptyValue="").csv(path)
    return path


@query
def q61_caller_table_scan(g):
    path = _ivar(g)
    ref = g.reference().withColumn("contig", _contig())
    assert ivar.looks_like_ivar(g.spark, path)
    return ivar.read_ivar(g.spark, path, ref).select("contig", "pos", "ref", "alt", "odp", F.round("ofreq", 6).alias("ofreq"))


N["calls"] = "SELECT chrom, pos, ref, alt FROM snvs UNION SELECT chrom, pos, ref, alt FROM indels"
_total = "CASE WHEN pos % 4 = 0 THEN pos % 11 + 9 + pos % 10 + 1 ELSE pos % 40 + 20 END"
ORACLES["q61_caller_table_scan"] = sql(f"SELECT 'c' || cast(chrom as varchar) AS contig, pos, ref, alt, cast({_total} as bigint) AS odp, round(CASE pos % 3 WHEN 0 THEN (pos % 80 + 10) / 100.0::double WHEN 1 THEN (pos % 9 + 1) / 10.0::double ELSE (pos % 10 + 1) / ({_total})::double END, 6) AS ofreq FROM calls WHERE pos % 7 <> 0")


def _gff(g: Genome) -> str:
    """Genes with names and biotypes under different attributes, every fourth in GTF style, and CDS rows of the spliced ones."""
    k = F.col("gene_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("gene="), F.lit("g"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("locus_tag=LT_"), k.cast("string"), F.lit(";Name=n%20"), k.cast("string"))).otherwise(F.lit('Note="a;b"'))
    kind = F.when(k % 5 == 0, ";gene_biotype=tRNA").when(k % 5 == 1, ";biotype=protein_coding").when(k % 5 == 2, ";gene_biotype=foo").otherwise("")
    attrs = F.when(k % 4 == 3, F.concat(F.lit('gene_id "x'), k.cast("string"), F.lit('"; gene_name "t;'), k.cast("string"), F.lit('";'))).otherwise(F.concat(F.lit("ID=gene-"), k.cast("string"), F.lit(";"), name, kind))
    row = lambda t, s, e, ph, a: F.concat_ws("\t", _contig(), F.lit("x"), t, s.cast("string"), e.cast("string"), F.lit("."), "strand", ph, a)
    own = g.genes().select(k.alias("k"), row(F.when(k % 6 == 0, "pseudogene").otherwise("gene"), F.col("start"), F.col("end"), F.lit("."), attrs).alias("value"))
    cds = g.segments().select((k + 10**9).alias("k"), row(F.lit("CDS"), F.col("start"), F.col("end"), F.lit("0"), F.concat(F.lit("Parent=t"), k.cast("string"), F.lit(",u"), k.cast("string"))).alias("value"))
    return _lines_in_parts(own.unionByName(cds), ["##gff-version 3", "# derived"], "gff", _parts(g, "part"))


@query
def q62_annotation_scan(g):
    """Names, biotypes and parents of annotation lines; a row per parent."""
    rows = annotation.read_gff(g.spark, _gff(g))
    return rows.select("contig", "type", "start", "end", "strand", "phase", "name", "biotype", "transcript_id")


N["gnames"] = (
    "SELECT gene_id AS k, chrom, strand, gs, ge, CASE WHEN gene_id % 6 = 0 THEN 'pseudogene' ELSE 'gene' END AS type, CASE WHEN gene_id % 4 = 3 THEN 't;' || gene_id WHEN gene_id % 3 = 0 THEN 'g' || gene_id WHEN gene_id % 3 = 1 THEN 'n ' || gene_id || '_LT_' || gene_id ELSE cast(gene_id as varchar) END AS name, "
    "CASE WHEN gene_id % 4 <> 3 AND gene_id % 5 = 0 THEN 'trna' WHEN gene_id % 4 <> 3 AND gene_id % 5 = 1 THEN 'protein_coding' WHEN gene_id % 6 = 0 THEN 'pseudogene' ELSE 'protein_coding' END AS biotype FROM genes"
)
ORACLES["q62_annotation_scan"] = sql(
    "SELECT 'c' || cast(chrom as varchar) AS contig, type, gs AS start, ge AS end, strand, cast(NULL as int) AS phase, name, biotype, cast(NULL as varchar) AS transcript_id FROM gnames "
    "UNION ALL SELECT 'c' || cast(chrom as varchar), 'CDS', seg_start, seg_end, strand, 0, NULL, 'cds', p || cast(gene_id as varchar) FROM segments, (VALUES ('t'), ('u')) t(p)"
)


@query
def q63_genes_and_transcripts(g):
    """Genes of the lines by default: CDS rows where there are any, as transcripts."""
    genes, segs = annotation.genes_of(annotation.select_features(annotation.read_gff(g.spark, _gff(g))))
    span = segs.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    return genes.join(span, "gene_id").select("gene_id", "contig", "start", "end", "strand", "biotype", "coding", "n_segments", "bases")


ORACLES["q63_genes_and_transcripts"] = sql("SELECT 'c' || chrom || ':' || p || gene_id AS gene_id, 'c' || chrom AS contig, min(seg_start) AS start, max(seg_end) AS end, strand, 'cds' AS biotype, true AS coding, count(*) AS n_segments, cast(sum(seg_end - seg_start + 1) as bigint) AS bases FROM segments, (VALUES ('t'), ('u')) t(p) GROUP BY gene_id, chrom, strand, p")


@query
def q64_feature_types(g):
    rows = annotation.read_gff(g.spark, _gff(g))
    kinds = [(i, t, annotation.multi_exon_transcripts(rows)) for i, t in enumerate(annotation.feature_types(rows))]
    return g.spark.createDataFrame(kinds, "place int, type string, multi_exon long")


ORACLES["q64_feature_types"] = sql("SELECT cast(place as int) AS place, type, (SELECT count(DISTINCT gene_id) * 2 FROM segments) AS multi_exon FROM (VALUES (0, 'CDS'), (1, 'gene'), (2, 'pseudogene')) t(place, type)")


@query
def q65_gene_table_scan(g):
    """A headerless gene table of one contig; phase and biotype may be missing."""
    k = F.col("gene_id")
    more = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("\t"), (k % 2).cast("string"))).otherwise(F.lit("\t0\trRNA"))
    rows = g.genes().where("contig = '2'").select(k.alias("k"), F.concat(F.concat_ws("\t", F.concat(F.lit("g"), k.cast("string")), F.col("start").cast("string"), F.col("end").cast("string"), "strand"), more).alias("value"))
    path = _lines_in_parts(rows, ["# name, start, end, strand"], "genes")
    return annotation.read_gene_table(g.spark, path, "2").select("name", "contig", "start", "end", "strand", "phase", "biotype", "coding")


ORACLES["q65_gene_table_scan"] = sql("SELECT 'g' || gene_id AS name, '2' AS contig, gs AS start, ge AS end, strand, cast(CASE WHEN gene_id % 3 = 1 THEN gene_id % 2 ELSE 0 END as int) AS phase, CASE WHEN gene_id % 3 = 2 THEN 'rrna' ELSE 'protein_coding' END AS biotype, gene_id % 3 <> 2 AS coding FROM genes WHERE chrom = 2")


@query
def q66_sam_scan(g):
    """Aligned reads from SAM text: unmapped and unplaced records go, a missing mapping quality and name are null."""
    r = g.reads()
    line = F.concat_ws("\t", F.coalesce("qname", F.lit("*")), F.when(F.col("read_id") % 13 == 0, F.col("flag") + 4).otherwise(F.col("flag")).cast("string"), _contig(), F.col("start").cast("string"), F.when(F.col("mapq") == 7, 255).otherwise(F.col("mapq")).cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.when(F.col("read_id") % 17 == 0, "*").otherwise(F.col("qual")))
    path = _lines_in_parts(r.select(F.col("read_id").alias("k"), line.alias("value")), ["@HD\tVN:1.6"], "sam", _parts(g, "orders"))
    return alignments.read_sam(g.spark, path).select("qname", "flag", "contig", "start", "mapq", "cigar", F.length("seq").cast("int").alias("bases"), F.col("qual").isNull().alias("no_qual"))


_m = "cast(anchor - start + 1 as varchar)"
ORACLES["q66_sam_scan"] = sql(
    f"SELECT CASE WHEN mol LIKE '#%' THEN NULL ELSE mol END AS qname, cast(is_rev * 16 as int) AS flag, 'c' || cast(chrom as varchar) AS contig, start, CASE WHEN mapq <> 7 THEN cast(mapq as int) END AS mapq, CASE shape WHEN 'D' THEN {_m} || 'M2D' || cast(97 - anchor + start as varchar) || 'M' WHEN 'I' THEN {_m} || 'M3I' || cast(99 - anchor + start as varchar) || 'M' WHEN 'N' THEN '4S50M10N40M' ELSE '100M' END AS cigar, "
    "cast(CASE shape WHEN 'D' THEN 98 WHEN 'I' THEN 103 WHEN 'N' THEN 94 ELSE 100 END as int) AS bases, read_id % 17 = 0 AS no_qual FROM aln WHERE read_id % 13 <> 0"
)


@query
def q67_result_table_round_trip(g):
    """Codon rows written as a table and read back for a report, cells and all."""
    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference()).select("contig", F.col("gene_id").cast("string").alias("gene"), F.array_join(F.transform("snvs", lambda s: s["pos"].cast("string")), ", ").alias("positions"), "aa_change", F.when(F.col("grantham").isNotNull(), F.concat(F.col("grantham").cast("string"), F.lit("%"))).alias("grantham"))
    path = scratch_path(g.spark, "table")
    tables.write_tsv(rows, path)
    return tables.read_tsv(g.spark, path, ["contig", "gene", "positions", "aa_change"])


N["gpos"] = "SELECT *, concat_ws(', ', CASE WHEN x0 IS NOT NULL THEN cast(low as varchar) END, CASE WHEN x1 IS NOT NULL THEN cast(low + 1 as varchar) END, CASE WHEN x2 IS NOT NULL THEN cast(low + 2 as varchar) END) AS positions FROM grant"
ORACLES["q67_result_table_round_trip"] = sql("SELECT cast(chrom as varchar) AS contig, cast(gene_id as varchar) AS gene, positions, aa_change, cast(grantham as varchar) || '%' AS grantham FROM gpos")


@query
def q68_normalise_alleles(g):
    """Indels padded with the bases around them, trimmed back where their components stay the same."""
    from strandmill.operators.reference import lookup

    rows = lookup(g.indels().where("pos > 3"), g.reference(), {"_b": (F.col("pos") - 2, F.lit(2))}, reach=2)
    long_ = lookup(rows.withColumn("_e", F.col("pos") + F.length("ref")), g.reference(), {"_a": (F.col("_e"), F.lit(2))}, reach=2)
    rows = long_.select("contig", (F.col("pos") - 2).alias("pos"), F.concat("_b", "ref", "_a").alias("ref"), F.concat("_b", "alt", "_a").alias("alt"), F.col("pos").alias("site"))
    kept = alleles.with_event(alleles.normalise(rows))
    return kept.select("contig", "site", "ref", "alt", "pos", alleles.labels(F.col("components")).alias("components"))


# the same steps over text: longest common prefix and suffix by testing every length
_pre = lambda a, b, top: f"coalesce(list_max([i for i in range(1, cast({top} as int) + 1) if substr({a}, 1, i) = substr({b}, 1, i)]), 0)"
_suf = lambda a, b, top: f"coalesce(list_max([i for i in range(1, cast({top} as int) + 1) if right({a}, i) = right({b}, i)]), 0)"
_shorter = lambda a, b: f"least(length({a}), length({b}))"
N["pad"] = f"SELECT chrom, pos AS site, pos - 2 AS pos, {base('pos - 2')} || {base('pos - 1')} || ref || {base('pos + length(ref)')} || {base('pos + length(ref) + 1')} AS ref, {base('pos - 2')} || {base('pos - 1')} || alt || {base('pos + length(ref)')} || {base('pos + length(ref) + 1')} AS alt FROM indels WHERE pos > 3"


def _indel_label(src: str, p: str, r: str, a: str) -> str:
    """SQL over src adding label: the component of an allele that is a pure insertion or deletion."""
    inner = f"SELECT *, {_pre(r, a, _shorter(r, a))} AS lp FROM {src}"
    return f"SELECT * EXCLUDE (lp), CASE WHEN length({r}) > length({a}) THEN 'DEL:' || cast({p} + lp as varchar) || CASE WHEN length({r}) - length({a}) > 1 THEN '-' || cast({p} + lp + length({r}) - length({a}) - 1 as varchar) ELSE '' END || ':' || substr({r}, lp + 1, length({r}) - length({a})) ELSE 'INS:' || cast({p} + lp - 1 as varchar) || ':+' || substr({a}, lp + 1, length({a}) - length({r})) END AS label FROM ({inner})"


N["trim"] = f"SELECT *, least({_suf('ref', 'alt', _shorter('ref', 'alt') + ' - 1')}, {_shorter('ref', 'alt')} - 1) AS s FROM pad"
N["trima"] = "SELECT *, substr(ref, 1, length(ref) - s) AS r1, substr(alt, 1, length(alt) - s) AS a1 FROM trim"
N["trimb"] = f"SELECT *, {_pre('r1', 'a1', _shorter('r1', 'a1') + ' - 1')} AS p1, {_pre('ref', 'alt', _shorter('ref', 'alt') + ' - 1')} AS p0 FROM trima"
N["trimc"] = "SELECT *, substr(r1, p1 + 1) AS r2, substr(a1, p1 + 1) AS a2, pos + p1 AS q2, substr(ref, p0 + 1) AS r3, substr(alt, p0 + 1) AS a3, pos + p0 AS q3 FROM trimb"
N["trimd"] = _indel_label("trimc", "pos", "ref", "alt").replace("AS label", "AS l1")
N["trime"] = _indel_label("trimd", "q2", "r2", "a2").replace("AS label", "AS l2")
N["trimf"] = _indel_label("trime", "q3", "r3", "a3").replace("AS label", "AS l3")
ORACLES["q68_normalise_alleles"] = sql("SELECT cast(chrom as varchar) AS contig, site, CASE WHEN l2 = l1 THEN r2 WHEN l3 = l1 THEN r3 ELSE ref END AS ref, CASE WHEN l2 = l1 THEN a2 WHEN l3 = l1 THEN a3 ELSE alt END AS alt, CASE WHEN l2 = l1 THEN q2 WHEN l3 = l1 THEN q3 ELSE pos END AS pos, l1 AS components FROM trimf")


@query
def q69_left_anchor_insertions(g):
    """Insertions written before a base are rewritten behind the base before it."""
    rows = g.snvs().where("pos > 1").select("contig", F.col("pos").alias("site"), "pos", "ref", F.concat(F.lit("NN"), "ref").alias("alt")).distinct()
    moved = anchor_insertions(alleles.with_event(rows), g.reference())
    return moved.select("contig", "site", "pos", "ref", "alt")


ORACLES["q69_left_anchor_insertions"] = sql(f"SELECT DISTINCT cast(chrom as varchar) AS contig, pos AS site, pos - 1 AS pos, {base('pos - 1')} AS ref, {base('pos - 1')} || 'NN' AS alt FROM snvs WHERE pos > 1")


@query
def q70_reference_check(g):
    """REF of 90 bases, longer than a chunk's overlap, with a wrong base in every fourth: those are found, whatever chunk they start in."""
    from strandmill.operators.reference import intervals_sequence

    at = g.genes().where("start > 40").select("contig", (F.col("start") - 40).alias("s"), (F.col("start") + 49).alias("e"), "gene_id")
    seqs = intervals_sequence(at, g.reference(), ["contig", "s", "gene_id"], "s", "e")
    wrong = F.concat(F.substr("seq", F.lit(1), F.lit(79)), F.translate(F.substr("seq", F.lit(80), F.lit(1)), "ACGT", "CGTA"), F.substr("seq", F.lit(81)))
    rows = seqs.select("contig", F.col("s").alias("pos"), F.when(F.col("gene_id") % 4 == 0, wrong).otherwise(F.lower("seq")).alias("ref"), F.lit("A").alias("alt"))
    return reference_mismatches(rows, g.reference()).select("contig", "pos", F.length("ref").cast("int").alias("bases"))


ORACLES["q70_reference_check"] = sql("SELECT cast(chrom as varchar) AS contig, gs - 40 AS pos, cast(90 as int) AS bases FROM genes WHERE gs > 40 AND gene_id % 4 = 0")


@query
def q71_indel_hgvs(g):
    """Genomic descriptors of indels."""
    return g.indels().select("contig", "pos", "ref", "alt", consequence.hgvs_indel(F.col("pos"), F.col("ref"), F.col("alt")).alias("hgvs_g"))


_cut = f"SELECT *, {_pre('ref', 'alt', _shorter('ref', 'alt'))} AS pre FROM indels"
ORACLES["q71_indel_hgvs"] = sql(f"SELECT cast(chrom as varchar) AS contig, pos, ref, alt, CASE WHEN is_del = 1 THEN 'g.' || cast(pos + pre as varchar) || CASE WHEN size > 1 THEN '_' || cast(pos + pre + size - 1 as varchar) ELSE '' END || 'del' ELSE 'g.' || cast(pos + pre - 1 as varchar) || '_' || cast(pos + pre as varchar) || 'ins' || substr(alt, pre + 1, cast(size as int)) END AS hgvs_g FROM ({_cut})")


@query
def q72_multibase_records(g):
    """Records of two neighbouring changed bases, split to the substitutions they hold; indels hold none."""
    from strandmill.operators.reference import lookup

    rows = lookup(g.snvs(), g.reference(), {"_r": (F.col("pos"), F.lit(2))}, reach=2).where(F.length("_r") == 2)
    next_ = F.substr("_r", F.lit(2), F.lit(1))
    mnp = rows.select("contig", "pos", F.col("_r").alias("ref"), F.concat("alt", F.when(F.col("pos") % 2 == 0, F.translate(next_, "ACGT", "CGTA")).otherwise(next_)).alias("alt"))
    each = alleles.with_event(mnp.unionByName(g.indels().select("contig", "pos", "ref", "alt"))).select("contig", F.col("pos").alias("site"), "alt", "event_class", F.explode(alleles.substitution_components(F.col("components"))).alias("c"))
    return each.select("contig", "site", F.col("alt").alias("record_alt"), "event_class", "c.pos", "c.ref", F.col("c.alt").alias("alt"))


N["mnp"] = f"SELECT chrom, pos, ref, alt, {base('pos + 1')} AS r2, CASE WHEN pos % 2 = 0 THEN translate({base('pos + 1')}, 'ACGT', 'CGTA') ELSE {base('pos + 1')} END AS a2 FROM snvs, dims WHERE pos < clen"
_mcls = "CASE WHEN pos % 2 = 0 THEN 'mnv' ELSE 'snp' END AS event_class"
ORACLES["q72_multibase_records"] = sql(f"SELECT cast(chrom as varchar) AS contig, pos AS site, alt || a2 AS record_alt, {_mcls}, pos, ref, alt FROM mnp UNION ALL SELECT cast(chrom as varchar), pos, alt || a2, {_mcls}, pos + 1, r2, a2 FROM mnp WHERE pos % 2 = 0")


@query
def q73_metrics_check(g):
    """Alleles without a depth or frequency, of which an error names up to five."""
    v = g.snvs().withColumn("odp", F.when(F.col("pos") % 50 == 0, None).otherwise(F.col("odp"))).select("contig", "pos", "alt", "odp", "ofreq")
    rows = filters.strict_metrics(v, 5)
    return g.spark.createDataFrame([(r.contig, r.pos, r.alt) for r in rows], "contig string, pos long, alt string")


ORACLES["q73_metrics_check"] = sql("SELECT cast(chrom as varchar) AS contig, pos, alt FROM snvs WHERE pos % 50 = 0 ORDER BY 1, 2, 3 LIMIT 5")


@query
def q74_insertions_at_junctions(g):
    """Insertions anchored on the last base of an exon that isn't the transcript's last."""
    s = g.segments()
    ins = s.select("contig", F.col("end").alias("pos"), F.concat(F.lit("i"), F.col("gene_id").cast("string"), F.lit("_"), F.col("seg_idx").cast("string")).alias("ins"))
    return transcripts.internal_junctions(ins, s).select("contig", "pos", "ins")


ORACLES["q74_insertions_at_junctions"] = sql("SELECT cast(chrom as varchar) AS contig, seg_end AS pos, 'i' || gene_id || '_' || seg_idx AS ins FROM segments WHERE seg_start = (SELECT min(x.seg_start) FROM segments x WHERE x.gene_id = segments.gene_id)")


@query
def q75_mean_depth(g):
    """Integer mean depth of the sites of a codon."""
    from strandmill.plans.queries import KEYS, MIN_QUALITY, _members, _observed
    from strandmill.operators import reads

    s = reads.snp_support(reads.merge_molecules(_observed(g)), g.one_alt(), MIN_QUALITY).select("contig", "pos", "depth")
    rows = _members(g).join(s, ["contig", "pos"]).groupBy(*KEYS).agg(F.collect_list("depth").alias("d"))
    return rows.select(*KEYS, filters.mean_depth(F.col("d")).alias("depth"))


ORACLES["q75_mean_depth"] = sql("SELECT m.gene_id, m.low AS codon_start, cast(floor(avg(s.depth)) as bigint) AS depth FROM members m JOIN support s ON s.chrom = m.chrom AND s.pos = m.pos GROUP BY m.gene_id, m.low")


@query
def q90_block_text_round_trip(g):
    """Lines written as block-compressed parts and read back; the line count that the writer reports is on each."""
    from strandmill.sinks.blocks import write_block_text

    lines = g.snvs().select(F.concat_ws("\t", _contig(), F.col("pos").cast("string"), "ref", "alt").alias("value")).repartitionByRange(3, "value").sortWithinPartitions("value")
    path = scratch_path(g.spark, "blocks")
    n = write_block_text(lines, path)
    return g.spark.read.text(path).select("value", F.lit(n).cast("long").alias("lines"))


ORACLES["q90_block_text_round_trip"] = sql("SELECT concat_ws(chr(9), 'c' || cast(chrom as varchar), cast(pos as varchar), ref, alt) AS value, (SELECT count(*) FROM snvs) AS lines FROM snvs")


#: Bytes of a range where small files are to be read by many tasks.
SMALL_SPLIT = 1 << 14


@query
def q97_vcf_block_ranges(g):
    """Alleles of the second sample, from block-compressed parts that are read in ranges which cut lines."""
    from strandmill.sinks.blocks import write_block_text

    path = scratch_path(g.spark, "vcf-blocks")
    write_block_text(_with_head(_vcf_lines(g), HEAD, _parts(g)), path)
    rows = vcf.read_vcf(g.spark, path, sample="s2", split=True, split_bytes=SMALL_SPLIT)
    return rows.select("contig", "pos", "ref", "alt", F.col("alt_index").cast("int").alias("alt_index"), "odp", "genotype")


ORACLES["q97_vcf_block_ranges"] = sql(f"SELECT {_vrow}, {_dp(1)} AS odp, {_gt(1)} AS genotype FROM vrec WHERE {_has(1)}")


#: Reads of a BAM part, and ranges of all parts together at most.
PART_READS, MOST_RANGES = 250_000, 2000


def _split(g: Genome, path: str) -> int:
    """SMALL_SPLIT, or longer ranges where so many would be more than MOST_RANGES: each costs an open file, its header and the search for a record."""
    size = g.spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).agg(F.sum("length")).first()[0]
    return max(SMALL_SPLIT, -(-size // MOST_RANGES))


def _bam(g: Genome) -> str:
    from strandmill.sinks.blocks import write_bam

    path = scratch_path(g.spark, "bam")
    clen = g.relation("dims").first().clen
    parts = max(3, -(-g.relation("reads").count() // PART_READS))
    write_bam(g.reads().repartitionByRange(parts, "contig", "start").sortWithinPartitions("contig", "start"), path, [(str(c), clen) for c in range(5)])
    alignments.write_index(g.spark, path, _split(g, path))
    assert alignments.check_bam(g.spark, path, indexed=True) == [str(c) for c in range(5)]
    return path


@query
def q96_bam_index_bins(g):
    """Bins that the indexes of the BAM parts name, by contig."""
    return alignments.index_bins(g.spark, _bam(g)).select("contig", "bin").distinct()


_levels = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26))
ORACLES["q96_bam_index_bins"] = sql("SELECT DISTINCT cast(chrom as varchar) AS contig, cast(CASE " + " ".join(f"WHEN (start - 1) // {1 << b} = (start + 98) // {1 << b} THEN {f} + (start - 1) // {1 << b}" for f, b in _levels) + " ELSE 0 END as int) AS bin FROM aln")


@query
def q91_bam_round_trip(g):
    """Reads written as BAM parts and read back, bases and qualities by digest."""
    path = _bam(g)
    rows = alignments.read_bam(g.spark, path, split_bytes=_split(g, path))
    kept = g.reads().select(F.md5(F.concat_ws("|", "seq", "qual").cast("binary")).alias("was"), F.coalesce("qname", F.lit("*")).alias("q2"), F.col("contig").alias("c2"), F.col("start").alias("s2"), F.col("flag").alias("f2"))
    own = rows.withColumn("now", F.md5(F.concat_ws("|", "seq", "qual").cast("binary"))).withColumn("q", F.coalesce("qname", F.lit("*")))
    both = own.join(kept, (F.col("q") == F.col("q2")) & (F.col("contig") == F.col("c2")) & (F.col("start") == F.col("s2")) & (F.col("flag") == F.col("f2")) & (F.col("now") == F.col("was")), "left_semi")
    return both.select("qname", "flag", "contig", "start", "mapq", "cigar", F.length("seq").cast("int").alias("bases"))


_cigar = f"CASE shape WHEN 'D' THEN {_m} || 'M2D' || cast(97 - anchor + start as varchar) || 'M' WHEN 'I' THEN {_m} || 'M3I' || cast(99 - anchor + start as varchar) || 'M' WHEN 'N' THEN '4S50M10N40M' ELSE '100M' END AS cigar"
_bases = "cast(CASE shape WHEN 'D' THEN 98 WHEN 'I' THEN 103 WHEN 'N' THEN 94 ELSE 100 END as int) AS bases"
_read = f"CASE WHEN mol LIKE '#%' THEN NULL ELSE mol END AS qname, cast(is_rev * 16 as int) AS flag, cast(chrom as varchar) AS contig, start, cast(mapq as int) AS mapq, {_cigar}, {_bases}"
ORACLES["q91_bam_round_trip"] = sql(f"SELECT {_read} FROM aln")


@query
def q92_bam_region(g):
    """Records that overlap a region, read through the index."""
    rows = alignments.read_bam(g.spark, _bam(g), ("2", 1000, 3000), indexed=True)
    return rows.select("qname", "flag", "contig", "start", "mapq", "cigar", F.length("seq").cast("int").alias("bases"))


ORACLES["q92_bam_region"] = sql(f"SELECT {_read} FROM aln WHERE chrom = 2 AND start <= 3000 AND start + 99 >= 1000")


@query
def q93_result_table(g):
    """Cells of the result table, of all codon rows."""
    from strandmill.plans.annotate import _codon_rows, _shape

    rows = tables.result_table(_shape(_codon_rows(codons.codon_mnv(g.snvs(), g.genes(), g.reference()))))
    return rows.toDF(*(c.lower().replace(" ", "_").replace(".", "") for c in rows.columns))


_snv = lambda i: f"'SNV:' || cast(low + {i} as varchar) || ':' || r{i} || '>' || x{i}"
_bar = "' | '"
_three = lambda a, sep="', '": f"concat_ws({sep}, " + ", ".join(a(i) for i in range(3)) + ")"
_when = lambda i, x: f"CASE WHEN x{i} IS NOT NULL THEN {x} END"
N["shifted"] = ORACLES["q15_consequence_shift"][ORACLES["q15_consequence_shift"].rindex("SELECT gene_id, low AS codon_start") :]
N["wide2"] = "SELECT w.*, coalesce(s.shift, '-') AS shift FROM wide w LEFT JOIN shifted s ON s.gene_id = w.gene_id AND s.codon_start = w.low AND s.snvs = w.snvs"
_cat = "CASE WHEN grantham <= 50 THEN 'conservative' WHEN grantham <= 100 THEN 'moderately conservative' WHEN grantham <= 150 THEN 'moderately radical' ELSE 'radical' END"
ORACLES["q93_result_table"] = sql(
    f"SELECT cast(chrom as varchar) AS chromosome, cast(gene_id as varchar) AS gene, {_three(lambda i: _when(i, f'cast(low + {i} as varchar)'))} AS positions, {_three(lambda i: _when(i, f'r{i}'))} AS reference_bases, {_three(lambda i: f'x{i}')} AS base_changes, aa_change AS aa_changes, snp_aa_changes, aa_change AS local_aa_changes, snp_aa_changes AS local_snp_aa_changes, variant_type, change_type, ref_codon AS reference_codon, "
    f"{_three(lambda i: f's{i}')} AS snp_codon, alt_codon AS mnv_codon, CASE WHEN n > 1 THEN 'mnv' ELSE 'snp' END AS event_class, {_three(lambda i: _when(i, _snv(i)), _bar)} AS event_components, so_term, impact, coalesce(cast(grantham as varchar) || ' (' || {_cat} || ')', '-') AS grantham, shift AS mnv_consequence_shift, coalesce(dbs_class, '-') AS dbs_class, '-' AS declared_phase, '-' AS mnv_phasing_support, '-' AS nmd_prediction, hgvs_g, hgvs_c FROM wide2"
)
