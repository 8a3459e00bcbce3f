"""A deterministic genome, genes, variants and reads derived from the order tables, as relations both engines can state.

The text is used with Spark as it stands and, with its own integer division, by
the SQL that queries are checked against.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.dna import once
from strandmill.operators.reference import CHUNK, OVERLAP

CONTIGS = 5
#: Bases in which the reads of a window start, and their qualities in turn.
WINDOW, QUALITIES = 128, "".join(chr(48 + i) for i in range(25))


def refbase(pos: str, chrom: str, div: str) -> str:
    return f"substr('ACGT', cast(((({pos}) * 1103515245 + ({chrom}) * 7919 + 12345) {div} 65536) % 4 as int) + 1, 1)"


def relations(div: str) -> dict[str, str]:
    """name to SELECT text; div is the engine's integer division."""
    b = lambda p, c="chrom": refbase(p, c, div)
    return {
        "dims": f"SELECT ((max(p_partkey) + 1) {div} 5) * 150 AS clen FROM part",
        "genes": f"SELECT p_partkey AS gene_id, p_partkey % 5 AS chrom, (p_partkey {div} 5) * 150 + 1 AS gs, (p_partkey {div} 5) * 150 + 3 * (20 + p_size % 20) AS ge, CASE WHEN (p_partkey {div} 5) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part",
        "snv0": f"SELECT l_suppkey % 5 AS chrom, (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % clen + 1 AS pos, l_linenumber AS ln, l_orderkey AS ok, cast(l_quantity as int) AS qty, l_discount AS disc FROM lineitem, dims WHERE l_quantity < 10",
        "snv1": f"SELECT chrom, pos, {b('pos')} AS ref, ln, ok, qty, disc FROM snv0",
        "snvs": "SELECT chrom, pos, ref, substr('ACGT', cast((instr('ACGT', ref) - 1 + 1 + ln % 3) % 4 as int) + 1, 1) AS alt, min(ok) AS record_id, min(qty) * 10 AS odp, max(disc) * 10 AS ofreq FROM snv1 GROUP BY chrom, pos, ref, substr('ACGT', cast((instr('ACGT', ref) - 1 + 1 + ln % 3) % 4 as int) + 1, 1)",
        "indel0": f"SELECT DISTINCT l_suppkey % 5 AS chrom, (l_orderkey * 13 + l_partkey * 29 + l_linenumber * 11) % (clen - 10) + 1 AS pos, l_linenumber % 2 AS is_del, 1 + l_linenumber % 3 AS size, l_discount * 10 AS af FROM lineitem, dims WHERE l_quantity >= 49",
        "indels": f"SELECT chrom, pos, CASE WHEN is_del = 1 THEN {b('pos')} || {b('pos + 1')} || CASE WHEN size >= 2 THEN {b('pos + 2')} ELSE '' END || CASE WHEN size >= 3 THEN {b('pos + 3')} ELSE '' END ELSE {b('pos')} END AS ref, CASE WHEN is_del = 1 THEN {b('pos')} ELSE {b('pos')} || substr('GATTACA', cast(pos % 4 as int) + 1, cast(size as int)) END AS alt, is_del, size, max(af) AS af FROM indel0 GROUP BY chrom, pos, is_del, size",
        "reads": f"SELECT o_orderkey AS read_id, o_orderkey {div} 2 AS frag, (o_orderkey {div} 2) % 5 AS chrom, ((o_orderkey {div} 2) * 37) % (clen - 160) + 1 + 40 * (o_orderkey % 2) AS start, o_orderkey % 2 AS is_rev, o_custkey % 60 AS mapq FROM orders, dims",
        # aligned reads: a read shows the indel site in its inner part by a rule, else some skip ten bases; names are missing for some fragments
        "aln0": f"SELECT read_id, frag, chrom, start, is_rev, mapq, ((start + 49) {div} 150) * 150 + 36 AS anchor, CASE WHEN frag % 11 = 0 THEN '#' || cast(read_id as string) ELSE 'f' || cast(frag as string) END AS mol FROM reads",
        "aln": f"SELECT *, CASE WHEN anchor >= start + 10 AND (frag * 13 + anchor * 7) % 3 = 0 AND (read_id + anchor) % 31 <> 0 THEN CASE WHEN ((anchor {div} 150) + chrom) % 2 = 0 THEN 'D' ELSE 'I' END WHEN frag % 5 = 4 THEN 'N' ELSE 'M' END AS shape FROM aln0",
        "rindels": f"SELECT chrom, gs + 35 AS pos, CASE WHEN ((gs {div} 150) + chrom) % 2 = 0 THEN 1 ELSE 0 END AS is_del, {b('gs + 35')} || CASE WHEN ((gs {div} 150) + chrom) % 2 = 0 THEN {b('gs + 36')} || {b('gs + 37')} ELSE '' END AS ref, {b('gs + 35')} || CASE WHEN ((gs {div} 150) + chrom) % 2 = 0 THEN '' ELSE 'GTA' END AS alt FROM genes",
        # transcripts of several kinds: an intron, abutting segments, a base read twice, and a base read twice beside an intron
        "models": "SELECT gene_id, chrom, strand, CASE WHEN strand = '+' THEN k ELSE n - 1 - k END AS seg_idx, CASE k WHEN 0 THEN gs WHEN 1 THEN CASE gene_id % 4 WHEN 1 THEN gs + 31 WHEN 2 THEN gs + 30 ELSE gs + 61 END ELSE gs + 75 END AS seg_start, CASE k WHEN 0 THEN gs + 30 WHEN 1 THEN CASE WHEN n = 3 THEN gs + 75 ELSE ge END ELSE ge END AS seg_end FROM (SELECT *, CASE WHEN gene_id % 4 = 3 THEN 3 ELSE 2 END AS n FROM genes WHERE ge - gs + 1 >= 90) g0, (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) parts WHERE k < n",
        "segments": "SELECT gene_id, chrom, strand, CASE WHEN strand = '+' THEN k ELSE 1 - k END AS seg_idx, CASE WHEN k = 0 THEN gs ELSE gs + 61 END AS seg_start, CASE WHEN k = 0 THEN gs + 30 ELSE ge END AS seg_end FROM genes, (SELECT 0 AS k UNION ALL SELECT 1 AS k) parts WHERE ge - gs + 1 >= 90",
    }


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows that much is computed from, dealt to as many tasks as a shuffle has: they come from one row, and so from one task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _chunks(batches):
    """refbase of each base of the chunks, and of the next bases that they carry."""
    bases = np.frombuffer(b"ACGT", np.uint8)
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            chrom, clen, chunk_id = (batch.column(c).slice(s, 64).to_numpy().astype(np.int64) for c in ("chrom", "clen", "chunk_id"))
            start = chunk_id * CHUNK + 1
            ends = np.minimum(clen, start + CHUNK + OVERLAP - 1)
            seq = [bases[(np.arange(lo, hi + 1) * 1103515245 + c * 7919 + 12345 >> 16) & 3].tobytes().decode() for c, lo, hi in zip(chrom, start, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(c) for c in chrom], pa.string()), pa.array(chunk_id), pa.array(start), pa.array(seq, pa.string())], names=["contig", "chunk_id", "chunk_start", "seq"])


class Genome:
    """The derived relations over one folder, with the engine's column names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def relation(self, name: str) -> DataFrame:
        if name in self._views:
            return self._views[name]
        text = relations("div")[name]
        words = set(text.replace(",", " ").replace("(", " ").replace(")", " ").split())
        args = {t: base_table(self.spark, self.sf_dir, t) for t in ("part", "lineitem", "orders") if t in words}
        args |= {n: self.relation(n) for n in ("dims", "genes", "snv0", "snv1", "indel0", "reads", "aln0", "snvs") if n != name and n in words}
        sql = text
        for n in args:
            sql = re.sub(rf"(FROM |, ){n}\b", rf"\1{{{n}}}", sql)
        self._views[name] = self.spark.sql(sql, **args)
        return self._views[name]

    def _contig(self, df: DataFrame) -> DataFrame:
        return df.withColumn("contig", F.col("chrom").cast("string")).drop("chrom")

    def genes(self) -> DataFrame:
        return self._contig(self.relation("genes")).withColumnsRenamed({"gs": "start", "ge": "end"}).withColumn("phase", F.lit(0))

    def snvs(self) -> DataFrame:
        return self._contig(self.relation("snvs"))

    def indels(self) -> DataFrame:
        return self._contig(self.relation("indels"))

    def segments(self) -> DataFrame:
        return self._contig(self.relation("segments")).withColumnsRenamed({"seg_start": "start", "seg_end": "end"})

    def models(self) -> DataFrame:
        """Segments of transcripts with and without real introns."""
        return self._contig(self.relation("models")).withColumnsRenamed({"seg_start": "start", "seg_end": "end"})

    def reference(self) -> DataFrame:
        """Chunks computed where they are used: the genome is never in one row."""
        size = CHUNK
        clen = self.relation("dims")
        rows = clen.select(F.explode(F.sequence(F.lit(0), F.lit(CONTIGS - 1))).alias("chrom"), "clen")
        rows = rows.select("chrom", "clen", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("clen") - 1) / size))).alias("chunk_id"))
        rows = spread_rows(rows, "chrom", "chunk_id")
        # the planner sees one row of sizes, not the bases that come of it: without the hint, it would send the genome through the driver
        return rows.mapInArrow(_chunks, "contig string, chunk_id long, chunk_start long, seq string").hint("merge")

    def read_indels(self) -> DataFrame:
        """One indel a gene that some reads show: a deletion of two bases or an insertion of three."""
        return self._contig(self.relation("rindels"))

    def one_alt(self) -> DataFrame:
        """SNV sites, each with its first alternate."""
        return self.snvs().groupBy("contig", "pos", "ref").agg(F.min("alt").alias("alt"))

    def reads(self) -> DataFrame:
        """Aligned reads as files hold them: CIGAR, bases and qualities of every query base, from the fixture's rules.

        Plain reads of 100 bases, reads with the deletion or insertion of their
        indel site, and soft-clipped reads that skip ten bases.
        """
        r = self._contig(self.relation("aln")).withColumn("_k", F.expr(f"(start - 1) div {WINDOW}"))
        r = r.join(self._windows(), ["contig", "_k"])
        at = f"cast(start - _k * {WINDOW} as int)"
        r = r.withColumn("_own", F.expr("filter(sites, s -> s.p between start and start + 99 and (frag * 31 + s.p * 17) % 3 = 0 and (read_id + s.p) % 29 <> 0)"))
        body = F.expr(f"aggregate(_own, substr(bases, {at}, 100), (t, s) -> overlay(t placing s.a from cast(s.p - start + 1 as int) for 1))")
        r = once(r, _body=body)
        seq = lambda lo, hi: f"substr(_body, cast({lo} - start + 1 as int), cast({hi} - {lo} + 1 as int))"
        # qualities go round every 25 bases
        qual = lambda lo, hi: f"substr('{QUALITIES * 5}', cast((read_id * 7 + {lo}) % 25 + 1 as int), cast({hi} - {lo} + 1 as int))"

        def of(f, mid: str, clip: str) -> str:
            return f"CASE shape WHEN 'D' THEN {f('start', 'anchor')} || {f('(anchor + 3)', '(start + 99)')} WHEN 'I' THEN {f('start', 'anchor')} || '{mid}' || {f('(anchor + 1)', '(start + 99)')} WHEN 'N' THEN '{clip}' || {f('start', '(start + 49)')} || {f('(start + 60)', '(start + 99)')} ELSE {f('start', '(start + 99)')} END"

        m = "cast(anchor - start + 1 as string)"
        cigar = f"CASE shape WHEN 'D' THEN {m} || 'M2D' || cast(97 - anchor + start as string) || 'M' WHEN 'I' THEN {m} || 'M3I' || cast(99 - anchor + start as string) || 'M' WHEN 'N' THEN '4S50M10N40M' ELSE '100M' END"
        return r.select("read_id", F.expr("CASE WHEN mol LIKE '#%' THEN NULL ELSE mol END").alias("qname"), "frag", "contig", "start", (F.col("is_rev") * 16).cast("int").alias("flag"), F.col("mapq").cast("int").alias("mapq"), F.expr(cigar).alias("cigar"), F.expr(of(seq, "GTA", "ACGT")).alias("seq"), F.expr(of(qual, "???", "IIII")).alias("qual"))

    def _windows(self) -> DataFrame:
        """Bases and sites that the reads which start in a window can hold: contig, _k, bases, sites. A base is computed here, not for each read over it."""
        rows = self.relation("dims").select(F.explode(F.sequence(F.lit(0), F.lit(CONTIGS - 1))).alias("chrom"), "clen")
        rows = rows.select("chrom", "clen", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(clen - 1) div {WINDOW}"))).alias("_k"))
        bases = F.expr(f"array_join(transform(sequence(_k * {WINDOW} + 1, least(clen, _k * {WINDOW} + {WINDOW} + 99)), p -> {refbase('p', 'chrom', 'div')}), '')")
        rows = spread_rows(rows, "chrom", "_k").select(F.col("chrom").cast("string").alias("contig"), "_k", bases.alias("bases"))
        first = f"greatest((pos - {WINDOW} - 100 + {WINDOW}) div {WINDOW}, 0)"
        near = self.one_alt().select("contig", F.explode(F.expr(f"sequence({first}, (pos - 1) div {WINDOW})")).alias("_k"), F.col("pos").alias("p"), F.col("alt").alias("a"))
        sites = near.groupBy("contig", "_k").agg(F.collect_list(F.struct("p", "a")).alias("sites"))
        return rows.join(sites, ["contig", "_k"], "left").withColumn("sites", F.coalesce("sites", F.expr("cast(array() as array<struct<p:bigint,a:string>>)")))


#: Aligned blocks of the reads: read_id, frag, mol, chrom, is_rev, mapq, shape, anchor, b0, b1.
BLOCKS = (
    "SELECT read_id, frag, mol, chrom, is_rev, mapq, shape, anchor, start AS b0, CASE shape WHEN 'M' THEN start + 99 WHEN 'N' THEN start + 49 ELSE anchor END AS b1 FROM aln "
    "UNION ALL SELECT read_id, frag, mol, chrom, is_rev, mapq, shape, anchor, CASE shape WHEN 'N' THEN start + 60 WHEN 'D' THEN anchor + 3 ELSE anchor + 1 END, start + 99 FROM aln WHERE shape <> 'M'"
)


def shows_alt(read: str, pos: str) -> str:
    """Condition under which a read shows the alternate of a site it aligns to."""
    return f"(({read}.frag * 31 + {pos} * 17) % 3 = 0 AND ({read}.read_id + {pos}) % 29 <> 0)"


def quality(read: str, pos: str) -> str:
    return f"(15 + ({read}.read_id * 7 + {pos}) % 25)"


def observed_sql(div: str) -> str:
    """Bases that reads show at SNV sites: read_id, frag, mol, chrom, pos, base, quality, is_rev."""
    return f"SELECT r.read_id, r.frag, r.mol, r.mapq, r.chrom, v.pos, CASE WHEN {shows_alt('r', 'v.pos')} THEN v.alt ELSE v.ref END AS base, cast({quality('r', 'v.pos')} as int) AS quality, r.is_rev FROM blocks r JOIN one v ON r.chrom = v.chrom AND v.pos BETWEEN r.b0 AND r.b1"
