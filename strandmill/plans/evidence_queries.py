"""Queries over read evidence, haplotype rows, fallback rows and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import alleles, consequence, text
from strandmill.operators import codons, fallback, filters, indels, phase, reads, transcripts
from strandmill.plans.fixture import Genome, quality, shows_alt
from strandmill.plans.oracles import ORACLES, N, base, fisher, sql
from strandmill.scratch import materialize
from strandmill.plans.queries import ALLELE, KEYS, MIN_QUALITY, _haplotypes, _members, _observed, _patterns, _read_indels, _windows, query


@query
def q77_codon_ld_fisher(g):
    """The weakest pair of sites of each codon with its two-by-two table and exact p."""
    rows = reads.codon_linkage(reads.pattern_counts(_patterns(g), KEYS), KEYS)
    return rows.select(*KEYS, "both", "first", "second", "neither", F.round("p", 6).alias("p"))


N["ldmin"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, low ORDER BY d_prime, i, j) AS rn FROM ld3) WHERE rn = 1"
ORACLES["q77_codon_ld_fisher"] = sql(f"SELECT l.gene_id, l.low AS codon_start, cast(l.a as bigint) AS both, cast(l.b as bigint) AS first, cast(l.c as bigint) AS second, cast(l.d as bigint) AS neither, p.p FROM ldmin l JOIN ({fisher('ldmin', 'gene_id, low', 'a', 'b', 'c', 'd')}) p ON p.gene_id = l.gene_id AND p.low = l.low")

MIN_P = 0.123


@query
def q78_mnv_strand_bias(g):
    """Strand bias of haplotypes, and the FILTER that it gives beside support and strand counts."""
    rows = reads.mnv_strand_bias(reads.mnv_support(_patterns(g), KEYS))
    tag = filters.vcf_filter(F.col("mnv_reads"), F.col("mnv_depth"), F.col("mnv_forward"), F.col("mnv_reverse"), F.col("strand_bias_p"), 1, 0.1, 0, MIN_P)
    return rows.select(*KEYS, F.round("strand_bias_p", 6).alias("p"), tag.alias("filter"))


N["mnvs"] = "SELECT gene_id, low, sum(CASE WHEN hits = n THEN 1 ELSE 0 END) AS mr, sum(CASE WHEN hf = n THEN 1 ELSE 0 END) AS mf, sum(CASE WHEN hr = n THEN 1 ELSE 0 END) AS mv, sum(CASE WHEN k = n THEN 1 ELSE 0 END) AS md, sum(CASE WHEN k = n AND sf = n THEN 1 ELSE 0 END) AS df, sum(CASE WHEN k = n AND sr = n THEN 1 ELSE 0 END) AS dr FROM pat GROUP BY gene_id, low"
N["mnvp"] = fisher("mnvs", "gene_id, low", "mf", "mv", "greatest(df - mf, 0)", "greatest(dr - mv, 0)")
ORACLES["q78_mnv_strand_bias"] = sql(f"SELECT m.gene_id, m.low AS codon_start, p.p, coalesce(nullif(concat_ws(';', CASE WHEN mr < 1 THEN 'LowSupport' END, CASE WHEN CASE WHEN md > 0 THEN mr / md::double ELSE 0 END < 0.1 THEN 'LowFrequency' END, CASE WHEN p.p < {MIN_P} THEN 'StrandBias' END), ''), 'PASS') AS filter FROM mnvs m JOIN mnvp p ON p.gene_id = m.gene_id AND p.low = m.low")


@query
def q79_solo_support(g):
    """Molecules with one site's alternate but not the whole haplotype: all of them, and those that see every site."""
    rows = _members(g).select(*KEYS, "idx").join(reads.solo_support(_patterns(g), KEYS), [*KEYS, "idx"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(*KEYS, F.col("idx").cast("int").alias("idx"), zero("solo_reads"), zero("solo_informative"))


N["patsite"] = "SELECT m.gene_id, m.low, m.idx, p.mol, p.k, p.n, p.hits FROM members m JOIN seen s ON s.chrom = m.chrom AND s.pos = m.pos AND s.base = m.alt JOIN pat p ON p.gene_id = m.gene_id AND p.low = m.low AND p.mol = s.mol"
ORACLES["q79_solo_support"] = sql("SELECT m.gene_id, m.low AS codon_start, cast(m.idx as int) AS idx, count(CASE WHEN p.hits < p.n THEN 1 END) AS solo_reads, count(CASE WHEN p.hits < p.n AND p.k = p.n THEN 1 END) AS solo_informative FROM members m LEFT JOIN patsite p ON p.gene_id = m.gene_id AND p.low = m.low AND p.idx = m.idx GROUP BY m.gene_id, m.low, m.idx")

MOST = 5


@query
def q80_read_display(g):
    """Reads of each codon by what they show, at most five of them, the classes taking turns."""
    ref = g.one_alt().select("contig", "pos", "ref")
    members = _members(g).join(ref, ["contig", "pos"])
    rows = reads.shown_reads(reads.read_classes(_observed(g), members, KEYS), KEYS, MOST)
    return rows.select(*KEYS, "read_id", "class", F.col("shown").cast("int").alias("shown"))


N["rcls0"] = "SELECT m.gene_id, m.low, m.n, o.read_id, count(*) AS seen, count(CASE WHEN o.base = m.alt THEN 1 END) AS alts FROM members m JOIN observed o ON o.chrom = m.chrom AND o.pos = m.pos GROUP BY m.gene_id, m.low, m.n, o.read_id"
N["rcls1"] = "SELECT *, CASE WHEN alts = n THEN 'mnv' WHEN alts > 0 THEN 'partial' ELSE 'reference' END AS class FROM rcls0"
N["rcls2"] = "SELECT *, row_number() OVER (PARTITION BY gene_id, low, class ORDER BY read_id) AS turn FROM rcls1"
ORACLES["q80_read_display"] = sql(f"SELECT gene_id, low AS codon_start, read_id, class, shown FROM (SELECT *, cast(row_number() OVER (PARTITION BY gene_id, low ORDER BY turn, class) as int) AS shown FROM rcls2) WHERE shown <= {MOST}".replace("ORDER BY turn, class", "ORDER BY turn, CASE class WHEN 'mnv' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END"))


@query
def q81_fallback_second_pass(g):
    """What no codon speaks for, by label: each gene's own claim on the site, unless it was said already."""
    comps = g.snvs().select("contig", "pos", F.concat(F.lit("SNV:"), F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(">"), "alt").alias("label"))
    coded = codons.place_on_transcripts(g.snvs(), g.segments()).select("contig", "gene_id", F.concat(F.lit("SNV:"), F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(">"), "alt").alias("label"))
    first = fallback.classify(fallback.unspoken(comps, coded), g.genes(), g.segments())
    said = first.where("gene_id is not null").select("gene_id", "label", "term", F.lit(False).alias("coded")).unionByName(coded.select("gene_id", "label", F.lit("").alias("term"), F.lit(True).alias("coded")))
    second = fallback.second_pass(comps, g.genes(), g.segments(), said).select("contig", "pos", "label", "gene_id", "term", F.lit(2).alias("pass"))
    return first.select("contig", "pos", "label", "gene_id", "term", F.lit(1).alias("pass")).unionByName(second)


_lab = "'SNV:' || cast(v.pos as varchar) || ':' || v.ref || '>' || v.alt"
N["comps"] = f"SELECT v.chrom, v.pos, {_lab} AS label FROM snvs v"
N["coded"] = f"SELECT DISTINCT v.chrom, v.gene_id, {_lab} AS label FROM toff v"
N["unsaid"] = "SELECT * FROM comps c WHERE NOT EXISTS (SELECT 1 FROM coded d WHERE d.chrom = c.chrom AND d.label = c.label)"
N["pass1"] = "SELECT u.chrom, u.pos, u.label, c.gene_id, coalesce(c.term, 'intergenic_variant') AS term FROM unsaid u LEFT JOIN claimed c ON c.chrom = u.chrom AND c.pos = u.pos AND c.rn = 1"
N["best2"] = "SELECT k.chrom, k.pos, k.label, c.gene_id, c.term, row_number() OVER (PARTITION BY k.chrom, k.label, c.gene_id ORDER BY c.pr, c.term) AS rn FROM comps k JOIN claim c ON c.chrom = k.chrom AND c.pos = k.pos"
N["pass2"] = "SELECT b.chrom, b.pos, b.label, b.gene_id, b.term FROM best2 b WHERE b.rn = 1 AND NOT EXISTS (SELECT 1 FROM pass1 p WHERE p.gene_id = b.gene_id AND p.label = b.label AND p.term = b.term) AND NOT EXISTS (SELECT 1 FROM coded d WHERE d.gene_id = b.gene_id AND d.label = b.label)"
ORACLES["q81_fallback_second_pass"] = sql("SELECT cast(chrom as varchar) AS contig, pos, label, gene_id, term, cast(1 as int) AS pass FROM pass1 UNION ALL SELECT cast(chrom as varchar), pos, label, gene_id, term, cast(2 as int) FROM pass2")


@query
def q82_phase_contradiction(g):
    """Declared cis or trans of a codon that its molecules leave no room for."""
    gt = F.when(F.col("pos") % 4 == 1, "0|1").when(F.col("pos") % 4 == 2, "1|0").otherwise("1|1")
    m = _members(g).withColumn("p", phase.parse_phase(gt, F.lit("7"), F.lit(1)))
    said = m.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "p"))), lambda x: x["p"]).alias("phases"))
    seen = reads.phasing_support(_patterns(g), _members(g), KEYS)
    rows = said.join(seen, KEYS).withColumn("declared", phase.declared_phase(F.col("phases")))
    verdict = F.split("declared", ":")[0]
    bad = phase.reads_contradict(verdict, F.col("mnv_reads"), F.col("informative"))
    return rows.select(*KEYS, F.when(bad, F.concat("declared", F.lit("|contradicted-by-reads"))).otherwise(F.col("declared")).alias("declared"))


N["phasec"] = "SELECT gene_id, low, CASE WHEN max(CASE WHEN pos % 4 = 1 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN pos % 4 = 2 THEN 1 ELSE 0 END) = 1 THEN 'trans' ELSE 'cis' END AS v FROM members GROUP BY gene_id, low"
ORACLES["q82_phase_contradiction"] = sql("SELECT p.gene_id, p.low AS codon_start, p.v || ':7' || CASE WHEN h.mr + h.least_solo > 0 AND ((p.v = 'cis' AND h.mr = 0) OR (p.v = 'trans' AND h.mr = h.mr + h.least_solo)) THEN '|contradicted-by-reads' ELSE '' END AS declared FROM phasec p JOIN phas h ON h.gene_id = p.gene_id AND h.low = p.low")


@query
def q83_change_type_texts(g):
    """Change types from one-letter texts, and back from their labels."""
    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference()).select("gene_id", "codon_start", F.concat("ref_aa", F.col("aa_pos").cast("string"), "alt_aa").alias("text"), "change_type")
    odd = F.when(F.col("gene_id") % 7 == 0, F.lower("change_type")).otherwise(F.col("change_type"))
    return rows.select("gene_id", "codon_start", "text", consequence.change_type_of_text(F.col("text")).alias("change"), consequence.parse_change_type(odd).alias("parsed"))


ORACLES["q83_change_type_texts"] = sql("SELECT gene_id, low AS codon_start, ref_aa || cast(aa_pos as varchar) || alt_aa AS text, change_type AS change, CASE WHEN gene_id % 7 <> 0 THEN change_type END AS parsed FROM codon")


@query
def q84_number_texts(g):
    """Frequencies with four digits and p-values with a power of ten, as result tables show them."""
    rows = g.snvs().select("contig", "pos", "alt", (F.col("pos") % 97 / 160).alias("x"), (F.col("pos") % 89 / 2048 / (F.col("pos") % 7 + 1)).alias("y"))
    return rows.select("contig", "pos", "alt", text.fixed(F.col("x")).alias("freq"), text.power(F.col("y")).alias("p"))


ORACLES["q84_number_texts"] = sql("SELECT cast(chrom as varchar) AS contig, pos, alt, printf('%.4f', pos % 97 / 160::double) AS freq, replace(regexp_replace(printf('%.3e', pos % 89 / 2048::double / (pos % 7 + 1)::double), 'e([+-])0*([0-9]+)$', 'e\\1\\2'), 'e+', 'e') AS p FROM snvs")


def haplotype_rows(g: Genome, min_reads: int = 2, min_freq: float = 0.0) -> DataFrame:
    """Rows of local haplotypes: the compound allele of each supported combination with its molecules, depth and linkage."""
    key = ["gene_id", "island"]
    members = materialize(alleles.with_event(_windows(g)), "windows")
    tops = materialize(reads.top_haplotypes(_haplotypes(g, members), key, 64), "haplotypes")
    groups = phase.carried_groups(tops.select(*key, "pattern"), members.select(*key, "contig", "pos", "ref", "idx", "components", "affected_start", "affected_end"), key)
    rows = phase.compound_alleles(groups, g.reference(), [*key, "pattern"])
    known = members.select("contig", "pos", "ref", "alt").distinct()
    rows = materialize(rows.join(known, ALLELE, "left_anti"), "compounds")
    views = reads.observe_alleles(reads.usable(g.reads()), rows.select(*ALLELE, "components").distinct())
    exact = reads.indel_support(views, ALLELE, MIN_QUALITY).select(*ALLELE, "event_reads", "event_depth")
    linked = reads.codon_linkage(phase.restricted_patterns(tops.select(*key, "pattern", "molecules"), key).withColumnRenamed("pattern", "own").withColumnRenamed("sub", "pattern"), [*key, "own"])
    out = rows.join(exact, ALLELE).where("event_reads > 0").join(tops.select(*key, "pattern", "molecules", "forward", "reverse"), [*key, "pattern"])
    out = out.join(linked.select(*key, F.col("own").alias("pattern"), "d_prime"), [*key, "pattern"], "left")
    freq = filters.ratio(F.col("molecules"), F.col("event_depth"))
    return out.withColumn("freq", freq).where((F.col("molecules") >= min_reads) & (F.col("freq") >= min_freq))


@query
def q85_haplotype_rows(g):
    rows = haplotype_rows(g)
    return rows.select("gene_id", *ALLELE, "event_class", alleles.labels(F.col("components")).alias("components"), F.col("molecules").alias("event_reads"), "forward", "reverse", "event_depth", F.round("freq", 6).alias("freq"), F.round("d_prime", 6).alias("d_prime"))


N["htop"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, island ORDER BY molecules DESC, pattern) AS place FROM hpat) WHERE place <= 64"
N["hgrp"] = "SELECT h.gene_id, h.island, h.pattern, h.molecules, h.forward, h.reverse, m.chrom, min(least(m.a, m.pos)) AS lo, max(greatest(m.b, m.pos + length(m.ref) - 1)) AS hi FROM htop h JOIN hmem m ON m.gene_id = h.gene_id AND m.island = h.island AND substr(h.pattern, cast(m.idx + 1 as int), 1) = '1' GROUP BY ALL HAVING count(*) > 1 AND max(m.is_indel) = 1"
N["hown"] = "SELECT h.gene_id, h.island, h.pattern, m.pos, m.ref, m.alt, m.is_indel, m.a, m.b FROM hgrp h JOIN hmem m ON m.gene_id = h.gene_id AND m.island = h.island AND substr(h.pattern, cast(m.idx + 1 as int), 1) = '1'"
N["hbase"] = (
    f"SELECT g.gene_id, g.island, g.pattern, g.p, {base('g.p', 'g.chrom')} AS r, CASE WHEN i.pos IS NOT NULL AND length(i.ref) = 3 AND g.p BETWEEN i.pos + 1 AND i.pos + 2 THEN '' ELSE coalesce(s.alt, {base('g.p', 'g.chrom')}) END || CASE WHEN i.pos = g.p AND length(i.ref) = 1 THEN 'GTA' ELSE '' END AS x "
    "FROM (SELECT gene_id, island, pattern, chrom, unnest(generate_series(lo, hi)) AS p FROM hgrp) g LEFT JOIN hown s ON s.gene_id = g.gene_id AND s.island = g.island AND s.pattern = g.pattern AND s.is_indel = 0 AND s.pos = g.p LEFT JOIN hown i ON i.gene_id = g.gene_id AND i.island = g.island AND i.pattern = g.pattern AND i.is_indel = 1"
)
N["hallele"] = "SELECT g.gene_id, g.island, g.pattern, g.chrom, g.lo, g.hi, g.molecules, g.forward, g.reverse, string_agg(b.r, '' ORDER BY b.p) AS ref, string_agg(b.x, '' ORDER BY b.p) AS alt FROM hgrp g JOIN hbase b ON b.gene_id = g.gene_id AND b.island = g.island AND b.pattern = g.pattern GROUP BY ALL"
N["hread"] = "SELECT h.gene_id, h.island, h.pattern, h.chrom, h.lo, h.hi, h.alt, r.read_id, r.frag, r.mol, r.is_rev, r.start, r.shape, r.anchor FROM hallele h JOIN aln r ON r.chrom = h.chrom AND r.start <= h.hi + 1 AND r.start + 99 >= h.lo"
N["hseen"] = (
    f"SELECT r.*, CASE WHEN r.shape = 'D' AND p BETWEEN r.anchor + 1 AND r.anchor + 2 THEN '' WHEN p < r.start OR p > r.start + 99 OR (r.shape = 'N' AND p BETWEEN r.start + 50 AND r.start + 59) THEN NULL ELSE CASE WHEN o.pos IS NOT NULL AND {shows_alt('r', 'p')} THEN o.alt ELSE {base('p', 'r.chrom')} END END AS x, CASE WHEN r.shape = 'I' AND p = r.anchor THEN 'GTA' ELSE '' END AS put, {quality('r', 'p')} AS q "
    "FROM (SELECT *, unnest(generate_series(lo, hi + 1)) AS p FROM hread) r LEFT JOIN one o ON o.chrom = r.chrom AND o.pos = p"
)
N["hview"] = "SELECT gene_id, island, pattern, mol, read_id, is_rev, max(CASE WHEN p = lo AND x <> '' AND q >= 20 THEN 1 ELSE 0 END) AS covers, sum(CASE WHEN p <= hi AND x IS NULL THEN 1 ELSE 0 END) = 0 AND min(CASE WHEN p <= hi AND x <> '' THEN q END) >= 20 AS good, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) = 0 AS whole, string_agg(CASE WHEN p <= hi THEN coalesce(x, '') || put ELSE '' END, '' ORDER BY p) = max(alt) AS shows FROM hseen GROUP BY gene_id, island, pattern, mol, read_id, is_rev"
N["hexact"] = "SELECT gene_id, island, pattern, mol, max(covers) AS c, max(CASE WHEN good AND shows THEN 1 ELSE 0 END) AS s, max(CASE WHEN good AND whole AND NOT shows THEN 1 ELSE 0 END) AS against FROM hview GROUP BY gene_id, island, pattern, mol"
N["hcount"] = "SELECT gene_id, island, pattern, count(CASE WHEN s = 1 AND against = 0 THEN 1 END) AS exact, cast(sum(c) as bigint) AS depth FROM hexact GROUP BY gene_id, island, pattern"
_lbl = "CASE WHEN is_indel = 0 THEN 'SNV:' || pos || ':' || ref || '>' || alt WHEN length(ref) = 3 THEN 'DEL:' || (pos + 1) || '-' || (pos + 2) || ':' || substr(ref, 2) ELSE 'INS:' || pos || ':+' || substr(alt, 2) END"
N["hlabel"] = f"SELECT gene_id, island, pattern, string_agg({_lbl}, ' | ' ORDER BY CASE WHEN length(ref) = 3 THEN pos + 1 ELSE pos END, is_indel) AS components FROM hown GROUP BY gene_id, island, pattern"
N["hcarry"] = "SELECT gene_id, island, pattern, i, row_number() OVER (PARTITION BY gene_id, island, pattern ORDER BY i) AS k FROM (SELECT gene_id, island, pattern, unnest(generate_series(1, length(pattern))) AS i FROM hgrp) WHERE substr(pattern, cast(i as int), 1) = '1'"
N["hpair"] = (
    "SELECT x.gene_id, x.island, x.pattern, x.k AS i, y.k AS j, sum(CASE WHEN substr(h.pattern, cast(x.i as int), 1) = '1' AND substr(h.pattern, cast(y.i as int), 1) = '1' THEN h.molecules ELSE 0 END) AS a, sum(CASE WHEN substr(h.pattern, cast(x.i as int), 1) = '1' AND substr(h.pattern, cast(y.i as int), 1) = '0' THEN h.molecules ELSE 0 END) AS b, "
    "sum(CASE WHEN substr(h.pattern, cast(x.i as int), 1) = '0' AND substr(h.pattern, cast(y.i as int), 1) = '1' THEN h.molecules ELSE 0 END) AS c, sum(CASE WHEN substr(h.pattern, cast(x.i as int), 1) = '0' AND substr(h.pattern, cast(y.i as int), 1) = '0' THEN h.molecules ELSE 0 END) AS d "
    "FROM hcarry x JOIN hcarry y ON y.gene_id = x.gene_id AND y.island = x.island AND y.pattern = x.pattern AND y.k > x.k JOIN htop h ON h.gene_id = x.gene_id AND h.island = x.island GROUP BY x.gene_id, x.island, x.pattern, x.k, y.k"
)
N["hld0"] = N["ld0"].replace("FROM pairs", "FROM hpair")
N["hld1"] = N["ld1"].replace("FROM ld0", "FROM hld0")
N["hld2"] = N["ld2"].replace("FROM ld1", "FROM hld1")
N["hld3"] = "SELECT gene_id, island, pattern, min(greatest(-1.0, least(1.0, dis / top))) AS d_prime FROM hld2 WHERE top > 0 GROUP BY gene_id, island, pattern"
ORACLES["q85_haplotype_rows"] = sql(
    "SELECT h.gene_id, cast(h.chrom as varchar) AS contig, h.lo AS pos, h.ref, h.alt, 'complex_indel' AS event_class, l.components, h.molecules AS event_reads, h.forward, h.reverse, c.depth AS event_depth, round(CASE WHEN c.depth > 0 THEN h.molecules / c.depth::double ELSE 0 END, 6) AS freq, round(d.d_prime, 6) AS d_prime "
    "FROM hallele h JOIN hcount c ON c.gene_id = h.gene_id AND c.island = h.island AND c.pattern = h.pattern JOIN hlabel l ON l.gene_id = h.gene_id AND l.island = h.island AND l.pattern = h.pattern LEFT JOIN hld3 d ON d.gene_id = h.gene_id AND d.island = h.island AND d.pattern = h.pattern WHERE c.exact > 0 AND h.molecules >= 2"
)


@query
def q86_row_and_record_order(g):
    """Place of each codon row in the final order of a contig, and of each of its records in the order of the VCF."""
    from strandmill.plans.annotate import row_order, record_order
    from strandmill.sinks.vcf import expand_records

    rows = codons.codon_mnv(g.snvs(), g.genes(), g.reference()).withColumn("positions", F.transform("snvs", lambda s: s["pos"]))
    placed = rows.withColumn("row_place", F.row_number().over(Window.partitionBy("contig").orderBy(*row_order(), F.transform("snvs", lambda s: s["alt"]))))
    recs = expand_records(placed, g.reference())
    return recs.select("contig", "gene_id", "row_place", F.row_number().over(Window.partitionBy("contig").orderBy(*record_order(), "row_place", "type")).alias("record_place"), "pos", "ref", "alt")


N["orow"] = "SELECT *, cast(row_number() OVER (PARTITION BY chrom ORDER BY list_filter([CASE WHEN x0 IS NOT NULL THEN low END, CASE WHEN x1 IS NOT NULL THEN low + 1 END, CASE WHEN x2 IS NOT NULL THEN low + 2 END], lambda x: x IS NOT NULL)[1], list_filter([CASE WHEN x0 IS NOT NULL THEN low END, CASE WHEN x1 IS NOT NULL THEN low + 1 END, CASE WHEN x2 IS NOT NULL THEN low + 2 END], lambda x: x IS NOT NULL), n > 1, cast(gene_id as varchar), list_filter([x0, x1, x2], lambda x: x IS NOT NULL)) as int) AS row_place FROM codon"
N["orec"] = "SELECT chrom, gene_id, row_place, low + 0 AS pos, r0 AS ref, x0 AS alt, 'SNP' AS type FROM orow WHERE x0 IS NOT NULL UNION ALL SELECT chrom, gene_id, row_place, low + 1, r1, x1, 'SNP' FROM orow WHERE x1 IS NOT NULL UNION ALL SELECT chrom, gene_id, row_place, low + 2, r2, x2, 'SNP' FROM orow WHERE x2 IS NOT NULL UNION ALL SELECT chrom, gene_id, row_place, low + CASE WHEN x0 IS NULL THEN 1 ELSE 0 END, CASE WHEN x0 IS NULL THEN '' ELSE r0 END || r1 || CASE WHEN x2 IS NULL THEN '' ELSE r2 END, CASE WHEN x0 IS NULL THEN '' ELSE x0 END || coalesce(x1, r1) || CASE WHEN x2 IS NULL THEN '' ELSE x2 END, 'MNV' FROM orow WHERE n > 1"
ORACLES["q86_row_and_record_order"] = sql("SELECT cast(chrom as varchar) AS contig, gene_id, row_place, cast(row_number() OVER (PARTITION BY chrom ORDER BY pos, ref, alt, row_place, type) as int) AS record_place, pos, ref, alt FROM orec")


@query
def q87_representative_info(g):
    """The first INFO that any of a codon's records has."""
    info = F.when(F.col("pos") % 3 == 0, None).otherwise(F.concat(F.lit("K="), F.col("pos").cast("string"), "alt"))
    placed = codons.place_snvs(g.snvs(), g.genes()).withColumn("oinfo", info)
    return codons.representative_info(placed).select("gene_id", "codon_start", "oinfo")


ORACLES["q87_representative_info"] = sql("SELECT gene_id, low AS codon_start, min_by('K=' || pos || alt, (pos, alt)) FILTER (WHERE pos % 3 <> 0) AS oinfo FROM placed GROUP BY gene_id, low")


@query
def q88_touched_offsets(g):
    """Transcript offsets of all bases an indel occupies, and the first it changes."""
    rows = transcripts.touched_offsets(alleles.with_event(g.indels()).select(*ALLELE, "components"), g.segments())
    return rows.select("gene_id", *ALLELE, F.array_join(F.transform("touched", lambda x: x.cast("string")), ",").alias("touched"), "first_changed")


N["ibase"] = "SELECT chrom, pos, ref, alt, is_del, unnest(generate_series(pos, pos + length(ref) - 1)) AS p FROM indels"
N["itouch"] = "SELECT i.*, s.gene_id, s.strand, s.offset0 + CASE WHEN s.strand = '-' THEN s.seg_end - i.p ELSE i.p - s.seg_start END AS off FROM ibase i JOIN offs s ON s.chrom = i.chrom AND i.p BETWEEN s.seg_start AND s.seg_end"
ORACLES["q88_touched_offsets"] = sql("SELECT gene_id, cast(chrom as varchar) AS contig, pos, ref, alt, string_agg(cast(cast(off as bigint) as varchar), ',' ORDER BY off) AS touched, cast(min(CASE WHEN is_del = 1 THEN CASE WHEN p > pos THEN off END ELSE off + CASE WHEN strand = '+' THEN 1 ELSE 0 END END) as bigint) AS first_changed FROM itouch GROUP BY gene_id, chrom, pos, ref, alt")


@query
def q89_indel_splice_class(g):
    """The most severe splice class over the positions that an indel changes."""
    rows = transcripts.allele_splice(alleles.with_event(g.indels()).select(*ALLELE, "components"), g.segments())
    return rows.select("gene_id", *ALLELE, "splice")


N["isites"] = "SELECT chrom, pos, ref, alt, p FROM chgpos"
N["isp0"] = "SELECT i.gene_id, v.chrom, v.pos, v.ref, v.alt, CASE WHEN i.strand = '+' THEN v.p - i.i_start + 1 ELSE i.i_end - v.p + 1 END AS d, CASE WHEN i.strand = '+' THEN i.i_end - v.p + 1 ELSE v.p - i.i_start + 1 END AS a FROM isites v JOIN introns i ON i.chrom = v.chrom AND v.p BETWEEN i.i_start - 3 AND i.i_end + 3"
N["isp1"] = "SELECT *, CASE WHEN d BETWEEN 1 AND 2 THEN 'splice_donor_variant' WHEN a BETWEEN 1 AND 2 THEN 'splice_acceptor_variant' WHEN d BETWEEN -2 AND 8 OR a BETWEEN -2 AND 8 THEN 'splice_region_variant' END AS splice FROM isp0"
ORACLES["q89_indel_splice_class"] = sql("SELECT gene_id, cast(chrom as varchar) AS contig, pos, ref, alt, CASE WHEN max(CASE WHEN splice <> 'splice_region_variant' THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN splice <> 'splice_region_variant' THEN splice END) ELSE 'splice_region_variant' END AS splice FROM isp1 WHERE splice IS NOT NULL GROUP BY gene_id, chrom, pos, ref, alt")
