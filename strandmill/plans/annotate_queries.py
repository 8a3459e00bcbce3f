"""The whole plan over the derived genome, and what reads say of upstream indels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.consequence import FRAMESHIFTED, SO_TERMS
from strandmill.functions import alleles
from strandmill.operators import codons, evidence, indels, linkage
from strandmill.plans import evidence_queries  # noqa: F401  its relations are read below
from strandmill.plans import frame_queries as fq
from strandmill.plans.annotate import _codon_rows, annotate
from strandmill.plans.fixture import Genome
from strandmill.plans.oracles import ORACLES, N, fisher, sql
from strandmill.plans.queries import ALLELE, GATE, MIN_QUALITY, _read_indels, query
from strandmill.scratch import materialize


@query
def q101_frameshift_phasing(g):
    """What the reads say of each codon and the indels upstream of it that pass the gate: the reported pair, and the shift that lies on other molecules."""
    events, snvs = _read_indels(g), g.one_alt()
    told = linkage.indel_evidence(events, snvs, g.reads(), MIN_QUALITY)
    placed = materialize(indels.place_indels(events, g.genes()).join(told.observed, ALLELE, "left"), "placed")
    passing = placed.where(indels.passes_gate(F.col("observed"), F.lit(None).cast("double"), GATE))
    upstream = passing.select("gene_id", *ALLELE, indels.upstream_key(F.col("components"), F.col("strand")).alias("order"), indels.coding_delta(F.col("components"), F.col("g_start"), F.col("g_end")).alias("delta"))
    rows = codons.alternatives(codons.codon_groups(codons.place_snvs(snvs, g.genes()))).withColumn("place", indels.codon_key(F.col("strand"), F.col("codon_start")))
    return linkage.codon_linkage(rows, upstream, told.pairs).select("gene_id", "codon_start", "trans_shift", "frameshift_phasing")


def _gup() -> str:
    return "((i.is_del = 1 AND ((k.strand = '+' AND i.pos + 2 < k.low) OR (k.strand = '-' AND i.pos + 1 > k.low + 2))) OR (i.is_del = 0 AND ((k.strand = '+' AND i.pos < k.low) OR (k.strand = '-' AND i.pos >= k.low + 2))))"


N["fp0"] = f"SELECT k.gene_id, k.low, i.pos AS ipos, i.delta, t.cis, t.informative, CASE WHEN t.informative < 2 THEN 2 WHEN t.cis <= 0.1 * t.informative THEN 0 ELSE 1 END AS verdict FROM rkeys k JOIN gplaced i ON i.gene_id = k.gene_id AND {_gup()} JOIN linkp t ON t.gene_id = k.gene_id AND t.ipos = i.pos AND t.spos = k.spos"
N["fp1"] = "SELECT *, row_number() OVER (PARTITION BY gene_id, low, ipos ORDER BY verdict, cis, informative) AS rn FROM fp0"
ORACLES["q101_frameshift_phasing"] = sql("SELECT gene_id, low AS codon_start, cast(sum(CASE WHEN verdict = 0 THEN delta ELSE 0 END) as bigint) AS trans_shift, string_agg(CASE verdict WHEN 0 THEN 'trans' WHEN 1 THEN 'cis' ELSE 'unknown' END || ':' || cast(ipos as varchar) || ':' || cast(cis as varchar) || '/' || cast(informative as varchar), ' | ' ORDER BY ipos) AS frameshift_phasing FROM fp1 WHERE rn = 1 GROUP BY gene_id, low")


def _alleles(g: Genome):
    cols = [*ALLELE, "ofreq"]
    return g.snvs().select(*ALLELE, F.col("ofreq").cast("double").alias("ofreq")).unionByName(g.indels().select(*ALLELE, F.col("af").cast("double").alias("ofreq"))).select(*cols)


@query
def q102_annotated_rows(g):
    """The whole plan: codon rows of plain and spliced genes, indel rows, fallback rows and what further genes say."""
    rows = annotate(_alleles(g), g.genes(), g.reference(), g.models())
    return rows.select("contig", "gene_id", "components", "variant_type", "change_type", "aa_change", "local_snp_aa_changes", "so_term", "nmd", "hgvs_g")


def _term(change: str, grows: str = "NULL") -> str:
    return f"CASE WHEN {change} = 'In-frame Indel' THEN CASE WHEN {grows} THEN 'inframe_insertion' ELSE 'inframe_deletion' END ELSE coalesce(CASE {change} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in SO_TERMS.items()) + " END, 'coding_sequence_variant') END"


def _beside(term: str, splice: str) -> str:
    return f"CASE WHEN {splice} IS NULL THEN {term} WHEN {term} <> 'coding_sequence_variant' THEN {term} || '&' || {splice} ELSE {splice} END"


_shifted = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FRAMESHIFTED.items()) + " ELSE {0} END"
# labels and descriptors of the alleles' single components
_snv = lambda p, r, a: f"'SNV:' || cast({p} as varchar) || ':' || {r} || '>' || {a}"
_ind = "CASE WHEN is_del = 0 THEN 'INS:' || cast(pos as varchar) || ':+' || substr(alt, 2) WHEN size = 1 THEN 'DEL:' || cast(pos + 1 as varchar) || ':' || substr(ref, 2) ELSE 'DEL:' || cast(pos + 1 as varchar) || '-' || cast(pos + size as varchar) || ':' || substr(ref, 2) END"
_indg = "CASE WHEN is_del = 0 THEN 'g.' || cast(pos as varchar) || '_' || cast(pos + 1 as varchar) || 'ins' || substr(alt, 2) WHEN size = 1 THEN 'g.' || cast(pos + 1 as varchar) || 'del' ELSE 'g.' || cast(pos + 1 as varchar) || '_' || cast(pos + size as varchar) || 'del' END"
N["wlab"] = f"SELECT DISTINCT chrom, pos, {_snv('pos', 'ref', 'alt')} AS label, 'SNP' AS type, 'g.' || cast(pos as varchar) || ref || '>' || alt AS g FROM snvs UNION ALL SELECT DISTINCT chrom, pos + is_del, {_ind}, 'INDEL', {_indg} FROM indels"
N["plaing"] = "SELECT * FROM genes WHERE ge - gs + 1 < 90"
# splice classes and introns of the transcripts
N["mintron"] = "SELECT gene_id, chrom, strand, CASE WHEN strand = '+' THEN seg_end + 1 ELSE e2 + 1 END AS i_start, CASE WHEN strand = '+' THEN s2 - 1 ELSE seg_start - 1 END AS i_end FROM (SELECT *, lead(seg_start) OVER w AS s2, lead(seg_end) OVER w AS e2 FROM moffs WINDOW w AS (PARTITION BY gene_id ORDER BY seg_idx)) WHERE (strand = '+' AND s2 > seg_end + 1) OR (strand = '-' AND e2 < seg_start - 1)"
N["msites"] = "SELECT DISTINCT chrom, pos FROM snvs UNION SELECT DISTINCT chrom, p FROM chgpos"
N["msp0"] = "SELECT i.gene_id, v.chrom, v.pos, CASE WHEN i.strand = '+' THEN v.pos - i.i_start + 1 ELSE i.i_end - v.pos + 1 END AS d, CASE WHEN i.strand = '+' THEN i.i_end - v.pos + 1 ELSE v.pos - i.i_start + 1 END AS a FROM msites v JOIN mintron i ON i.chrom = v.chrom AND v.pos BETWEEN i.i_start - 3 AND i.i_end + 3"
N["msplice"] = "SELECT * FROM (SELECT gene_id, chrom, pos, CASE WHEN d BETWEEN 1 AND 2 THEN 'splice_donor_variant' WHEN a BETWEEN 1 AND 2 THEN 'splice_acceptor_variant' WHEN d BETWEEN -2 AND 8 OR a BETWEEN -2 AND 8 THEN 'splice_region_variant' END AS splice FROM msp0) WHERE splice IS NOT NULL"
_worst = "coalesce(max(CASE WHEN splice <> 'splice_region_variant' THEN splice END), max(splice)) AS splice"
# codon rows
_lab3 = lambda p, f, a: f"CASE WHEN {a} IS NOT NULL THEN {_snv(p, f, a)} END"
_pl = [_lab3(f"low + {i}", f"r{i}", f"x{i}") for i in range(3)]
_gs = [f"CASE WHEN x{i} IS NOT NULL THEN cast(low + {i} as varchar) || r{i} || '>' || x{i} END" for i in range(3)]
_mark = lambda x: f"CASE WHEN over = 1 THEN 'Unknown' WHEN past THEN 'downstream of premature stop' WHEN off THEN {x} || ' (fs)' ELSE {x} END"
N["wplain0"] = (
    f"SELECT cast(f.chrom as varchar) AS contig, cast(f.gene_id as varchar) AS gene_id, concat_ws(' | ', {', '.join(_pl)}) AS components, variant_type, CASE WHEN over = 1 THEN 'Indel overlap' WHEN past THEN 'Downstream of premature stop' WHEN off THEN {_shifted.format('change_type')} ELSE change_type END AS change_type, "
    f"{_mark('aa_change')} AS aa_change, array_to_string([{_mark('z')} for z in string_split(snp_aa_changes, ', ')], ', ') AS local_snp_aa_changes, CASE WHEN n > 1 THEN 'g.[' || concat_ws(';', {', '.join(_gs)}) || ']' ELSE 'g.' || concat_ws(';', {', '.join(_gs)}) END AS hgvs_g FROM fsrow f WHERE f.ge - f.gs + 1 < 90"
)
N["wplain"] = f"SELECT contig, gene_id, components, variant_type, change_type, aa_change, local_snp_aa_changes, {_term('change_type')} AS so_term, cast(NULL as varchar) AS nmd, hgvs_g FROM wplain0"
_told, _each, _aa = fq._told, fq._each, fq._aa
_order = lambda f, sep: f"CASE WHEN strand = '-' THEN concat_ws('{sep}', {f(2)}, {f(1)}, {f(0)}) ELSE concat_ws('{sep}', {f(0)}, {f(1)}, {f(2)}) END"
_ml = lambda i: _lab3(f"p{i}", f"f{i}", f"a{i}")
_mg = lambda i: f"CASE WHEN a{i} IS NOT NULL THEN cast(p{i} as varchar) || f{i} || '>' || a{i} END"
N["wcod0"] = (
    f"SELECT gene_id AS gid, p0, p1, p2, codon, snvs, {_order(_ml, ' | ')} AS components, (a0 IS NOT NULL)::int + (a1 IS NOT NULL)::int + (a2 IS NOT NULL)::int AS k, CASE WHEN over THEN 'Indel overlap' WHEN off AND behind THEN 'Downstream of premature stop' WHEN off THEN {_shifted.format('change_type')} ELSE change_type END AS change_type, "
    f"{_told(_aa('aa'))} AS aa_change, {_order(_each, ', ')} AS local_snp_aa_changes, {_order(_mg, ';')} AS gtext, CASE WHEN NOT over AND NOT off AND change_type = 'Stop gained' AND last_junction IS NOT NULL THEN CASE WHEN codon * 3 + 50 < last_junction THEN 'NMD-triggering' ELSE 'NMD-escaping' END END AS nmd FROM mrow3"
)
N["wcodsp"] = f"SELECT c.gid, c.codon, c.snvs, {_worst} FROM wcod0 c JOIN msplice s ON s.gene_id = c.gid AND s.pos IN (c.p0, c.p1, c.p2) GROUP BY c.gid, c.codon, c.snvs"
N["wcod"] = (
    f"SELECT cast(g.chrom as varchar) AS contig, cast(c.gid as varchar) AS gene_id, components, CASE WHEN k = 1 THEN 'SNP' ELSE 'SNP/MNV' END AS variant_type, change_type, aa_change, local_snp_aa_changes, {_beside(_term('change_type'), 's.splice')} AS so_term, nmd, CASE WHEN k > 1 THEN 'g.[' || gtext || ']' ELSE 'g.' || gtext END AS hgvs_g "
    "FROM wcod0 c JOIN genes g ON g.gene_id = c.gid LEFT JOIN wcodsp s ON s.gid = c.gid AND s.codon = c.codon AND s.snvs = c.snvs"
)
# indel rows
_says = fq._says
_grow = "length(alt) > length(ref)"
N["wind0"] = f"SELECT chrom, gene_id, pos, ref, alt, is_del, size, change_type, {_says} AS aa_change FROM prot4 WHERE ge - gs + 1 < 90"
N["wind"] = f"SELECT cast(chrom as varchar) AS contig, cast(gene_id as varchar) AS gene_id, {_ind} AS components, 'INDEL' AS variant_type, change_type, aa_change, cast(NULL as varchar) AS local_snp_aa_changes, {_term('change_type', _grow)} AS so_term, cast(NULL as varchar) AS nmd, {_indg} AS hgvs_g FROM wind0"
N["wsind0"] = f"SELECT chrom, gene_id, pos, ref, alt, is_del, size, change_type, {_says} AS aa_change FROM mprot4"
N["wnmd"] = ORACLES["q99_spliced_indel_nmd"][ORACLES["q99_spliced_indel_nmd"].rindex("SELECT gene_id, cast(chrom as varchar) AS contig") :]
N["windsp"] = f"SELECT c.chrom, c.pos, c.ref, c.alt, s.gene_id, {_worst} FROM chgpos c JOIN msplice s ON s.chrom = c.chrom AND s.pos = c.p GROUP BY c.chrom, c.pos, c.ref, c.alt, s.gene_id"
N["wsind"] = (
    f"SELECT cast(e.chrom as varchar) AS contig, cast(e.gene_id as varchar) AS gene_id, e.components, 'INDEL' AS variant_type, e.change_type, e.aa_change, cast(NULL as varchar) AS local_snp_aa_changes, {_beside(_term('e.change_type', 'length(e.alt) > length(e.ref)'), 's.splice')} AS so_term, m.nmd, e.hgvs_g "
    f"FROM (SELECT *, {_ind} AS components, {_indg} AS hgvs_g FROM wsind0) e JOIN wnmd m ON m.gene_id = e.gene_id AND m.pos = e.pos AND m.ref = e.ref AND m.alt = e.alt LEFT JOIN windsp s ON s.gene_id = e.gene_id AND s.chrom = e.chrom AND s.pos = e.pos AND s.ref = e.ref AND s.alt = e.alt"
)
N["wcoded"] = "SELECT * FROM wplain UNION ALL SELECT * FROM wcod UNION ALL SELECT * FROM wind UNION ALL SELECT * FROM wsind"
# what no row carries, then what each gene adds
N["wspoken"] = "SELECT DISTINCT contig, gene_id, unnest(string_split(components, ' | ')) AS label FROM wcoded"
N["wclaim"] = (
    "SELECT v.chrom, v.label, cast(g.gene_id as varchar) AS gene_id, 'coding_sequence_variant' AS term, 3 AS pr FROM wlab v JOIN genes g ON g.chrom = v.chrom AND v.pos BETWEEN g.gs AND g.ge "
    "UNION ALL SELECT v.chrom, v.label, cast(s.gene_id as varchar), s.splice, 1 FROM wlab v JOIN msplice s ON s.chrom = v.chrom AND s.pos = v.pos UNION ALL SELECT v.chrom, v.label, cast(i.gene_id as varchar), 'intron_variant', 2 FROM wlab v JOIN mintron i ON i.chrom = v.chrom AND v.pos BETWEEN i.i_start AND i.i_end"
)
N["wfirst"] = "SELECT v.chrom, v.label, c.gene_id, coalesce(c.term, 'intergenic_variant') AS term FROM wlab v LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY chrom, label ORDER BY pr, gene_id, term) AS rn FROM wclaim) c ON c.chrom = v.chrom AND c.label = v.label AND c.rn = 1 WHERE NOT EXISTS (SELECT 1 FROM wspoken s WHERE s.contig = cast(v.chrom as varchar) AND s.label = v.label)"
N["wmore"] = (
    "SELECT c.chrom, c.label, c.gene_id, c.term FROM (SELECT *, row_number() OVER (PARTITION BY chrom, label, gene_id ORDER BY pr, term) AS rn FROM wclaim) c WHERE c.rn = 1 AND NOT EXISTS (SELECT 1 FROM wfirst f WHERE f.gene_id = c.gene_id AND f.label = c.label AND f.term = c.term) AND NOT EXISTS (SELECT 1 FROM wspoken s WHERE s.gene_id = c.gene_id AND s.label = c.label)"
)
ORACLES["q102_annotated_rows"] = sql(
    "SELECT * FROM wcoded UNION ALL SELECT cast(f.chrom as varchar), coalesce(f.gene_id, 'intergenic'), f.label, v.type, 'Unknown', cast(NULL as varchar), cast(NULL as varchar), f.term, cast(NULL as varchar), v.g FROM (SELECT * FROM wfirst UNION ALL SELECT * FROM wmore) f JOIN wlab v ON v.chrom = f.chrom AND v.label = f.label"
)


_CELLS = ("SNP Reads", "SNP Forward Reads", "SNP Reverse Reads", "MNV Reads", "MNV Forward Reads", "MNV Reverse Reads", "Total Reads", "SNP Frequencies", "MNV Frequencies", "Event Reads", "Event Forward Reads", "Event Reverse Reads", "Event Depth", "Event Frequency", "MNV Phasing Reads")


def _evidence_rows(g: Genome):
    """Codon rows of the first alternates and rows of the read indels, with all support."""
    cols = ["contig", "gene_id", "positions", "alt_bases", "components", "variant_type"]
    subs = _codon_rows(codons.codon_mnv(g.one_alt(), g.genes(), g.reference())).select(*cols)
    events = _read_indels(g)
    ind = indels.place_indels(events, g.genes()).select("contig", "gene_id", F.array("pos").alias("positions"), F.array("alt").alias("alt_bases"), alleles.labels(F.col("components")).alias("components"), F.lit("INDEL").alias("variant_type"))
    rows = subs.unionByName(ind).withColumn("gene_id", F.col("gene_id").cast("string"))
    return evidence.attach_support(rows, events, g.reads(), MIN_QUALITY)


@query
def q103_row_evidence(g):
    """Read cells of substitution and indel rows: sites, haplotypes, linkage and events, each counted once."""
    rows = _evidence_rows(g)
    cells = evidence.read_cells(rows)
    places = F.array_join(F.transform("positions", lambda p: p.cast("string")), ", ")
    return rows.select("contig", "gene_id", places.alias("positions"), "variant_type", *(cells[n].alias(n.lower().replace(" ", "_")) for n in _CELLS), F.round("ld", 6).alias("ld"), F.round("ld_p", 6).alias("ld_p"))


@query
def q104_supported_rows(g):
    """Rows that the table keeps under thresholds of both sides."""
    rows = _evidence_rows(g)
    places = F.array_join(F.transform("positions", lambda p: p.cast("string")), ", ")
    return rows.where(evidence.passes_support(min_snp_reads=1, min_snp_freq=0.25, min_mnv_reads=2, min_mnv_freq=0.1, min_mnv_strand=1)).select("contig", "gene_id", places.alias("positions"), "variant_type")


N["ev0"] = "SELECT gene_id, low, chrom, pos, alt, row_number() OVER (PARTITION BY gene_id, low ORDER BY pos) AS idx, count(*) OVER (PARTITION BY gene_id, low) AS n FROM placed1"
N["evsolo"] = "SELECT m.gene_id, m.low, m.pos, count(*) AS sr, sum(s.fwd) AS sf, sum(s.rev) AS sv FROM ev0 m JOIN seen s ON s.chrom = m.chrom AND s.pos = m.pos AND s.base = m.alt JOIN pat p ON p.gene_id = m.gene_id AND p.low = m.low AND p.mol = s.mol WHERE m.n > 1 AND p.hits < p.n GROUP BY m.gene_id, m.low, m.pos"
N["evsite"] = "SELECT e.*, CASE WHEN e.n = 1 THEN s.snp_reads ELSE coalesce(x.sr, 0) END AS sr, CASE WHEN e.n = 1 THEN s.snp_forward ELSE coalesce(x.sf, 0) END AS sf, CASE WHEN e.n = 1 THEN s.snp_reverse ELSE coalesce(x.sv, 0) END AS sv, s.depth FROM ev0 e JOIN support s ON s.chrom = e.chrom AND s.pos = e.pos AND s.alt = e.alt LEFT JOIN evsolo x ON x.gene_id = e.gene_id AND x.low = e.low AND x.pos = e.pos"
N["evmnv"] = "SELECT gene_id, low, count(CASE WHEN hits = n THEN 1 END) AS mr, count(CASE WHEN hf = n THEN 1 END) AS mf, count(CASE WHEN hr = n THEN 1 END) AS mv, count(CASE WHEN k = n THEN 1 END) AS md FROM pat GROUP BY gene_id, low"
N["evrow"] = (
    "SELECT s.chrom, s.gene_id, s.low, max(s.n) AS n, string_agg(cast(s.pos as varchar), ', ' ORDER BY s.idx) AS positions, string_agg(cast(cast(s.sr as bigint) as varchar), ', ' ORDER BY s.idx) AS sr, string_agg(cast(cast(s.sf as bigint) as varchar), ', ' ORDER BY s.idx) AS sf, string_agg(cast(cast(s.sv as bigint) as varchar), ', ' ORDER BY s.idx) AS sv, "
    "string_agg(printf('%.4f', CASE WHEN s.depth > 0 THEN s.sr / s.depth::double ELSE 0.0::double END), ', ' ORDER BY s.idx) AS freq, cast(sum(s.depth) // count(*) as bigint) AS mean, min(CASE WHEN s.sr >= 1 AND CASE WHEN s.depth > 0 THEN s.sr / s.depth::double ELSE 0 END >= 0.25 THEN 1 ELSE 0 END) AS site_ok FROM evsite s GROUP BY s.chrom, s.gene_id, s.low"
)
N["evwide"] = "SELECT r.*, coalesce(m.mr, 0) AS mr, coalesce(m.mf, 0) AS mf, coalesce(m.mv, 0) AS mv, CASE WHEN r.n = 1 THEN r.mean ELSE coalesce(m.md, 0) END AS md, CASE WHEN r.n > 1 THEN nullif(coalesce(p.mr + p.least_solo, 0), 0) END AS inf FROM evrow r LEFT JOIN evmnv m ON m.gene_id = r.gene_id AND m.low = r.low LEFT JOIN phas p ON p.gene_id = r.gene_id AND p.low = r.low"
N["evld"] = f"SELECT l.gene_id, l.low, l.d_prime, p.p FROM ldmin l JOIN ({fisher('ldmin', 'gene_id, low', 'a', 'b', 'c', 'd')}) p ON p.gene_id = l.gene_id AND p.low = l.low"
N["evind"] = "SELECT chrom, pos, ref, alt, count(CASE WHEN s = 1 AND against = 0 THEN 1 END) AS er, count(CASE WHEN s = 1 AND against = 0 AND f = 1 THEN 1 END) AS ef, count(CASE WHEN s = 1 AND against = 0 AND r = 1 THEN 1 END) AS ev, cast(sum(c) as bigint) AS ed FROM ispan GROUP BY chrom, pos, ref, alt"
N["evrind"] = "SELECT r.chrom, r.gene_id, r.pos, coalesce(e.er, 0) AS er, coalesce(e.ef, 0) AS ef, coalesce(e.ev, 0) AS ev, coalesce(e.ed, 0) AS ed FROM rplaced r LEFT JOIN evind e ON e.chrom = r.chrom AND e.pos = r.pos AND e.ref = r.ref AND e.alt = r.alt"
_s = lambda c: f"cast({c} as varchar)"
_f = lambda a, d: f"printf('%.4f', CASE WHEN {d} > 0 THEN {a} / {d}::double ELSE 0.0::double END)"
ORACLES["q103_row_evidence"] = sql(
    f"SELECT cast(w.chrom as varchar) AS contig, cast(w.gene_id as varchar) AS gene_id, w.positions, CASE WHEN n = 1 THEN 'SNP' ELSE 'SNP/MNV' END AS variant_type, sr AS snp_reads, sf AS snp_forward_reads, sv AS snp_reverse_reads, {_s('mr')} AS mnv_reads, {_s('mf')} AS mnv_forward_reads, {_s('mv')} AS mnv_reverse_reads, {_s('md')} AS total_reads, freq AS snp_frequencies, {_f('mr', 'md')} AS mnv_frequencies, "
    f"'-' AS event_reads, '-' AS event_forward_reads, '-' AS event_reverse_reads, '-' AS event_depth, '-' AS event_frequency, coalesce({_s('cast(inf as bigint)')}, '-') AS mnv_phasing_reads, round(l.d_prime, 6) AS ld, l.p AS ld_p FROM evwide w LEFT JOIN evld l ON l.gene_id = w.gene_id AND l.low = w.low "
    f"UNION ALL SELECT cast(chrom as varchar), cast(gene_id as varchar), {_s('pos')}, 'INDEL', '-', '-', '-', '-', '-', '-', '-', '-', '-', {_s('er')}, {_s('ef')}, {_s('ev')}, {_s('ed')}, {_f('er', 'ed')}, '-', NULL, NULL FROM evrind"
)
_ok = lambda r, f, v, d: f"{r} >= 2 AND {f} >= 1 AND {v} >= 1 AND CASE WHEN {d} > 0 THEN {r} / {d}::double ELSE 0 END >= 0.1"
ORACLES["q104_supported_rows"] = sql(
    f"SELECT cast(chrom as varchar) AS contig, cast(gene_id as varchar) AS gene_id, positions, CASE WHEN n = 1 THEN 'SNP' ELSE 'SNP/MNV' END AS variant_type FROM evwide WHERE site_ok = 1 OR (n > 1 AND {_ok('mr', 'mf', 'mv', 'md')}) UNION ALL SELECT cast(chrom as varchar), cast(gene_id as varchar), {_s('pos')}, 'INDEL' FROM evrind WHERE {_ok('er', 'ef', 'ev', 'ed')}"
)
