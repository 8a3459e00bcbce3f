"""Queries over frames, stops and effects of indels in spliced transcripts and in genes of any phase, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.consequence import FRAMESHIFTED
from strandmill.operators import codons, frames, indels, reference, transcripts
from strandmill.plans.fixture import Genome
from strandmill.plans.oracles import ORACLES, N, change, residue, revcomp, sql, three
from strandmill.plans.queries import ALLELE, _events, _join, query
from strandmill.scratch import materialize


def _effects(g: Genome):
    """(effects with af and first offsets, touched ranges) of the indels of all transcripts."""
    events = _events(g)
    ranges = materialize(frames.touched_ranges(events, g.models()), "ranges")
    rows = indels.spliced_effects(events, g.models(), g.reference())
    rows = rows.join(frames.first_offsets(ranges).drop("strand"), ["gene_id", *ALLELE]).join(events.select(*ALLELE, "af"), ALLELE)
    return materialize(rows, "effects"), ranges


@query
def q98_spliced_frame_rows(g):
    """Codon rows of spliced transcripts as indels leave them: frames by transcript offsets, premature stops, overlaps, and decay by the last real intron."""
    effects, ranges = _effects(g)
    rows = codons.transcript_mnv(g.snvs().select("contig", "pos", "ref", "alt"), g.models(), g.reference())
    states = frames.frame_states(rows.select("gene_id", "codon_start"), effects, ranges)
    rows = indels.relabel_rows(rows, states, indels.premature_stops(effects)).join(transcripts.last_junctions(g.models()), "gene_id", "left")
    decay = F.when(F.col("change_type") == "Stop gained", indels.nmd(F.col("codon_start") * 3, F.col("last_junction")))
    snvs = _join(F.col("snvs"), lambda s: F.concat(s["pos"].cast("string"), s["ref"], F.lit(">"), s["alt"]))
    return rows.select("gene_id", F.col("codon_start").alias("codon"), snvs.alias("snvs"), "aa_change", "local_snp_aa_changes", "change_type", decay.alias("nmd"))


@query
def q99_spliced_indel_nmd(g):
    """Indels of spliced transcripts: codons at the first touched base, stops, and decay judged in altered coordinates."""
    effects, _ = _effects(g)
    rows = indels.with_codons(frames.altered_nmd(effects, transcripts.last_junctions(g.models())), F.col("first_touched"))
    return rows.select("gene_id", *ALLELE, "delta", F.col("first_changed").cast("long").alias("first_changed"), "change_type", "ref_codon", "alt_codon", F.col("alt_stop").cast("long").alias("alt_stop"), "nmd")


def _phased(g: Genome):
    """Genes with phases 0 to 2 and the residues before them."""
    k = F.col("gene_id")
    return g.genes().withColumn("phase", (k % 3).cast("int")).withColumn("protein_offset", k % 7)


@query
def q100_phased_indel_effects(g):
    """Indels of genes that begin within a codon: change type and both texts, codons at the first touched base."""
    genes = _phased(g)
    seqs = reference.intervals_sequence(genes, g.reference(), ["gene_id"], "start", "end")
    rows = indels.protein_effects(indels.place_indels(_events(g), genes), seqs, offset=F.col("protein_offset"))
    return rows.select("gene_id", *ALLELE, "delta", "change_type", "protein_change", "local_change", "ref_codon", "alt_codon")


# what follows is the SQL: offsets base by base, sequences as joined strings
N["moffs"] = N["offs"].replace("FROM segments", "FROM models")
N["mtop"] = "SELECT gene_id, max(seg_idx) AS top, sum(seg_end - seg_start + 1) AS total FROM models GROUP BY gene_id"
N["mseg"] = "SELECT o.*, CASE WHEN o.strand = '+' THEN o.seg_idx < t.top ELSE o.seg_idx > 0 END AS inside FROM moffs o JOIN mtop t ON t.gene_id = o.gene_id"
_off = lambda p: f"s.offset0 + CASE WHEN s.strand = '-' THEN s.seg_end - {p} ELSE {p} - s.seg_start END"
N["mbase"] = f"SELECT i.chrom, i.pos, i.ref, i.alt, i.is_del, i.size, i.af, s.gene_id, s.strand, {_off('b.p')} AS off FROM indels i JOIN (SELECT chrom, pos, ref, alt, p FROM chgpos) b ON b.chrom = i.chrom AND b.pos = i.pos AND b.ref = i.ref AND b.alt = i.alt JOIN mseg s ON s.chrom = i.chrom AND b.p BETWEEN s.seg_start AND s.seg_end"
N["manchor"] = "SELECT DISTINCT s.gene_id, i.chrom, i.pos, i.ref, i.alt FROM indels i JOIN mseg s ON s.chrom = i.chrom AND i.is_del = 0 AND i.pos >= s.seg_start AND (i.pos < s.seg_end OR (i.pos = s.seg_end AND s.inside))"
N["mtouch"] = "SELECT b.* FROM mbase b LEFT JOIN manchor a ON a.gene_id = b.gene_id AND a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt WHERE b.is_del = 1 OR a.gene_id IS NOT NULL"
N["mfirst"] = "SELECT gene_id, strand, chrom, pos, ref, alt, is_del, size, af, min(off) AS touched, min(off) + CASE WHEN is_del = 0 AND strand = '+' THEN 1 ELSE 0 END AS changed, greatest(min(off) - CASE WHEN is_del = 0 AND strand = '-' THEN 1 ELSE 0 END, 0) AS effective FROM mtouch GROUP BY gene_id, strand, chrom, pos, ref, alt, is_del, size, af"
N["mdist"] = "SELECT DISTINCT gene_id, off // 3 AS codon FROM mtouch WHERE is_del = 1 OR (strand = '+' AND off % 3 <> 2) OR (strand = '-' AND off % 3 <> 0)"
for _new, _old in (("msseq", "sseq"), ("msinner", "sinner"), ("mshit", "shit"), ("mspart", "spart"), ("mseffect", "seffect")):
    _text = N[_old].replace("segments", "models")
    for _n in ("sseq", "sinner", "shit", "spart"):
        _text = _text.replace(f"FROM {_n}", f"FROM m{_n}").replace(f"JOIN {_n}", f"JOIN m{_n}")
    N[_new] = _text
for _k, _old in enumerate(("effect", "prot0", "prot1", "prot2", "prot3")):
    N[f"mprot{_k}"] = N[f"prot{_k}"].replace(f"FROM {_old}", "FROM mseffect" if _k == 0 else f"FROM mprot{_k - 1}")
N["mstop"] = "SELECT p.*, f.touched, f.changed, f.effective, f.af, nullif(instr(p.rp, '*'), 0) AS ref_stop, nullif(instr(p.ap, '*'), 0) AS alt_stop FROM mprot4 p JOIN mfirst f ON f.gene_id = p.gene_id AND f.chrom = p.chrom AND f.pos = p.pos AND f.ref = p.ref AND f.alt = p.alt"
N["mlast"] = "SELECT gene_id, max(next0) AS last_junction FROM (SELECT gene_id, strand, seg_start, seg_end, lead(seg_start) OVER w AS s2, lead(seg_end) OVER w AS e2, lead(offset0) OVER w AS next0 FROM moffs WINDOW w AS (PARTITION BY gene_id ORDER BY seg_idx)) WHERE (strand = '+' AND s2 > seg_end + 1) OR (strand = '-' AND e2 < seg_start - 1) GROUP BY gene_id"
N["mnmd"] = "SELECT s.*, (s.alt_stop - 1) * 3 AS stop, length(s.alt_cds) - length(s.ref_cds) AS grown, coalesce((s.ref_stop - 1) * 3, length(s.ref_cds) // 3 * 3) AS own, l.last_junction FROM mstop s LEFT JOIN mlast l ON l.gene_id = s.gene_id"
_codon = lambda c, o: f"CASE WHEN length({c}) >= {o} // 3 * 3 + 3 THEN substr({c}, cast({o} // 3 * 3 + 1 as int), 3) END"
ORACLES["q99_spliced_indel_nmd"] = sql(
    f"SELECT gene_id, cast(chrom as varchar) AS contig, pos, ref, alt, cast(delta as bigint) AS delta, cast(changed as bigint) AS first_changed, change_type, {_codon('ref_cds', 'touched')} AS ref_codon, {_codon('alt_cds', 'touched')} AS alt_codon, cast(alt_stop as bigint) AS alt_stop, "
    "CASE WHEN last_junction IS NOT NULL AND CASE WHEN stop >= changed THEN stop - grown ELSE stop END BETWEEN 0 AND own - 1 THEN CASE WHEN CASE WHEN changed < last_junction THEN last_junction + grown ELSE last_junction END - stop > 50 THEN 'NMD-triggering' ELSE 'NMD-escaping' END END AS nmd FROM mnmd"
)
N["mfs"] = "SELECT gene_id, count(*) AS k, max(CASE WHEN (alt_stop - 1) * 3 - delta >= 0 AND ((alt_stop - 1) * 3 - delta) // 3 + 1 < coalesce(ref_stop, length(ref_cds) // 3 + 1) THEN ((alt_stop - 1) * 3 - delta) // 3 + 1 END) AS ptc FROM mstop WHERE frameshift AND af >= 0.5 GROUP BY gene_id"
N["mcds"] = N["scds"].replace("FROM segments", "FROM models")
N["msnv"] = f"SELECT s.gene_id, s.strand, v.pos, v.ref, v.alt, {_off('v.pos')} AS off FROM snvs v JOIN mseg s ON s.chrom = v.chrom AND v.pos BETWEEN s.seg_start AND s.seg_end"
N["mrow0"] = (
    "SELECT k.gene_id, k.strand, k.codon, x.pos AS p0, x.ref AS f0, x.alt AS a0, y.pos AS p1, y.ref AS f1, y.alt AS a1, z.pos AS p2, z.ref AS f2, z.alt AS a2, substr(c.cds, cast(k.codon * 3 + 1 as int), 3) AS rc FROM (SELECT DISTINCT gene_id, strand, off // 3 AS codon FROM msnv) k JOIN mcds c ON c.gene_id = k.gene_id "
    + " ".join(f"LEFT JOIN msnv {t} ON {t}.gene_id = k.gene_id AND {t}.off = k.codon * 3 + {i}" for i, t in enumerate("xyz"))
    + " WHERE length(c.cds) >= k.codon * 3 + 3"
)
_b = lambda i: f"CASE WHEN strand = '-' THEN translate(a{i}, 'ACGT', 'TGCA') ELSE a{i} END"
_r = lambda i: f"substr(rc, {i + 1}, 1)"
_single = lambda i: f"CASE WHEN a{i} IS NOT NULL THEN " + residue("(" + " || ".join(_b(j) if j == i else _r(j) for j in range(3)) + ")") + " END"
N["mrow1"] = f"SELECT *, {' || '.join(f'coalesce({_b(i)}, {_r(i)})' for i in range(3))} AS ac, {_single(0)} AS q0, {_single(1)} AS q1, {_single(2)} AS q2 FROM mrow0"
_site = lambda i: f"CASE WHEN a{i} IS NOT NULL THEN cast(p{i} as varchar) || f{i} || '>' || a{i} END"
# SNVs of a codon are listed by place on the genome, so from the last on where the strand is minus
N["mrow2"] = f"SELECT *, {residue('rc')} AS ra, {residue('ac')} AS aa, CASE WHEN strand = '-' THEN concat_ws(',', {_site(2)}, {_site(1)}, {_site(0)}) ELSE concat_ws(',', {_site(0)}, {_site(1)}, {_site(2)}) END AS snvs FROM mrow1"
N["mstate"] = "SELECT k.gene_id, k.codon, coalesce(sum(CASE WHEN i.effective < k.codon * 3 AND i.af >= 0.5 THEN i.delta ELSE 0 END), 0) AS shift FROM (SELECT DISTINCT gene_id, codon FROM mrow2) k LEFT JOIN mstop i ON i.gene_id = k.gene_id GROUP BY k.gene_id, k.codon"
N["mrow3"] = (
    f"SELECT r.*, {change('ra', 'aa', 'r.codon + 1')} AS change_type, d.gene_id IS NOT NULL AS over, ((s.shift % 3) + 3) % 3 <> 0 AS off, coalesce(r.codon + 1 > f.ptc, false) AS behind, l.last_junction FROM mrow2 r JOIN mstate s ON s.gene_id = r.gene_id AND s.codon = r.codon LEFT JOIN mdist d ON d.gene_id = r.gene_id AND d.codon = r.codon "
    "LEFT JOIN mfs f ON f.gene_id = r.gene_id AND f.k = 1 LEFT JOIN mlast l ON l.gene_id = r.gene_id"
)
_aa = lambda q: f"{three('ra')} || cast(codon + 1 as varchar) || {three(q)}"
_told = lambda x: f"CASE WHEN over THEN 'Unknown' WHEN off AND behind THEN 'downstream of premature stop' WHEN off THEN {x} || ' (fs)' ELSE {x} END"
_each = lambda i: f"CASE WHEN a{i} IS NOT NULL THEN {_told(_aa(f'q{i}'))} END"
_shifted = "CASE change_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FRAMESHIFTED.items()) + " ELSE change_type END"
ORACLES["q98_spliced_frame_rows"] = sql(
    f"SELECT gene_id, cast(codon as bigint) AS codon, snvs, {_told(_aa('aa'))} AS aa_change, CASE WHEN strand = '-' THEN concat_ws(', ', {_each(2)}, {_each(1)}, {_each(0)}) ELSE concat_ws(', ', {_each(0)}, {_each(1)}, {_each(2)}) END AS local_snp_aa_changes, "
    f"CASE WHEN over THEN 'Indel overlap' WHEN off AND behind THEN 'Downstream of premature stop' WHEN off THEN {_shifted} ELSE change_type END AS change_type, "
    "CASE WHEN NOT over AND NOT off AND change_type = 'Stop gained' AND last_junction IS NOT NULL THEN CASE WHEN codon * 3 + 50 < last_junction THEN 'NMD-triggering' ELSE 'NMD-escaping' END END AS nmd FROM mrow3"
)

# genes of any phase: the translated window is cut from the gene's sequence, the delta is the whole gene's
N["pwin"] = "SELECT i.*, gene_id % 3 AS phase, gene_id % 7 AS poff, CASE WHEN strand = '-' THEN gs ELSE gs + gene_id % 3 END AS ws, CASE WHEN strand = '-' THEN ge - gene_id % 3 ELSE ge END AS we FROM idelta i"
N["pseq"] = "SELECT p.*, substr(g.seq, cast(p.ws - p.gs + 1 as int), cast(p.we - p.ws + 1 as int)) AS win FROM pwin p JOIN gseq g ON g.gene_id = p.gene_id"
N["pnew"] = (
    "SELECT *, CASE WHEN is_del = 1 THEN CASE WHEN pos + 1 > we OR pos + size < ws THEN win ELSE substr(win, 1, cast(greatest(pos + 1, ws) - ws as int)) || substr(win, cast(greatest(pos + size, ws - 1) - ws + 2 as int)) END "
    "WHEN pos >= ws AND pos < we THEN substr(win, 1, cast(pos - ws + 1 as int)) || substr(alt, 2) || substr(win, cast(pos - ws + 2 as int)) ELSE win END AS new, "
    "CASE WHEN is_del = 1 THEN pos + 1 ELSE pos END AS c0, CASE WHEN is_del = 1 THEN pos + size ELSE pos END AS c1, CASE WHEN strand = '-' THEN we + 1 ELSE gs END AS k0, CASE WHEN strand = '-' THEN ge ELSE ws - 1 END AS k1 FROM pseq"
)
_turn = lambda c: f"CASE WHEN strand = '-' THEN {revcomp(c)} ELSE {c} END"
N["peffect"] = f"SELECT *, {_turn('win')} AS ref_cds, {_turn('new')} AS alt_cds, CASE WHEN greatest(c0, ws) <= least(c1, we) THEN CASE WHEN strand = '-' THEN we - least(c1, we) ELSE greatest(c0, ws) - ws END END AS touched, phase > 0 AND CASE WHEN is_del = 1 THEN c0 <= k1 AND c1 >= k0 ELSE pos >= k0 AND pos < k1 END AS hidden FROM pnew"
for _k, _old in enumerate(("effect", "prot0", "prot1", "prot2", "prot3")):
    N[f"pprot{_k}"] = N[f"prot{_k}"].replace(f"FROM {_old}", "FROM peffect" if _k == 0 else f"FROM pprot{_k - 1}")
_says = ORACLES["q30_indel_protein_effect"]
_says = _says[_says.rindex("CASE WHEN change_type = 'Synonymous' OR") : _says.rindex(" AS protein_change FROM prot4")]


def _numbered(offset: str) -> str:
    """The text of q30 with residues numbered from an offset."""
    out = _says
    for place in ("greatest(length(rp), 1)", "pre + length(rm)", "pre + 1", "pre"):
        out = out.replace(f"cast({place} as varchar)", f"cast({offset} + {place.replace('pre', 'PRE')} as varchar)")
    return out.replace("PRE", "pre")


_text = lambda offset: f"CASE WHEN change_type = 'Synonymous' THEN 'Synonymous' WHEN hidden THEN 'Unknown' ELSE {_numbered(offset)} END"
ORACLES["q100_phased_indel_effects"] = sql(
    f"SELECT gene_id, cast(chrom as varchar) AS contig, pos, ref, alt, cast(delta as bigint) AS delta, change_type, {_text('poff')} AS protein_change, {_text('0')} AS local_change, {_codon('ref_cds', 'touched')} AS ref_codon, {_codon('alt_cds', 'touched')} AS alt_codon FROM pprot4"
)
