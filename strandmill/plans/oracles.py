"""SQL that states each query of queries.py over the same tables, for another engine."""

from __future__ import annotations

import re

from strandmill.functions.aa import CANONICAL_DOUBLETS, GRANTHAM, GRANTHAM_WEIGHTS, THREE
from strandmill.functions.consequence import FRAMESHIFTED, SO_TERMS
from strandmill.functions.dna import GENETIC_CODES
from strandmill.plans.fixture import BLOCKS, observed_sql, quality, refbase, relations, shows_alt

R = relations("//")


def base(pos: str, chrom: str = "chrom") -> str:
    return refbase(pos, chrom, "//")


def residue(codon: str, table: int = 11) -> str:
    at = lambda i: f"(instr('TCAG', substr({codon}, {i}, 1)) - 1)"
    return f"substr('{GENETIC_CODES[table]}', cast({at(1)} * 16 + {at(2)} * 4 + {at(3)} + 1 as int), 1)"


def revcomp(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def three(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in THREE.items()) + f" ELSE {x} END"


def change(ref: str, alt: str, pos: str) -> str:
    return f"CASE WHEN {pos} = 1 AND {ref} = 'M' AND {alt} NOT IN ('M', '*') THEN 'Start lost' WHEN {ref} = {alt} THEN 'Synonymous' WHEN {alt} = '*' THEN 'Stop gained' WHEN {ref} = '*' THEN 'Stop lost' ELSE 'Non-synonymous' END"


def severity(ref: str, alt: str) -> str:
    return f"CASE WHEN {ref} = {alt} THEN 1 WHEN {ref} = '*' OR {alt} = '*' THEN 3 ELSE 2 END"


#: Further named relations, in terms of others.
N: dict[str, str] = dict(R)
N["placed"] = (
    "SELECT g.gene_id, g.chrom, g.strand, g.gs, g.ge, v.pos, v.ref, v.alt, g.gs + 3 * ((v.pos - g.gs) // 3) AS low, "
    "CASE WHEN g.strand = '+' THEN (v.pos - g.gs) // 3 + 1 ELSE (g.ge - v.pos) // 3 + 1 END AS aa_pos, CASE WHEN g.strand = '+' THEN v.pos - g.gs + 1 ELSE g.ge - v.pos + 1 END AS cds "
    "FROM genes g JOIN snvs v ON g.chrom = v.chrom AND v.pos BETWEEN g.gs AND g.ge"
)
N["keys"] = "SELECT DISTINCT gene_id, chrom, strand, gs, ge, low, aa_pos FROM placed"
N["combo0"] = (
    f"SELECT k.gene_id, k.chrom, k.strand, k.gs, k.ge, k.low, k.aa_pos, {base('k.low', 'k.chrom')} AS r0, {base('k.low + 1', 'k.chrom')} AS r1, {base('k.low + 2', 'k.chrom')} AS r2, a.alt AS x0, b.alt AS x1, c.alt AS x2 "
    "FROM keys k LEFT JOIN snvs a ON a.chrom = k.chrom AND a.pos = k.low LEFT JOIN snvs b ON b.chrom = k.chrom AND b.pos = k.low + 1 LEFT JOIN snvs c ON c.chrom = k.chrom AND c.pos = k.low + 2"
)
_site = lambda i: f"CASE WHEN x{i} IS NOT NULL THEN cast(low + {i} as varchar) || r{i} || '>' || x{i} END"
_codon = lambda a, b, c: f"CASE WHEN strand = '-' THEN {revcomp(f'{a} || {b} || {c}')} ELSE {a} || {b} || {c} END"
N["combo1"] = (
    f"SELECT *, concat_ws(',', {_site(0)}, {_site(1)}, {_site(2)}) AS snvs, (CASE WHEN x0 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN x1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN x2 IS NULL THEN 0 ELSE 1 END) AS n, "
    f"{_codon('r0', 'r1', 'r2')} AS ref_codon, {_codon('coalesce(x0, r0)', 'coalesce(x1, r1)', 'coalesce(x2, r2)')} AS alt_codon, "
    f"CASE WHEN x0 IS NOT NULL THEN {_codon('x0', 'r1', 'r2')} END AS s0, CASE WHEN x1 IS NOT NULL THEN {_codon('r0', 'x1', 'r2')} END AS s1, CASE WHEN x2 IS NOT NULL THEN {_codon('r0', 'r1', 'x2')} END AS s2 FROM combo0"
)
_aa = lambda c: f"CASE WHEN {c} IS NULL THEN NULL ELSE {residue(c)} END"
N["combo2"] = f"SELECT *, {residue('ref_codon')} AS ref_aa, {residue('alt_codon')} AS alt_aa, {_aa('s0')} AS q0, {_aa('s1')} AS q1, {_aa('s2')} AS q2 FROM combo1"
_snp = lambda i: f"CASE WHEN q{i} IS NOT NULL THEN {three('ref_aa')} || cast(aa_pos as varchar) || {three(f'q{i}')} END"
N["codon"] = (
    f"SELECT *, CASE WHEN n = 1 THEN 'SNP' ELSE 'SNP/MNV' END AS variant_type, {change('ref_aa', 'alt_aa', 'aa_pos')} AS change_type, {three('ref_aa')} || cast(aa_pos as varchar) || {three('alt_aa')} AS aa_change, "
    f"concat_ws(', ', {_snp(0)}, {_snp(1)}, {_snp(2)}) AS snp_aa_changes FROM combo2"
)
N["one"] = "SELECT chrom, pos, ref, min(alt) AS alt FROM snvs GROUP BY chrom, pos, ref"
N["blocks"] = BLOCKS
N["observed"] = observed_sql("//")
N["merged"] = "SELECT chrom, pos, mol, min(base) AS base, max(quality) AS quality, max(CASE WHEN is_rev = 0 THEN 1 ELSE 0 END) AS fwd, max(is_rev) AS rev FROM observed GROUP BY chrom, pos, mol HAVING count(DISTINCT base) = 1"
N["seen"] = "SELECT * FROM merged WHERE quality >= 20"
N["support"] = (
    "SELECT v.chrom, v.pos, v.ref, v.alt, count(CASE WHEN s.base = v.alt THEN 1 END) AS snp_reads, count(CASE WHEN s.base = v.alt AND s.fwd = 1 THEN 1 END) AS snp_forward, count(CASE WHEN s.base = v.alt AND s.rev = 1 THEN 1 END) AS snp_reverse, "
    "count(s.base) AS depth, count(CASE WHEN s.fwd = 1 THEN 1 END) AS depth_forward, count(CASE WHEN s.rev = 1 THEN 1 END) AS depth_reverse FROM one v LEFT JOIN seen s ON s.chrom = v.chrom AND s.pos = v.pos GROUP BY v.chrom, v.pos, v.ref, v.alt"
)
N["placed1"] = "SELECT p.* FROM placed p JOIN one o ON o.chrom = p.chrom AND o.pos = p.pos AND o.alt = p.alt"
N["members"] = "SELECT * FROM (SELECT gene_id, low, chrom, pos, alt, row_number() OVER (PARTITION BY gene_id, low ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY gene_id, low) AS n FROM placed1) WHERE n > 1"
N["pat"] = (
    "SELECT m.gene_id, m.low, m.n, s.mol, count(*) AS k, sum(CASE WHEN s.base = m.alt THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN s.base = m.alt AND s.fwd = 1 THEN 1 ELSE 0 END) AS hf, sum(CASE WHEN s.base = m.alt AND s.rev = 1 THEN 1 ELSE 0 END) AS hr, sum(s.fwd) AS sf, sum(s.rev) AS sr, "
    "string_agg(CASE WHEN s.base = m.alt THEN '1' ELSE '0' END, '' ORDER BY m.idx) AS pattern FROM members m JOIN seen s ON s.chrom = m.chrom AND s.pos = m.pos GROUP BY m.gene_id, m.low, m.n, s.mol"
)
N["counts"] = "SELECT gene_id, low, n, pattern, count(*) AS molecules FROM pat WHERE k = n GROUP BY gene_id, low, n, pattern"
N["iplaced"] = "SELECT g.gene_id, g.chrom, g.strand, g.gs, g.ge, i.pos, i.ref, i.alt, i.is_del, i.size, i.af FROM genes g JOIN indels i ON g.chrom = i.chrom AND ((i.is_del = 1 AND i.pos + 1 <= g.ge AND i.pos + i.size >= g.gs) OR (i.is_del = 0 AND i.pos >= g.gs AND i.pos < g.ge))"
N["idelta"] = "SELECT *, CASE WHEN is_del = 1 THEN -(least(pos + size, ge) - greatest(pos + 1, gs) + 1) ELSE size END AS delta FROM iplaced"
_up = "((i.is_del = 1 AND ((k.strand = '+' AND i.pos + i.size < k.low) OR (k.strand = '-' AND i.pos + 1 > k.low + 2))) OR (i.is_del = 0 AND ((k.strand = '+' AND i.pos < k.low) OR (k.strand = '-' AND i.pos >= k.low + 2))))"
_over = "((i.is_del = 1 AND i.pos + 1 <= k.low + 2 AND i.pos + i.size >= k.low) OR (i.is_del = 0 AND i.pos >= k.low AND i.pos < k.low + 2))"
N["states"] = f"SELECT k.gene_id, k.strand, k.low, coalesce(sum(CASE WHEN {_up} AND i.af >= 0.5 THEN i.delta ELSE 0 END), 0) AS shift, coalesce(max(CASE WHEN {_over} THEN 1 ELSE 0 END), 0) AS over FROM keys k LEFT JOIN idelta i ON i.gene_id = k.gene_id GROUP BY k.gene_id, k.strand, k.low"
N["gseq"] = f"SELECT gene_id, chrom, strand, gs, ge, string_agg({base('p')}, '' ORDER BY p) AS seq FROM (SELECT gene_id, chrom, strand, gs, ge, unnest(generate_series(gs, ge)) AS p FROM genes) GROUP BY gene_id, chrom, strand, gs, ge"
N["offs"] = "SELECT *, coalesce(sum(seg_end - seg_start + 1) OVER (PARTITION BY gene_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset0 FROM segments"
N["introns"] = "SELECT gene_id, chrom, strand, 1 AS intron, gs + 31 AS i_start, gs + 60 AS i_end FROM genes WHERE ge - gs + 1 >= 90"
N["sites"] = "SELECT DISTINCT chrom, pos FROM snvs"
N["toff"] = "SELECT s.gene_id, s.chrom, s.strand, v.pos, v.ref, v.alt, s.seg_idx, s.offset0 + CASE WHEN s.strand = '-' THEN s.seg_end - v.pos ELSE v.pos - s.seg_start END AS off FROM snvs v JOIN offs s ON s.chrom = v.chrom AND v.pos BETWEEN s.seg_start AND s.seg_end"
N["scds"] = f"SELECT gene_id, string_agg(CASE WHEN strand = '-' THEN translate({base('p')}, 'ACGT', 'TGCA') ELSE {base('p')} END, '' ORDER BY seg_idx, CASE WHEN strand = '-' THEN -p ELSE p END) AS cds FROM (SELECT gene_id, chrom, strand, seg_idx, unnest(generate_series(seg_start, seg_end)) AS p FROM segments) GROUP BY gene_id"
N["splice0"] = "SELECT i.gene_id, v.chrom, v.pos, CASE WHEN i.strand = '+' THEN v.pos - i.i_start + 1 ELSE i.i_end - v.pos + 1 END AS d, CASE WHEN i.strand = '+' THEN i.i_end - v.pos + 1 ELSE v.pos - i.i_start + 1 END AS a FROM sites v JOIN introns i ON i.chrom = v.chrom AND v.pos BETWEEN i.i_start - 3 AND i.i_end + 3"
N["splice"] = "SELECT * FROM (SELECT gene_id, chrom, pos, CASE WHEN d BETWEEN 1 AND 2 THEN 'splice_donor_variant' WHEN a BETWEEN 1 AND 2 THEN 'splice_acceptor_variant' WHEN d BETWEEN -2 AND 8 OR a BETWEEN -2 AND 8 THEN 'splice_region_variant' END AS splice FROM splice0) WHERE splice IS NOT NULL"
N["tbase"] = "SELECT DISTINCT gene_id, off // 3 AS codon, off, pos, CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS b FROM toff"
N["junction"] = (
    "SELECT k.gene_id, k.codon, x.b AS y0, y.b AS y1, z.b AS y2, cast((CASE WHEN x.b IS NULL THEN 0 ELSE 1 END) + (CASE WHEN y.b IS NULL THEN 0 ELSE 1 END) + (CASE WHEN z.b IS NULL THEN 0 ELSE 1 END) as int) AS n, greatest(x.pos, y.pos, z.pos) - least(x.pos, y.pos, z.pos) > 2 AS crosses "
    "FROM (SELECT DISTINCT gene_id, codon FROM tbase) k LEFT JOIN tbase x ON x.gene_id = k.gene_id AND x.off = k.codon * 3 LEFT JOIN tbase y ON y.gene_id = k.gene_id AND y.off = k.codon * 3 + 1 LEFT JOIN tbase z ON z.gene_id = k.gene_id AND z.off = k.codon * 3 + 2"
)
N["jcodon"] = "SELECT j.gene_id, j.codon, j.n, j.crosses, substr(c.cds, cast(j.codon * 3 + 1 as int), 3) AS ref_codon, coalesce(j.y0, substr(c.cds, cast(j.codon * 3 + 1 as int), 1)) || coalesce(j.y1, substr(c.cds, cast(j.codon * 3 + 2 as int), 1)) || coalesce(j.y2, substr(c.cds, cast(j.codon * 3 + 3 as int), 1)) AS alt_codon FROM junction j JOIN scds c ON c.gene_id = j.gene_id WHERE length(c.cds) >= j.codon * 3 + 3"
_clear = lambda lo, hi: f"({lo} >= r.start AND {hi} <= r.start + 99 AND (r.shape <> 'N' OR {hi} < r.start + 50 OR {lo} > r.start + 59))"
_q = lambda p: quality("r", p)
N["icov0"] = "SELECT v.chrom, v.pos, v.ref, v.alt, v.is_del, r.read_id, r.frag, r.mol, r.is_rev, r.start, r.shape, CASE WHEN r.shape IN ('D', 'I') AND r.anchor = v.pos THEN 1 ELSE 0 END AS own, o.pos AS snv FROM rindels v JOIN aln r ON r.chrom = v.chrom AND r.start <= v.pos + 1 + 2 * v.is_del AND r.start + 99 >= v.pos LEFT JOIN one o ON o.chrom = v.chrom AND o.pos = v.pos"
N["icov"] = (
    f"SELECT *, CASE WHEN {_clear('pos', 'pos')} AND {_q('pos')} >= 20 THEN 1 ELSE 0 END AS covers, "
    f"CASE WHEN own = 1 THEN CASE WHEN is_del = 1 THEN {_q('pos')} ELSE least({_q('pos')}, 30) END WHEN {_clear('pos', 'pos + 2 * is_del')} THEN CASE WHEN is_del = 1 THEN least({_q('pos')}, {_q('pos + 1')}, {_q('pos + 2')}) ELSE {_q('pos')} END ELSE -1 END AS qual, "
    f"CASE WHEN own = 1 THEN CASE WHEN is_del = 1 THEN least({_q('pos')}, {_q('pos + 3')}) ELSE least({_q('pos')}, 30, {_q('pos + 1')}) END WHEN {_clear('pos', 'pos + 1 + 2 * is_del')} THEN CASE WHEN is_del = 1 THEN least({_q('pos')}, {_q('pos + 1')}, {_q('pos + 2')}, {_q('pos + 3')}) ELSE least({_q('pos')}, {_q('pos + 1')}) END ELSE -1 END AS wqual, "
    f"CASE WHEN own = 1 AND (snv IS NULL OR NOT {shows_alt('r', 'pos')}) THEN 1 ELSE 0 END AS shows FROM icov0 r"
)
_sup = "qual >= 20 AND shows = 1"
N["ispan"] = f"SELECT chrom, pos, ref, alt, mol, max(CASE WHEN {_sup} THEN 1 ELSE 0 END) AS s, max(CASE WHEN qual >= 20 AND wqual >= 0 AND shows = 0 THEN 1 ELSE 0 END) AS against, max(covers) AS c, max(CASE WHEN {_sup} AND is_rev = 0 THEN 1 ELSE 0 END) AS f, max(CASE WHEN {_sup} AND is_rev = 1 THEN 1 ELSE 0 END) AS r FROM icov GROUP BY chrom, pos, ref, alt, mol"
N["rplaced"] = "SELECT g.gene_id, g.chrom, g.strand, g.gs, g.ge, i.pos, i.ref, i.alt, i.is_del FROM genes g JOIN rindels i ON g.chrom = i.chrom AND i.pos >= g.gs AND i.pos < g.ge"
N["lpairs"] = "SELECT i.gene_id, i.chrom, i.pos AS ipos, i.ref AS iref, i.alt AS ialt, p.pos AS spos, p.ref AS sref, p.alt AS salt FROM rplaced i JOIN placed1 p ON p.gene_id = i.gene_id WHERE abs(i.pos - p.pos) <= 600"
N["lcarry"] = "SELECT o.chrom, o.pos, s.mol FROM one o JOIN observed s ON s.chrom = o.chrom AND s.pos = o.pos WHERE s.quality >= 20 GROUP BY o.chrom, o.pos, s.mol HAVING min(CASE WHEN s.base = o.alt THEN 1 ELSE 0 END) = 1"
N["lshow"] = "SELECT chrom, pos, mol, max(shows) AS sup FROM icov WHERE qual >= 20 AND wqual >= 0 GROUP BY chrom, pos, mol HAVING min(shows) = max(shows)"
N["hin0"] = (
    "SELECT gene_id, chrom, pos, ref, alt, pos AS a, pos AS b, 0 AS is_indel, cast(pos as varchar) || ':' || ref || ':' || alt AS variant_id, gs, ge FROM placed1 UNION ALL "
    "SELECT gene_id, chrom, pos, ref, alt, CASE WHEN is_del = 1 THEN pos + 1 ELSE pos END, CASE WHEN is_del = 1 THEN pos + 2 ELSE pos END, 1, cast(pos as varchar) || ':' || ref || ':' || alt, gs, ge FROM rplaced"
)
N["effect0"] = "SELECT i.*, CASE WHEN g.strand = '-' THEN reverse(translate(g.seq, 'ACGT', 'TGCA')) ELSE g.seq END AS ref_cds, CASE WHEN i.is_del = 1 THEN substr(g.seq, 1, cast(greatest(i.pos + 1, g.gs) - g.gs as int)) || substr(g.seq, cast(i.pos + i.size + 1 - g.gs + 1 as int)) ELSE substr(g.seq, 1, cast(i.pos - g.gs + 1 as int)) || substr(i.alt, 2) || substr(g.seq, cast(i.pos - g.gs + 2 as int)) END AS alt_seq FROM idelta i JOIN gseq g ON g.gene_id = i.gene_id"
N["effect"] = "SELECT *, CASE WHEN strand = '-' THEN reverse(translate(alt_seq, 'ACGT', 'TGCA')) ELSE alt_seq END AS alt_cds FROM effect0"
N["win0"] = (
    "SELECT gene_id, pos, pos AS a, pos AS b, 0 AS is_indel, cast(pos as varchar) || ':' || ref || ':' || alt AS variant_id, gs, ge FROM placed1 UNION ALL "
    "SELECT gene_id, pos, CASE WHEN is_del = 1 THEN pos + 1 ELSE pos END, CASE WHEN is_del = 1 THEN pos + size ELSE pos END, 1, cast(pos as varchar) || ':' || ref || ':' || alt, gs, ge FROM iplaced"
)
_in = lambda p: f"({p} BETWEEN gs AND ge)"
_lo = lambda p: f"CASE WHEN {_in(p)} THEN gs + ({p} - gs) // 3 * 3 END"
_hi = lambda p: f"CASE WHEN {_in(p)} THEN gs + ({p} - gs) // 3 * 3 + 2 END"
_none = f"NOT ({_in('pos')} OR {_in('a')} OR {_in('b')})"
N["win1"] = f"SELECT *, least(greatest(a, gs), {_lo('pos')}, {_lo('a')}, {_lo('b')}, CASE WHEN {_none} THEN greatest(a - 2, gs) END) AS w_start, greatest(least(b, ge), {_hi('pos')}, {_hi('a')}, {_hi('b')}, CASE WHEN {_none} THEN least(b + 2, ge) END) AS w_end FROM win0"
N["hin1"] = N["win1"].replace("FROM win0", "FROM hin0")
N["win2"] = "SELECT *, max(w_end) OVER (PARTITION BY gene_id ORDER BY w_start, w_end, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM win1"
N["win3"] = "SELECT *, sum(CASE WHEN reach IS NULL OR w_start > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id ORDER BY w_start, w_end, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM win2"

N["hin2"], N["hin3"] = N["win2"].replace("win1", "hin1"), N["win3"].replace("win2", "hin2")
N["hin4"] = "SELECT *, count(*) OVER w AS n, max(is_indel) OVER w AS any_indel, row_number() OVER (PARTITION BY gene_id, island ORDER BY pos, is_indel, ref, alt) - 1 AS idx FROM hin3 WINDOW w AS (PARTITION BY gene_id, island)"
N["hmem"] = "SELECT * FROM hin4 WHERE n >= 2 AND any_indel = 1"
N["hrec"] = (
    "SELECT m.gene_id, m.island, m.idx, m.n, s.mol, s.read_id, s.is_rev, CASE WHEN s.base = m.alt THEN 1 ELSE 0 END AS carries FROM hmem m JOIN observed s ON m.is_indel = 0 AND s.chrom = m.chrom AND s.pos = m.pos AND s.quality >= 20 "
    "UNION ALL SELECT m.gene_id, m.island, m.idx, m.n, c.mol, c.read_id, c.is_rev, c.own FROM hmem m JOIN icov c ON m.is_indel = 1 AND c.chrom = m.chrom AND c.pos = m.pos AND c.wqual >= 20"
)
N["hfull"] = "SELECT gene_id, island, mol, max(CASE WHEN is_rev = 0 THEN 1 ELSE 0 END) AS f, max(is_rev) AS r FROM (SELECT gene_id, island, mol, read_id, is_rev FROM hrec GROUP BY gene_id, island, n, mol, read_id, is_rev HAVING count(*) = n) GROUP BY gene_id, island, mol"
N["hidx"] = "SELECT gene_id, island, n, mol, idx, min(carries) AS lo, max(carries) AS hi FROM hrec GROUP BY gene_id, island, n, mol, idx"
N["hmol"] = "SELECT gene_id, island, n, mol, string_agg(cast(hi as varchar), '' ORDER BY idx) AS pattern FROM hidx GROUP BY gene_id, island, n, mol HAVING count(*) = n AND sum(hi - lo) = 0"
N["hpat"] = "SELECT h.gene_id, h.island, h.n, h.pattern, count(*) AS molecules, count(CASE WHEN f.f = 1 THEN 1 END) AS forward, count(CASE WHEN f.r = 1 THEN 1 END) AS reverse FROM hmol h LEFT JOIN hfull f ON f.gene_id = h.gene_id AND f.island = h.island AND f.mol = h.mol GROUP BY h.gene_id, h.island, h.n, h.pattern"


def _needs(text: str, done: list[str]) -> None:
    for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_]+[0-9]?)\b", text):
        if name in N and name not in done:
            _needs(N[name], done)
            if name not in done:
                done.append(name)


#: Relations that several others read: evaluated once.
WRITTEN = {"combo2", "msnv", "mstop", "mtouch"}


def sql(body: str) -> str:
    """body with the relations it needs before it."""
    done: list[str] = []
    _needs(body, done)
    return ("WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in WRITTEN else ''}({N[n]})" for n in done) + "\n" if done else "") + body


C = "cast(chrom as varchar) AS contig"
_pair = lambda i, j: f"SELECT gene_id, low, {i} AS i, {j} AS j, sum(CASE WHEN substr(pattern, {i}, 1) = '1' AND substr(pattern, {j}, 1) = '1' THEN molecules ELSE 0 END) AS a, sum(CASE WHEN substr(pattern, {i}, 1) = '1' AND substr(pattern, {j}, 1) = '0' THEN molecules ELSE 0 END) AS b, sum(CASE WHEN substr(pattern, {i}, 1) = '0' AND substr(pattern, {j}, 1) = '1' THEN molecules ELSE 0 END) AS c, sum(CASE WHEN substr(pattern, {i}, 1) = '0' AND substr(pattern, {j}, 1) = '0' THEN molecules ELSE 0 END) AS d FROM counts WHERE n >= {j} GROUP BY gene_id, low"
N["pairs"] = " UNION ALL ".join(_pair(i, j) for i, j in ((1, 2), (1, 3), (2, 3)))
N["ld0"] = "SELECT *, (a + b + c + d)::double AS t, (a + b) / (a + b + c + d)::double AS p, (a + c) / (a + b + c + d)::double AS q FROM pairs"
N["ld1"] = "SELECT *, a / t - p * q AS dis FROM ld0 WHERE t > 0 AND p * (1 - p) > 0 AND q * (1 - q) > 0"
N["ld2"] = "SELECT *, CASE WHEN dis >= 0 THEN least(p * (1 - q), (1 - p) * q) ELSE least(p * q, (1 - p) * (1 - q)) END AS top FROM ld1"
N["ld3"] = "SELECT gene_id, low, i, j, greatest(-1.0, least(1.0, dis / top)) AS d_prime, greatest(0.0, least(1.0, dis * dis / (p * (1 - p) * q * (1 - q)))) AS r_squared, t, a, b, c, d FROM ld2 WHERE top > 0"
_so = "CASE change_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in SO_TERMS.items()) + " END"
_im = "CASE change_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in SO_TERMS.items()) + " END"
N["soed"] = f"SELECT *, {_so} AS so_term, {_im} AS impact FROM codon"
N["prop"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {c}::double, {p}::double, {v}::double)" for k, (c, p, v) in GRANTHAM.items()) + ") t(aa, c, p, v)"
_al, _be, _ga, _rho = GRANTHAM_WEIGHTS
N["grant"] = f"SELECT k.*, cast(round({_rho} * sqrt({_al} * (a.c - b.c) * (a.c - b.c) + {_be} * (a.p - b.p) * (a.p - b.p) + {_ga} * (a.v - b.v) * (a.v - b.v))) as int) AS grantham FROM codon k LEFT JOIN prop a ON a.aa = k.ref_aa AND k.change_type = 'Non-synonymous' LEFT JOIN prop b ON b.aa = k.alt_aa AND k.change_type = 'Non-synonymous'"
N["doub"] = "SELECT *, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NULL THEN r0 || r1 WHEN x1 IS NOT NULL AND x2 IS NOT NULL AND x0 IS NULL THEN r1 || r2 END AS rd, CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NULL THEN x0 || x1 WHEN x1 IS NOT NULL AND x2 IS NOT NULL AND x0 IS NULL THEN x1 || x2 END AS ad FROM codon"
_canon = ", ".join(f"'{d}'" for d in CANONICAL_DOUBLETS)
_dbs = f"CASE WHEN rd IN ({_canon}) THEN rd || '>' || CASE WHEN {revcomp('rd')} = rd THEN least(ad, {revcomp('ad')}) ELSE ad END ELSE {revcomp('rd')} || '>' || {revcomp('ad')} END"
N["dbs"] = f"SELECT *, CASE WHEN rd IS NOT NULL THEN {_dbs} END AS dbs_class FROM doub"
_cb = lambda x: f"CASE WHEN strand = '-' THEN translate({x}, 'ACGT', 'TGCA') ELSE {x} END"
_cp = lambda i: f"(CASE WHEN strand = '+' THEN low + {i} - gs + 1 ELSE ge - low - {i} + 1 END)"
_g = lambda i: f"CASE WHEN x{i} IS NOT NULL THEN cast(low + {i} as varchar) || r{i} || '>' || x{i} END"
_c = lambda i: f"CASE WHEN x{i} IS NOT NULL THEN cast({_cp(i)} as varchar) || {_cb(f'r{i}')} || '>' || {_cb(f'x{i}')} END"
_gs = f"concat_ws(';', {_g(0)}, {_g(1)}, {_g(2)})"
_cs = f"CASE WHEN strand = '+' THEN concat_ws(';', {_c(0)}, {_c(1)}, {_c(2)}) ELSE concat_ws(';', {_c(2)}, {_c(1)}, {_c(0)}) END"
N["hgvs"] = f"SELECT *, CASE WHEN n = 1 THEN 'g.' || {_gs} ELSE 'g.[' || {_gs} || ']' END AS hgvs_g, CASE WHEN n = 1 THEN 'c.' || {_cs} ELSE 'c.[' || {_cs} || ']' END AS hgvs_c FROM dbs"
N["prot"] = f"SELECT gene_id, string_agg({residue('substr(cds, cast(i * 3 - 2 as int), 3)')}, '' ORDER BY i) AS protein FROM (SELECT gene_id, cds, unnest(generate_series(1, length(cds) // 3)) AS i FROM scds) GROUP BY gene_id"
N["gcds"] = f"SELECT gene_id, strand, CASE WHEN strand = '-' THEN {revcomp('seq')} ELSE seq END AS cds FROM gseq"
N["gprot"] = f"SELECT gene_id, string_agg({residue('substr(cds, cast(i * 3 - 2 as int), 3)')}, '' ORDER BY i) AS protein FROM (SELECT gene_id, cds, unnest(generate_series(1, length(cds) // 3)) AS i FROM gcds) GROUP BY gene_id"
_relabel = "CASE WHEN s.over = 1 THEN 'Indel overlap' WHEN ((s.shift % 3) + 3) % 3 <> 0 THEN CASE k.change_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FRAMESHIFTED.items()) + " ELSE k.change_type END ELSE k.change_type END"
_label = "CASE WHEN is_del = 1 THEN 'DEL:' || cast(pos + 1 as varchar) || CASE WHEN size > 1 THEN '-' || cast(pos + size as varchar) ELSE '' END || ':' || substr(ref, 2) ELSE 'INS:' || cast(pos as varchar) || ':+' || substr(alt, 2) END"
N["chgpos"] = "SELECT chrom, pos, ref, alt, unnest(CASE WHEN is_del = 1 THEN generate_series(pos + 1, pos + size) ELSE generate_series(pos, pos) END) AS p FROM indels"
N["recs"] = "SELECT chrom, pos, ref, string_agg(alt, ',' ORDER BY alt) AS alts, string_agg(cast(odp as varchar), ',' ORDER BY alt) AS ad, sum(odp) AS total FROM snvs GROUP BY chrom, pos, ref"
N["phase0"] = "SELECT gene_id, low, idx, pos % 4 AS k FROM members"
N["phase1"] = "SELECT gene_id, low, min(k) AS lo, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS second, max(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS first FROM phase0 GROUP BY gene_id, low"
N["solo"] = "SELECT m.gene_id, m.low, m.idx, count(p.mol) AS solo FROM members m LEFT JOIN (SELECT gene_id, low, mol, unnest(generate_series(0, n - 1)) AS idx, pattern FROM pat WHERE k = n AND hits < n) p ON p.gene_id = m.gene_id AND p.low = m.low AND p.idx = m.idx AND substr(p.pattern, cast(p.idx + 1 as int), 1) = '1' GROUP BY m.gene_id, m.low, m.idx"
N["mnv"] = "SELECT gene_id, low, sum(CASE WHEN hits = n THEN 1 ELSE 0 END) AS mr FROM pat GROUP BY gene_id, low"
N["phas"] = "SELECT s.gene_id, s.low, coalesce(max(m.mr), 0) AS mr, min(s.solo) AS least_solo FROM solo s LEFT JOIN mnv m ON m.gene_id = s.gene_id AND m.low = s.low GROUP BY s.gene_id, s.low"
N["outside"] = "SELECT v.chrom, v.pos, v.ref, v.alt FROM snvs v WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.chrom = v.chrom AND v.pos BETWEEN g.gs AND g.ge)"
N["allrows"] = "SELECT chrom, variant_type, 1 AS inside FROM codon UNION ALL SELECT chrom, 'SNP', 0 FROM outside"
N["claim"] = "SELECT v.chrom, v.pos, g.gene_id, 'coding_sequence_variant' AS term, 3 AS pr FROM sites v JOIN genes g ON g.chrom = v.chrom AND v.pos BETWEEN g.gs AND g.ge UNION ALL SELECT chrom, pos, gene_id, splice, 1 FROM splice UNION ALL SELECT v.chrom, v.pos, i.gene_id, 'intron_variant', 2 FROM sites v JOIN introns i ON i.chrom = v.chrom AND v.pos BETWEEN i.i_start AND i.i_end"
N["claimed"] = "SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY pr, gene_id) AS rn FROM claim"
N["tables"] = " UNION ALL ".join(f"SELECT {t} AS table_id, codon, {residue('codon', t)} AS aa FROM codes" for t in GENETIC_CODES)
N["codes"] = "SELECT substr('TCAG', cast(i // 16 % 4 + 1 as int), 1) || substr('TCAG', cast(i // 4 % 4 + 1 as int), 1) || substr('TCAG', cast(i % 4 + 1 as int), 1) AS codon FROM (SELECT unnest(generate_series(0, 63)) AS i)"

_lf = lambda x: f"lgamma({x} + 1)"
_prob = lambda k: f"exp({_lf('r1')} - {_lf(k)} - {_lf(f'r1 - {k}')} + {_lf('r2')} - {_lf(f'c1 - {k}')} - {_lf(f'r2 - c1 + {k}')} - {_lf('n')} + {_lf('c1')} + {_lf('n - c1')})"
N["fish0"] = "SELECT chrom, pos, alt, snp_forward AS a, snp_forward + snp_reverse AS r1, depth_forward - snp_forward + depth_reverse - snp_reverse AS r2, depth_forward AS c1, depth_forward + depth_reverse AS n FROM support WHERE depth > 0"
N["fish1"] = "SELECT *, unnest(generate_series(greatest(c1 - r2, 0), least(r1, c1))) AS k FROM fish0"
N["fish2"] = f"SELECT chrom, pos, alt, {_prob('k')} AS pk, {_prob('a')} AS pa FROM fish1"



def fisher(src: str, keys: str, a: str, b: str, c: str, d: str) -> str:
    """SELECT of keys and p, the two-tailed p of each row's table in src."""
    f0 = f"SELECT {keys}, {a} AS a, {a} + {b} AS r1, {c} + {d} AS r2, {a} + {c} AS c1, {a} + {b} + {c} + {d} AS n FROM {src}"
    f1 = f"SELECT *, unnest(generate_series(cast(greatest(c1 - r2, 0) as bigint), cast(least(r1, c1) as bigint))) AS k FROM ({f0})"
    f2 = f"SELECT {keys}, {_prob('k')} AS pk, {_prob('a')} AS pa FROM ({f1})"
    return f"SELECT {keys}, round(least(1.0, sum(CASE WHEN pk <= pa * (1 + 1e-7) THEN pk ELSE 0 END)), 6) AS p FROM ({f2}) GROUP BY {keys}"


ORACLES: dict[str, str] = {
    "q01_reference_lookup": sql(f"SELECT DISTINCT {C}, pos, ref, {base('pos')} || CASE WHEN pos + 1 <= clen THEN {base('pos + 1')} ELSE '' END || CASE WHEN pos + 2 <= clen THEN {base('pos + 2')} ELSE '' END AS next3, {base('pos')} = ref AS agrees FROM snvs, dims"),
    "q02_revcomp_translate_genes": sql("SELECT c.gene_id, c.strand, c.cds, p.protein FROM gcds c JOIN gprot p ON p.gene_id = c.gene_id"),
    "q03_variant_gene_interval_join": sql(f"SELECT gene_id, {C}, pos, ref, alt FROM placed"),
    "q04_gene_semi_join": sql("SELECT g.gene_id, cast(g.chrom as varchar) AS contig, g.gs AS start, g.ge AS end, g.strand FROM genes g WHERE EXISTS (SELECT 1 FROM snvs v WHERE v.chrom = g.chrom AND v.pos BETWEEN g.gs AND g.ge)"),
    "q05_intergenic_anti_join": sql(f"SELECT {C}, pos, ref, alt FROM outside"),
    "q06_decompose_alleles": sql(f"SELECT {C}, pos, ref, alt, CASE WHEN is_del = 1 THEN 'deletion' ELSE 'insertion' END AS event_class, {_label} AS components, CASE WHEN is_del = 1 THEN pos + 1 ELSE pos END AS affected_start, CASE WHEN is_del = 1 THEN pos + size ELSE pos END AS affected_end, cast(length(ref) + 1 as bigint) AS span FROM indels"),
    "q07_changed_positions": sql(f"SELECT {C}, pos, ref, alt, string_agg(cast(p as varchar), ',' ORDER BY p) AS positions FROM chgpos GROUP BY chrom, pos, ref, alt"),
    "q08_drop_reference_calls": sql(f"SELECT {C}, pos, ref, alt, 'snp' AS event_class FROM snvs WHERE pos % 3 <> 0"),
    "q09_multiallelic_split": sql(f"SELECT v.chrom::varchar AS contig, v.pos, v.ref, v.alt, cast(row_number() OVER (PARTITION BY v.chrom, v.pos, v.ref ORDER BY v.alt) as int) AS alt_index, cast(v.odp as bigint) AS ad, round(v.odp / r.total::double, 6) AS af FROM snvs v JOIN recs r ON r.chrom = v.chrom AND r.pos = v.pos AND r.ref = v.ref"),
    "q10_codon_bounds": sql("SELECT gene_id, pos, alt, low AS codon_start, aa_pos AS aa_local, cds AS cds_local FROM placed"),
    "q11_codon_groups": sql("SELECT gene_id, low AS codon_start, cast(count(*) as int) AS n_sites, string_agg(cast(pos as varchar) || ref || '>' || alts, ',' ORDER BY pos) AS sites FROM (SELECT gene_id, low, pos, ref, string_agg(alt, '/' ORDER BY alt) AS alts FROM placed GROUP BY gene_id, low, pos, ref) GROUP BY gene_id, low"),
    "q12_codon_alternatives": sql("SELECT gene_id, low AS codon_start, snvs FROM combo1"),
    "q13_codon_mnv": sql(f"SELECT gene_id, {C}, strand, low AS codon_start, snvs, variant_type, ref_codon, alt_codon, ref_aa, alt_aa, aa_pos, aa_change, snp_aa_changes, change_type FROM codon"),
    "q14_change_type": sql(f"SELECT {C}, variant_type, change_type, count(*) AS n FROM codon GROUP BY chrom, variant_type, change_type"),
    "q15_consequence_shift": sql(f"SELECT gene_id, low AS codon_start, snvs, concat_ws('', q0, q1, q2) AS single_aas, alt_aa, CASE WHEN {severity('ref_aa', 'alt_aa')} > greatest(coalesce({'CASE WHEN q0 IS NULL THEN NULL ELSE ' + severity('ref_aa', 'q0') + ' END'}, 0), coalesce({'CASE WHEN q1 IS NULL THEN NULL ELSE ' + severity('ref_aa', 'q1') + ' END'}, 0), coalesce({'CASE WHEN q2 IS NULL THEN NULL ELSE ' + severity('ref_aa', 'q2') + ' END'}, 0)) THEN 'MNV-gained' WHEN {severity('ref_aa', 'alt_aa')} < greatest(coalesce({'CASE WHEN q0 IS NULL THEN NULL ELSE ' + severity('ref_aa', 'q0') + ' END'}, 0), coalesce({'CASE WHEN q1 IS NULL THEN NULL ELSE ' + severity('ref_aa', 'q1') + ' END'}, 0), coalesce({'CASE WHEN q2 IS NULL THEN NULL ELSE ' + severity('ref_aa', 'q2') + ' END'}, 0)) THEN 'MNV-masked' ELSE 'Concordant' END AS shift FROM codon WHERE n > 1"),
    "q16_grantham": sql("SELECT gene_id, low AS codon_start, snvs, ref_aa, alt_aa, grantham, CASE WHEN grantham <= 50 THEN 'conservative' WHEN grantham <= 100 THEN 'moderately conservative' WHEN grantham <= 150 THEN 'moderately radical' ELSE 'radical' END AS category FROM grant WHERE grantham IS NOT NULL"),
    "q17_dbs_class": sql("SELECT gene_id, low AS codon_start, snvs, dbs_class FROM dbs WHERE dbs_class IS NOT NULL"),
    "q18_hgvs": sql("SELECT gene_id, low AS codon_start, snvs, hgvs_g, hgvs_c FROM hgvs"),
    "q19_so_impact_summary": sql("SELECT cast(chrom as varchar) AS contig, impact, so_term, count(*) AS n FROM soed GROUP BY ROLLUP (chrom, impact, so_term)"),
    "q20_translation_tables": sql("SELECT cast(t.table_id as int) AS table_id, t.codon, t.aa, c.n FROM tables t JOIN (SELECT substr(cds, cast(i * 3 - 2 as int), 3) AS codon, count(*) AS n FROM (SELECT cds, unnest(generate_series(1, length(cds) // 3)) AS i FROM gcds) GROUP BY 1) c ON c.codon = t.codon"),
    "q21_transcript_offsets": sql("SELECT s.gene_id, cast(s.chrom as varchar) AS contig, v.pos, cast(s.seg_idx as int) AS seg_idx, cast(s.offset0 + CASE WHEN s.strand = '-' THEN s.seg_end - v.pos ELSE v.pos - s.seg_start END as bigint) AS \"offset\" FROM sites v JOIN offs s ON s.chrom = v.chrom AND v.pos BETWEEN s.seg_start AND s.seg_end"),
    "q22_introns": sql(f"SELECT gene_id, {C}, cast(intron as int) AS intron, i_start AS start, i_end AS end FROM introns"),
    "q23_splice_class": sql(f"SELECT gene_id, {C}, pos, splice FROM splice"),
    "q24_spliced_cds": sql("SELECT c.gene_id, c.cds, p.protein FROM scds c JOIN prot p ON p.gene_id = c.gene_id"),
    "q25_junction_codon_mnv": sql(f"SELECT gene_id, cast(codon as bigint) AS codon, cast(n as int) AS n_sites, ref_codon, alt_codon, {residue('ref_codon')} AS ref_aa, {residue('alt_codon')} AS alt_aa, crosses FROM jcodon"),
    "q26_protein_offset": sql("SELECT gene_id, cast(seg_idx as int) AS seg_idx, seg_start AS start, seg_end AS end, cast(offset0 as bigint) AS offset0, cast((offset0 + gene_id % 3) // 3 as bigint) AS protein_offset FROM offs"),
    "q27_indel_coding_delta": sql(f"SELECT gene_id, {C}, pos, ref, alt, cast(delta as bigint) AS delta FROM idelta"),
    "q28_frameshift_propagation": sql("SELECT gene_id, low AS codon_start, cast(shift as bigint) AS shift, ((shift % 3) + 3) % 3 <> 0 AS frameshift FROM states"),
    "q29_indel_overlap_flag": sql(f"SELECT k.gene_id, k.low AS codon_start, k.snvs, s.over = 1 AS overlap, {_relabel} AS change_type FROM codon k JOIN states s ON s.gene_id = k.gene_id AND s.low = k.low"),
    "q33_fallback_class": sql("SELECT cast(v.chrom as varchar) AS contig, v.pos, c.gene_id, coalesce(c.term, 'intergenic_variant') AS term FROM sites v LEFT JOIN claimed c ON c.chrom = v.chrom AND c.pos = v.pos AND c.rn = 1"),
    "q34_read_observations": sql("SELECT cast(o.chrom as varchar) AS contig, o.pos, o.read_id, o.is_rev = 1 AS is_reverse, o.base, o.quality FROM observed o WHERE o.mapq >= 10"),
    "q35_molecule_merge": sql(f"SELECT {C}, pos, mol AS molecule, base, quality, fwd = 1 AS fwd, rev = 1 AS rev FROM merged"),
    "q36_snp_support": sql(f"SELECT {C}, pos, ref, alt, snp_reads, snp_forward, snp_reverse, depth, depth_forward, depth_reverse FROM support"),
    "q37_mnv_support": sql("SELECT gene_id, low AS codon_start, sum(CASE WHEN hits = n THEN 1 ELSE 0 END)::bigint AS mnv_reads, sum(CASE WHEN hf = n THEN 1 ELSE 0 END)::bigint AS mnv_forward, sum(CASE WHEN hr = n THEN 1 ELSE 0 END)::bigint AS mnv_reverse, sum(CASE WHEN k = n THEN 1 ELSE 0 END)::bigint AS mnv_depth FROM pat GROUP BY gene_id, low"),
    "q38_haplotype_patterns": sql("SELECT gene_id, low AS codon_start, pattern, molecules FROM counts"),
    "q39_phasing_support": sql("SELECT gene_id, low AS codon_start, cast(mr as bigint) AS mnv_reads, cast(mr + least_solo as bigint) AS informative, CASE WHEN mr + least_solo > 0 THEN round(mr / (mr + least_solo)::double, 6) END AS phasing_support FROM phas"),
    "q40_codon_ld": sql("SELECT gene_id, low AS codon_start, round(d_prime, 6) AS d_prime, round(r_squared, 6) AS r_squared, cast(t as bigint) AS molecules FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, low ORDER BY d_prime, i, j) AS rn FROM ld3) WHERE rn = 1"),
    "q41_strand_bias_fisher": sql(f"SELECT {C}, pos, alt, round(least(1.0, sum(CASE WHEN pk <= pa * (1 + 1e-7) THEN pk ELSE 0 END)), 6) AS p FROM fish2 GROUP BY chrom, pos, alt"),
    "q42_indel_support": sql(f"SELECT {C}, pos, ref, alt, count(CASE WHEN s = 1 AND against = 0 THEN 1 END) AS event_reads, count(CASE WHEN s = 1 AND against = 0 AND f = 1 THEN 1 END) AS event_forward, count(CASE WHEN s = 1 AND against = 0 AND r = 1 THEN 1 END) AS event_reverse, cast(sum(c) as bigint) AS event_depth, CASE WHEN sum(c) > 0 THEN round(count(CASE WHEN s = 1 AND against = 0 THEN 1 END) / sum(c)::double, 6) END AS event_freq FROM ispan GROUP BY chrom, pos, ref, alt"),
    "q43_indel_snv_linkage": sql("SELECT gene_id, indel_id, snv_id, informative, cis, CASE WHEN informative < 2 THEN 'unknown' WHEN cis <= 0.1 * informative THEN 'trans' ELSE 'cis' END AS verdict FROM (SELECT p.gene_id, concat_ws(':', p.chrom, p.ipos, p.iref, p.ialt) AS indel_id, concat_ws(':', p.chrom, p.spos, p.sref, p.salt) AS snv_id, count(l.mol) AS informative, count(CASE WHEN l.sup = 1 THEN 1 END) AS cis FROM lpairs p LEFT JOIN (SELECT c.chrom, c.pos AS spos, s.pos AS ipos, c.mol, s.sup FROM lcarry c JOIN lshow s ON s.chrom = c.chrom AND s.mol = c.mol) l ON l.chrom = p.chrom AND l.spos = p.spos AND l.ipos = p.ipos GROUP BY ALL)"),
    "q44_haplotype_windows": sql("SELECT gene_id, lo AS window_start, hi AS window_end, members, variant_id FROM (SELECT gene_id, variant_id, min(w_start) OVER w AS lo, max(w_end) OVER w AS hi, count(*) OVER w AS members, max(is_indel) OVER w AS any_indel FROM win3 WINDOW w AS (PARTITION BY gene_id, island)) WHERE members >= 2 AND any_indel = 1"),
    "q45_local_haplotypes_topk": sql("SELECT * EXCLUDE (n) FROM (SELECT *, cast(row_number() OVER (PARTITION BY gene_id, island ORDER BY molecules DESC, pattern) as int) AS place FROM (SELECT gene_id, cast(island as bigint) AS island, n, pattern, molecules, forward, reverse FROM hpat)) WHERE place <= 64"),
    "q46_support_filters": sql(f"SELECT {C}, pos, alt, snp_reads, depth, round(snp_reads / depth::double, 6) AS freq FROM support WHERE depth > 0 AND snp_reads >= 1 AND snp_reads / depth::double >= 0.3"),
    "q47_vcf_filter_tags": sql(f"SELECT {C}, pos, alt, coalesce(nullif(concat_ws(';', CASE WHEN snp_reads < 2 THEN 'LowSupport' END, CASE WHEN CASE WHEN depth > 0 THEN snp_reads / depth::double ELSE 0 END < 0.3 THEN 'LowFrequency' END, CASE WHEN snp_forward < 1 OR snp_reverse < 1 THEN 'StrandSupport' END), ''), 'PASS') AS filter FROM support"),
    "q48_declared_phase": sql("SELECT gene_id, low AS codon_start, CASE WHEN lo = 0 THEN NULL WHEN first = 1 AND second = 1 THEN 'trans:7' ELSE 'cis:7' END AS declared FROM phase1"),
    "q49_vcf_records": sql(f"SELECT gene_id, {C}, low + 0 AS pos, r0 AS ref, x0 AS alt, 'SNP' AS type FROM codon WHERE x0 IS NOT NULL UNION ALL SELECT gene_id, {C}, low + 1, r1, x1, 'SNP' FROM codon WHERE x1 IS NOT NULL UNION ALL SELECT gene_id, {C}, low + 2, r2, x2, 'SNP' FROM codon WHERE x2 IS NOT NULL UNION ALL SELECT gene_id, {C}, low + CASE WHEN x0 IS NULL THEN 1 ELSE 0 END, CASE WHEN x0 IS NULL THEN '' ELSE r0 END || r1 || CASE WHEN x2 IS NULL THEN '' ELSE r2 END, CASE WHEN x0 IS NULL THEN '' ELSE x0 END || coalesce(x1, r1) || CASE WHEN x2 IS NULL THEN '' ELSE x2 END, 'MNV' FROM codon WHERE n > 1"),
    "q51_cohort_carriage": sql(f"SELECT 'sample' || cast(s as varchar) AS sample, {C}, count(*) AS n FROM (SELECT chrom, pos, unnest(generate_series(0, 2)) AS s FROM snvs) WHERE (pos + s) % 4 <> 0 GROUP BY s, chrom"),
    "q52_contig_and_global_summary": sql("SELECT cast(chrom as varchar) AS contig, count(*) AS n_rows, count(CASE WHEN inside = 1 AND variant_type = 'SNP' THEN 1 END) AS n_snp, count(CASE WHEN inside = 1 AND variant_type = 'MNV' THEN 1 END) AS n_mnv, count(CASE WHEN inside = 1 AND variant_type = 'SNP/MNV' THEN 1 END) AS n_snp_mnv, count(CASE WHEN inside = 1 AND variant_type = 'INDEL' THEN 1 END) AS n_indel, count(CASE WHEN inside = 0 THEN 1 END) AS n_intergenic FROM allrows GROUP BY ROLLUP (chrom)"),
    "q53_pileup_view": sql("SELECT cast(o.chrom as varchar) AS contig, o.pos, count(*) AS depth, count(CASE WHEN o.base = v.alt THEN 1 END) AS alt_reads, count(CASE WHEN o.is_rev = 1 THEN 1 END) AS reverse_reads, min(o.quality) AS min_quality FROM observed o JOIN one v ON v.chrom = o.chrom AND v.pos = o.pos GROUP BY o.chrom, o.pos"),
    "q54_report_rows": sql("SELECT gene_id, low AS codon_start, snvs, cast(dense_rank() OVER (ORDER BY change_type) - 1 as int) AS change_type_code, cast(dense_rank() OVER (ORDER BY so_term) - 1 as int) AS so_term_code FROM soed"),
}
N["wide"] = f"SELECT h.*, CASE WHEN change_type = 'Non-synonymous' THEN cast(round({_rho} * sqrt({_al} * (a.c - b.c) * (a.c - b.c) + {_be} * (a.p - b.p) * (a.p - b.p) + {_ga} * (a.v - b.v) * (a.v - b.v))) as int) END AS grantham, {_so} AS so_term, {_im} AS impact FROM hgvs h LEFT JOIN prop a ON a.aa = h.ref_aa LEFT JOIN prop b ON b.aa = h.alt_aa"
ORACLES["q50_info_string"] = sql("SELECT gene_id, low AS codon_start, snvs, concat_ws(';', 'GENE=' || cast(gene_id as varchar), 'AA=' || aa_change, 'CT=' || change_type, 'TYPE=' || variant_type, 'SO=' || so_term, 'IMPACT=' || impact, 'GD=' || cast(grantham as varchar), 'DBS=' || dbs_class, 'HGVSC=' || replace(hgvs_c, ';', '%3B')) AS info FROM wide")
N["stop0"] = "SELECT gene_id, strand, gs, ge, pos, ref, alt, is_del, size, delta, ref_cds, alt_cds FROM effect WHERE ((delta % 3) + 3) % 3 <> 0"
N["stopr"] = f"SELECT gene_id, min(i) AS ref_stop FROM (SELECT gene_id, cds, unnest(generate_series(1, length(cds) // 3)) AS i FROM gcds) WHERE {residue('substr(cds, cast(i * 3 - 2 as int), 3)')} = '*' GROUP BY gene_id"
N["stopa"] = f"SELECT gene_id, pos, ref, alt, min(i) AS alt_stop FROM (SELECT gene_id, pos, ref, alt, alt_cds, unnest(generate_series(1, length(alt_cds) // 3)) AS i FROM stop0) WHERE {residue('substr(alt_cds, cast(i * 3 - 2 as int), 3)')} = '*' GROUP BY gene_id, pos, ref, alt"
N["ptc0"] = "SELECT s.*, r.ref_stop, a.alt_stop, CASE WHEN s.strand = '+' THEN CASE WHEN s.is_del = 1 THEN greatest(s.pos + 1, s.gs) ELSE s.pos + 1 END - s.gs ELSE s.ge - CASE WHEN s.is_del = 1 THEN least(s.pos + s.size, s.ge) ELSE s.pos END END AS fst FROM stop0 s LEFT JOIN stopr r ON r.gene_id = s.gene_id LEFT JOIN stopa a ON a.gene_id = s.gene_id AND a.pos = s.pos AND a.ref = s.ref AND a.alt = s.alt"
N["ptc1"] = "SELECT *, (alt_stop - 1) * 3 - delta AS back, (coalesce(ref_stop, length(ref_cds) // 3 + 1) - 1) * 3 AS until FROM ptc0"
ORACLES["q31_frameshift_ptc"] = sql("SELECT gene_id, pos, ref, alt, cast(ref_stop as int) AS ref_stop, cast(alt_stop as int) AS alt_stop, CASE WHEN back >= 0 AND back < until THEN cast(back // 3 + 1 as bigint) END AS ptc FROM ptc1")
N["lastj"] = "SELECT gene_id, max(offset0) AS last_junction FROM offs GROUP BY gene_id"
ORACLES["q32_nmd"] = sql(f"SELECT j.gene_id, cast(j.codon as bigint) AS codon, j.alt_codon, cast(l.last_junction as bigint) AS last_junction, CASE WHEN j.codon * 3 + 50 < l.last_junction THEN 'NMD-triggering' ELSE 'NMD-escaping' END AS nmd FROM jcodon j JOIN lastj l ON l.gene_id = j.gene_id WHERE {residue('j.alt_codon')} = '*' AND {residue('j.ref_codon')} <> '*'")

_protein = lambda cds: f"array_to_string([{residue(f'substr({cds}, cast(i * 3 - 2 as int), 3)')} for i in range(1, length({cds}) // 3 + 1)], '')"
N["prot0"] = f"SELECT *, ((delta % 3) + 3) % 3 <> 0 AS frameshift, {_protein('ref_cds')} AS rp, {_protein('alt_cds')} AS ap FROM effect"
N["prot1"] = "SELECT *, coalesce(list_max([i for i in range(1, least(length(rp), length(ap)) + 1) if substr(rp, 1, i) = substr(ap, 1, i)]), 0) AS pre FROM prot0"
N["prot2"] = "SELECT *, coalesce(list_max([i for i in range(1, least(length(rp), length(ap)) - pre + 1) if right(rp, i) = right(ap, i)]), 0) AS suf FROM prot1"
N["prot3"] = "SELECT *, substr(rp, pre + 1, length(rp) - pre - suf) AS rm, substr(ap, pre + 1, length(ap) - pre - suf) AS am, CASE WHEN instr(rp, '*') > 0 THEN substr(rp, 1, instr(rp, '*')) ELSE rp END AS ru, CASE WHEN instr(ap, '*') > 0 THEN substr(ap, 1, instr(ap, '*')) ELSE ap END AS au FROM prot2"
_stops = lambda p: f"(length({p}) - length(replace({p}, '*', '')))"
N["prot4"] = f"SELECT *, CASE WHEN frameshift THEN 'Frameshift Indel' WHEN substr(rp, 1, 1) = 'M' AND substr(ap, 1, 1) NOT IN ('M', '*') THEN 'Start lost' WHEN {_stops('ap')} > {_stops('rp')} THEN 'Stop gained' WHEN {_stops('ap')} < {_stops('rp')} THEN 'Stop lost' WHEN ru = au THEN 'Synonymous' ELSE 'In-frame Indel' END AS change_type FROM prot3"
_res = lambda s_, i: three(f"coalesce(nullif(substr({s_}, cast({i} as int), 1), ''), 'X')")
_every = lambda s_: f"array_to_string([{three(f'substr({s_}, i, 1)')} for i in range(1, length({s_}) + 1)], '')"
_t = lambda x: f"cast({x} as varchar)"
_span = f"{_res('rm', '1')} || {_t('pre + 1')} || CASE WHEN length(rm) > 1 THEN '_' || {_res('rm', 'length(rm)')} || {_t('pre + length(rm)')} ELSE '' END"
ORACLES["q30_indel_protein_effect"] = sql(
    f"SELECT gene_id, {C}, pos, ref, alt, cast(delta as bigint) AS delta, frameshift, change_type, CASE WHEN change_type = 'Synonymous' OR (rp = ap AND NOT frameshift) THEN 'Synonymous' WHEN rp = ap THEN {_res('rp', 'length(rp)')} || {_t('greatest(length(rp), 1)')} || 'fs' "
    f"WHEN frameshift THEN {_res('rp', 'pre + 1')} || {_t('pre + 1')} || {_res('ap', 'pre + 1')} || 'fs' WHEN length(rm) = 1 AND length(am) = 1 THEN {_res('rm', '1')} || {_t('pre + 1')} || {_res('am', '1')} "
    f"WHEN length(rm) = 0 THEN CASE WHEN pre > 0 AND pre < length(rp) THEN {_res('rp', 'pre')} || {_t('pre')} || '_' || {_res('rp', 'pre + 1')} ELSE {_t('pre')} || '_' END || CASE WHEN pre > 0 AND pre < length(rp) THEN {_t('pre + 1')} ELSE {_t('pre + 1')} END || 'ins' || {_every('am')} "
    f"WHEN length(am) = 0 THEN {_span} || 'del' ELSE {_span} || 'delins' || {_every('am')} END AS protein_change FROM prot4"
)
_gate = 0.2
N["ifreq"] = "SELECT chrom, pos, CASE WHEN sum(c) > 0 THEN count(CASE WHEN s = 1 AND against = 0 THEN 1 END) / sum(c)::double END AS freq FROM ispan GROUP BY chrom, pos"
N["gplaced"] = f"SELECT i.*, CASE WHEN i.is_del = 1 THEN -2 ELSE 3 END AS delta FROM rplaced i LEFT JOIN ifreq f ON f.chrom = i.chrom AND f.pos = i.pos WHERE coalesce(f.freq, 1e9) >= {_gate}"
N["rkeys"] = "SELECT DISTINCT gene_id, chrom, strand, low, pos AS spos FROM placed1"
N["linkp"] = "SELECT p.gene_id, p.ipos, p.spos, count(l.mol) AS informative, count(CASE WHEN l.sup = 1 THEN 1 END) AS cis FROM lpairs p LEFT JOIN (SELECT c.chrom, c.pos AS spos, s.pos AS ipos, c.mol, s.sup FROM lcarry c JOIN lshow s ON s.chrom = c.chrom AND s.mol = c.mol) l ON l.chrom = p.chrom AND l.spos = p.spos AND l.ipos = p.ipos GROUP BY p.gene_id, p.ipos, p.spos"
N["transp"] = "SELECT DISTINCT k.gene_id, k.low, t.ipos FROM linkp t JOIN rkeys k ON k.gene_id = t.gene_id AND k.spos = t.spos WHERE t.informative >= 2 AND t.cis <= 0.1 * t.informative"
_gup = _up.replace("i.size", "2")
_gover = _over.replace("i.size", "2")
N["gkeys"] = "SELECT DISTINCT gene_id, chrom, strand, low FROM rkeys"
N["gstate"] = f"SELECT k.gene_id, k.low, coalesce(sum(CASE WHEN {_gup} AND t.ipos IS NULL THEN i.delta ELSE 0 END), 0) AS shift FROM gkeys k LEFT JOIN gplaced i ON i.gene_id = k.gene_id LEFT JOIN transp t ON t.gene_id = k.gene_id AND t.low = k.low AND t.ipos = i.pos GROUP BY k.gene_id, k.low"
N["gover"] = f"SELECT DISTINCT k.gene_id, k.low FROM gkeys k JOIN rplaced i ON i.gene_id = k.gene_id WHERE {_gover}"
ORACLES["q76_gated_frame_states"] = sql("SELECT s.gene_id, s.low AS codon_start, cast(s.shift as bigint) AS shift, ((s.shift % 3) + 3) % 3 <> 0 AS frameshift, o.low IS NOT NULL AS overlap FROM gstate s LEFT JOIN gover o ON o.gene_id = s.gene_id AND o.low = s.low")
N["gfs"] = "SELECT p.gene_id, count(*) AS k, max(CASE WHEN p.back >= 0 AND p.back < p.until THEN p.back // 3 + 1 END) AS ptc FROM ptc1 p JOIN idelta i ON i.gene_id = p.gene_id AND i.pos = p.pos AND i.ref = p.ref AND i.alt = p.alt WHERE i.af >= 0.5 GROUP BY p.gene_id"
N["fsrow"] = "SELECT k.*, s.over, ((s.shift % 3) + 3) % 3 <> 0 AND s.over = 0 AS off, ((s.shift % 3) + 3) % 3 <> 0 AND s.over = 0 AND coalesce(k.aa_pos > f.ptc, false) AS past FROM codon k JOIN states s ON s.gene_id = k.gene_id AND s.low = k.low LEFT JOIN gfs f ON f.gene_id = k.gene_id AND f.k = 1"
_shifted = "CASE change_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FRAMESHIFTED.items()) + " ELSE change_type END"
ORACLES["q94_frameshift_rows"] = sql(f"SELECT gene_id, low AS codon_start, snvs, CASE WHEN over = 1 THEN 'Unknown' WHEN past THEN 'downstream of premature stop' WHEN off THEN aa_change || ' (fs)' ELSE aa_change END AS aa_change, CASE WHEN over = 1 THEN 'Indel overlap' WHEN past THEN 'Downstream of premature stop' WHEN off THEN {_shifted} ELSE change_type END AS change_type FROM fsrow")
N["sseq"] = f"SELECT gene_id, chrom, strand, seg_idx, seg_start, seg_end, string_agg({base('p')}, '' ORDER BY p) AS seq FROM (SELECT *, unnest(generate_series(seg_start, seg_end)) AS p FROM segments) GROUP BY ALL"
N["sinner"] = "SELECT *, CASE WHEN strand = '+' THEN seg_idx < max(seg_idx) OVER (PARTITION BY gene_id) ELSE seg_idx > 0 END AS inside FROM sseq"
_del = "i.is_del = 1 AND i.pos + 1 <= s.seg_end AND i.pos + i.size >= s.seg_start"
_ins = "i.is_del = 0 AND i.pos >= s.seg_start AND (i.pos < s.seg_end OR (i.pos = s.seg_end AND s.inside))"
N["shit"] = f"SELECT DISTINCT s.gene_id, i.chrom, i.pos, i.ref, i.alt, i.is_del, i.size FROM indels i JOIN sinner s ON s.chrom = i.chrom AND (({_del}) OR ({_ins}))"
N["spart"] = (
    f"SELECT i.*, s.strand, s.seg_idx, s.seq, CASE WHEN {_del} THEN -(least(i.pos + i.size, s.seg_end) - greatest(i.pos + 1, s.seg_start) + 1) WHEN {_ins} THEN i.size ELSE 0 END AS d, "
    f"CASE WHEN {_del} THEN substr(s.seq, 1, cast(greatest(i.pos + 1, s.seg_start) - s.seg_start as int)) || substr(s.seq, cast(i.pos + i.size - s.seg_start + 2 as int)) WHEN {_ins} THEN substr(s.seq, 1, cast(i.pos - s.seg_start + 1 as int)) || substr(i.alt, 2) || substr(s.seq, cast(i.pos - s.seg_start + 2 as int)) ELSE s.seq END AS new FROM shit i JOIN sinner s ON s.gene_id = i.gene_id"
)
_or = lambda c: f"string_agg(CASE WHEN strand = '-' THEN {revcomp(c)} ELSE {c} END, '' ORDER BY seg_idx)"
N["seffect"] = f"SELECT gene_id, chrom, pos, ref, alt, is_del, size, cast(sum(d) as bigint) AS delta, {_or('seq')} AS ref_cds, {_or('new')} AS alt_cds FROM spart GROUP BY gene_id, chrom, pos, ref, alt, is_del, size"
for _k, _old, _new in ((0, "effect", "seffect"), (1, "prot0", "sprot0"), (2, "prot1", "sprot1"), (3, "prot2", "sprot2"), (4, "prot3", "sprot3")):
    N[f"sprot{_k}"] = N[f"prot{_k}"].replace(f"FROM {_old}", f"FROM {_new}")
_effect_sql = ORACLES["q30_indel_protein_effect"][ORACLES["q30_indel_protein_effect"].rindex("SELECT gene_id, cast(chrom as varchar) AS contig, pos, ref, alt, cast(delta") :]
ORACLES["q95_spliced_indel_effect"] = sql(_effect_sql.replace("FROM prot4", "FROM sprot4").replace("frameshift, change_type,", "change_type,", 1))
