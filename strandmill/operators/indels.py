"""Indels in coding sequence: deltas, propagation of frameshifts, overlap flags, protein effects, premature stops, NMD.

indels carry pos, ref, alt and, from with_event, components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.aa import three_letter
from strandmill.functions.alleles import changed_positions, common_prefix, common_suffix, overlaps
from strandmill.functions.consequence import indel_change_type
from strandmill.functions.dna import count_to, oriented, translate
from strandmill.operators.intervals import interval_join
from strandmill.operators.reference import intervals_sequence

NMD_BASES = 50


def place_indels(indels: DataFrame, genes: DataFrame) -> DataFrame:
    """A row per indel and gene it touches (insertions only between two bases of the gene)."""
    spans = genes.withColumnRenamed("start", "g_start").withColumnRenamed("end", "g_end")
    lo = F.array_min(F.transform("components", lambda c: c["pos"]))
    hi = F.array_max(F.transform("components", lambda c: c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0))))
    rows = interval_join(indels.withColumn("_lo", lo).withColumn("_hi", hi), spans, "contig", "_lo", "_hi", "g_start", "g_end")
    return rows.where(F.exists("components", lambda c: overlaps(c, F.col("g_start"), F.col("g_end")))).drop("_lo", "_hi")


def coding_delta(components: Column, start: Column, end: Column) -> Column:
    """Bases that the components add to a feature: insertions inside it, less the deleted bases that lie in it."""
    one = lambda c: F.when(c["kind"] == "INS", F.when(overlaps(c, start, end), F.length(c["alt"])).otherwise(0)).when(c["kind"] == "DEL", -F.greatest(F.least(c["pos"] + F.length(c["ref"]) - 1, end) - F.greatest(c["pos"], start) + 1, F.lit(0))).otherwise(0)
    return F.aggregate(components, F.lit(0).cast("long"), lambda s, c: s + one(c))


def is_upstream(components: Column, strand: Column, low: Column, high: Column) -> Column:
    """Every component lies before the codon [low, high] in transcript order; an insertion sits after its anchor."""
    last = lambda c: c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0))
    one = lambda c: F.when(c["kind"] == "INS", F.when(strand == "+", c["pos"] < low).otherwise(c["pos"] >= high)).otherwise(F.when(strand == "+", last(c) < low).otherwise(c["pos"] > high))
    return (F.size(components) > 0) & F.forall(components, one)


def passes_gate(observed: Column, declared: Column, least: float = 0.5) -> Column:
    """Frequency gate: the observed frequency, else the declared one, else open."""
    return F.coalesce(observed, declared, F.lit(float("inf"))) >= least


def upstream_key(components: Column, strand: Column) -> Column:
    """Place of an indel in transcript order: it is upstream of a codon if this is below codon_key of the codon."""
    last = F.array_max(F.transform(components, lambda c: c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0))))
    first = F.array_min(F.transform(components, lambda c: F.when(c["kind"] == "INS", c["pos"] + 1).otherwise(c["pos"])))
    return F.when(strand == "-", -first).otherwise(last)


def codon_key(strand: Column, codon_start: Column) -> Column:
    return F.when(strand == "-", -(codon_start + 2)).otherwise(codon_start)


def frame_states(codons: DataFrame, placed: DataFrame, least: float = 0.5) -> DataFrame:
    """Per codon (gene_id, strand, codon_start): shift (summed upstream deltas that pass the gate), frameshift, overlap.

    placed: place_indels with af, and observed (the frequency the reads show)
    where it is known. Codons and indels of a gene are put in one transcript
    order and the shift is a running sum, so a gene of many of both is sorted,
    not multiplied; overlaps meet by bins. A codon behind an indel whose length
    is unknown (symbolic) counts as overlapped: its frame can't be judged.
    """
    seen = F.col("observed") if "observed" in placed.columns else F.lit(None).cast("double")
    kinds = lambda k: F.exists("components", lambda c: c["kind"] == k)
    length = F.when(kinds("DELINS"), F.length("alt") - F.length("ref")).otherwise(coding_delta(F.col("components"), F.col("g_start"), F.col("g_end")))
    counts = passes_gate(seen, F.col("af"), least) & (F.size("components") > 0)
    unknown = (counts & kinds("SYMBOLIC")).cast("int")
    events = placed.select("gene_id", F.col("strand"), F.lit(None).cast("long").alias("codon_start"), upstream_key(F.col("components"), F.col("strand")).cast("long").alias("_o"), F.when(counts & ~kinds("SYMBOLIC"), length).otherwise(0).cast("long").alias("_d"), unknown.alias("_u"))
    rows = codons.select("gene_id", "strand", "codon_start").withColumn("_o", codon_key(F.col("strand"), F.col("codon_start")).cast("long")).withColumn("_d", F.lit(0).cast("long")).withColumn("_u", F.lit(0))
    before = Window.partitionBy("gene_id").orderBy("_o").rangeBetween(Window.unboundedPreceding, -1)
    out = rows.unionByName(events).withColumn("shift", F.coalesce(F.sum("_d").over(before), F.lit(0))).withColumn("_u", F.coalesce(F.max("_u").over(before), F.lit(0)) > 0).where("codon_start is not null").drop("_o", "_d")
    span = placed.select("gene_id", "components", F.array_min(F.transform("components", lambda c: c["pos"])).alias("_lo"), F.array_max(F.transform("components", lambda c: c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0)))).alias("_hi"))
    low, high = F.col("codon_start"), F.col("codon_start") + 2
    hit = interval_join(codons.select("gene_id", "codon_start").withColumn("_end", high), span, "gene_id", "codon_start", "_end", "_lo", "_hi").where(F.exists("components", lambda c: overlaps(c, low, high)))
    flags = hit.select("gene_id", "codon_start").distinct().withColumn("overlap", F.lit(True))
    out = out.join(flags, ["gene_id", "codon_start"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)) | F.col("_u"))
    return out.select("gene_id", "strand", "codon_start", "shift", "overlap").withColumn("frameshift", F.pmod("shift", F.lit(3)) != 0)


def suppress_trans(states: DataFrame, trans: DataFrame) -> DataFrame:
    """frame_states without the deltas of indels that the reads put on other molecules. trans: gene_id, codon_start, delta, a row per such indel upstream of the codon."""
    gone = trans.groupBy("gene_id", "codon_start").agg(F.sum("delta").alias("_gone"))
    out = states.join(gone, ["gene_id", "codon_start"], "left").withColumn("shift", F.col("shift") - F.coalesce("_gone", F.lit(0))).drop("_gone")
    return out.withColumn("frameshift", F.pmod("shift", F.lit(3)) != 0)


def apply_to_feature(seq: Column, start: Column, components: Column, open_end: Column | None = None) -> Column:
    """Genomic sequence of a feature with simple insertions and deletions put in, last position first; null for symbolic or conflicting ones.

    Components conflict where a substitution or an insertion's anchor lies in
    deleted bases, or two at one place differ. An insertion behind the last base
    counts where open_end is true (the feature goes on in the transcript).
    """
    inner = F.lit(False) if open_end is None else open_end
    gone = F.flatten(F.transform(F.filter(components, lambda c: c["kind"] == "DEL"), lambda c: F.sequence(c["pos"], c["pos"] + F.length(c["ref"]) - 1)))
    put = F.filter(components, lambda c: c["kind"].isin("SNV", "INS"))
    places = F.transform(put, lambda c: F.struct(c["kind"].alias("kind"), c["pos"].alias("pos")))
    clash = F.exists(put, lambda c: F.array_contains(gone, c["pos"])) | (F.size(F.array_distinct(places)) < F.size(F.array_distinct(F.transform(put, lambda c: F.struct(c["kind"].alias("kind"), c["pos"].alias("pos"), F.upper(c["alt"]).alias("alt"))))))
    last_first = F.reverse(F.array_sort(F.transform(components, lambda c: F.struct(c["pos"].alias("pos"), c["kind"].alias("kind"), c["ref"].alias("ref"), c["alt"].alias("alt")))))

    def apply(s: Column, c: Column) -> Column:
        k = (c["pos"] - start + 1).cast("int")  # 1-based place of the component in the feature
        cut_from, cut_to = F.greatest(k, F.lit(1)), F.least(k + F.length(c["ref"]), F.length(s) + 1)
        gone = F.concat(F.substr(s, F.lit(1), cut_from - 1), F.substr(s, cut_to, F.length(s)))
        return (
            F.when(c["kind"] == "SNV", F.when((k >= 1) & (k <= F.length(s)), F.overlay(s, c["alt"], k, F.lit(1))).otherwise(s))
            .when(c["kind"] == "INS", F.when((k >= 1) & ((k < F.length(s)) | (inner & (k == F.length(s)))), F.concat(F.substr(s, F.lit(1), k), c["alt"], F.substr(s, k + 1, F.length(s)))).otherwise(s))
            .when(c["kind"] == "DEL", F.when(cut_to > cut_from, gone).otherwise(s))
        )

    return F.when(~clash, F.aggregate(last_first, seq, apply))


def protein_change(ref: Column, alt: Column, offset: Column, frameshift: Column) -> Column:
    """Description of a protein change, residues numbered from offset + 1: fs, single, del, delins, ins with flanks."""
    pre = common_prefix(ref, alt)
    suf = common_suffix(ref, alt, pre)
    rm, am = F.substr(ref, pre + 1, F.length(ref) - pre - suf), F.substr(alt, pre + 1, F.length(alt) - pre - suf)
    three = lambda s: F.array_join(F.transform(count_to(F.length(s)), lambda i: three_letter(F.substr(s, i, F.lit(1)))), "")
    at = lambda s, i: three_letter(F.coalesce(F.nullif(F.substr(s, i, F.lit(1)), F.lit("")), F.lit("X")))
    pos = (offset + pre + 1).cast("string")
    end = (offset + pre + F.length(rm)).cast("string")
    span = F.when(F.length(rm) == 1, F.concat(at(rm, F.lit(1)), pos)).otherwise(F.concat(at(rm, F.lit(1)), pos, F.lit("_"), at(rm, F.length(rm)), end))
    ins = F.concat((offset + pre).cast("string"), F.lit("_"), pos, F.lit("ins"), three(am))
    flanked = F.concat(at(ref, pre), (offset + pre).cast("string"), F.lit("_"), at(ref, pre + 1), pos, F.lit("ins"), three(am))
    same_fs = F.concat(at(ref, F.length(ref)), (offset + F.greatest(F.length(ref), F.lit(1))).cast("string"), F.lit("fs"))
    return (
        F.when((ref == alt) & frameshift, same_fs)
        .when(ref == alt, "Synonymous")
        .when(frameshift, F.concat(at(ref, pre + 1), pos, at(alt, pre + 1), F.lit("fs")))
        .when((F.length(rm) == 1) & (F.length(am) == 1), F.concat(at(rm, F.lit(1)), pos, at(am, F.lit(1))))
        .when(F.length(rm) == 0, F.when((pre > 0) & (pre < F.length(ref)), flanked).otherwise(ins))
        .when(F.length(am) == 0, F.concat(span, F.lit("del")))
        .otherwise(F.concat(span, F.lit("delins"), three(am)))
    )


def first_stop(protein: Column) -> Column:
    """1-based residue of the first stop, null without one."""
    return F.nullif(F.locate("*", protein), F.lit(0))


def protein_effects(placed: DataFrame, sequences: DataFrame, table: int = 11, offset: Column | None = None) -> DataFrame:
    """placed with ref_cds, alt_cds, delta, frameshift, change_type, protein_change and local_change (residues numbered from offset, and from 0), ref_codon, alt_codon, ref_stop and alt_stop.

    sequences: gene_id, seq (genomic, unspliced). Where placed has a phase, that
    many leading bases belong to a codon of another feature: they count for the
    delta, are not translated, and an indel that touches them leaves its residues
    unknown.
    """
    df = placed.join(sequences.select("gene_id", "seq"), "gene_id")
    phase = F.coalesce("phase", F.lit(0)) if "phase" in placed.columns else F.lit(0)
    minus = F.col("strand") == "-"
    df = df.withColumn("_s", F.col("g_start") + F.when(minus, 0).otherwise(phase)).withColumn("_e", F.col("g_end") - F.when(minus, phase).otherwise(0))
    df = df.withColumn("seq", F.substr("seq", (F.col("_s") - F.col("g_start") + 1).cast("int"), (F.col("_e") - F.col("_s") + 1).cast("int")))
    df = df.withColumn("alt_seq", apply_to_feature(F.col("seq"), F.col("_s"), F.col("components")))
    df = df.withColumn("ref_cds", oriented(F.col("seq"), F.col("strand"))).withColumn("alt_cds", oriented(F.col("alt_seq"), F.col("strand"))).drop("seq", "alt_seq")
    where = changed_positions(F.col("components"), F.col("pos"))
    lo, hi = F.greatest(F.array_min(where), F.col("_s")), F.least(F.array_max(where), F.col("_e"))
    df = df.withColumn("_first", F.when(lo <= hi, F.when(minus, F.col("_e") - hi).otherwise(lo - F.col("_s"))))
    skipped = F.when(minus, F.exists("components", lambda c: overlaps(c, F.col("_e") + 1, F.col("g_end")))).otherwise(F.exists("components", lambda c: overlaps(c, F.col("g_start"), F.col("_s") - 1)))
    df = df.withColumn("_skip", (phase > 0) & skipped)
    out = _effects(df.withColumn("delta", coding_delta(F.col("components"), F.col("g_start"), F.col("g_end"))), table, offset, F.col("_skip"))
    return with_codons(out, F.col("_first")).drop("_s", "_e", "_first", "_skip")


def codon_at(cds: str, offset: Column) -> Column:
    """The codon of a coding sequence that holds an offset; null beyond its last whole one."""
    start = (F.floor(offset / 3) * 3 + 1).cast("int")
    return F.when(F.length(cds) >= start + 2, F.substr(cds, start, F.lit(3)))


def with_codons(effects: DataFrame, offset: Column) -> DataFrame:
    """effects with ref_codon and alt_codon: what either sequence has at the codon of the first touched base; null where the alternate is unknown."""
    known = F.col("alt_cds").isNotNull()
    return effects.withColumn("ref_codon", F.when(known, codon_at("ref_cds", offset))).withColumn("alt_codon", F.when(known, codon_at("alt_cds", offset)))


def spliced_effects(alleles: DataFrame, segments: DataFrame, reference: DataFrame, table: int = 11) -> DataFrame:
    """The same for indels of spliced genes: contig, pos, ref, alt, gene_id and the columns of protein_effects.

    An allele is put into every segment of a transcript that it touches, and the
    segments are joined in transcript order. An insertion behind a segment's
    last genomic base counts where the transcript goes on there.
    """
    last = F.max("seg_idx").over(Window.partitionBy("gene_id"))
    inner = F.when(F.col("strand") == "+", F.col("seg_idx") < last).otherwise(F.col("seg_idx") > 0)
    segs = segments.withColumn("inner", inner).select("gene_id", "contig", "strand", "seg_idx", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "inner")
    lo = F.array_min(F.transform("components", lambda c: c["pos"]))
    hi = F.array_max(F.transform("components", lambda c: c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0))))
    own = alleles.select("contig", "pos", "ref", "alt", "components")
    near = interval_join(own.withColumn("_lo", lo).withColumn("_hi", hi), segs, "contig", "_lo", "_hi", "s_start", "s_end")
    ends = lambda c: F.col("inner") & (c["kind"] == "INS") & (c["pos"] == F.col("s_end"))
    hit = near.where(F.exists("components", lambda c: overlaps(c, F.col("s_start"), F.col("s_end")) | ends(c))).select("gene_id", *own.columns).distinct()
    seqs = intervals_sequence(segs, reference, ["gene_id", "strand", "seg_idx", "s_start", "s_end", "inner"], "s_start", "s_end")
    part = hit.join(seqs, "gene_id")
    more = F.aggregate("components", F.lit(0).cast("long"), lambda a, c: a + F.when(ends(c), F.length(c["alt"])).otherwise(0))
    part = part.withColumn("d", coding_delta(F.col("components"), F.col("s_start"), F.col("s_end")) + more).withColumn("new", apply_to_feature(F.col("seq"), F.col("s_start"), F.col("components"), F.col("inner")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", oriented(F.col(c), F.col("strand")).alias("s")))), lambda x: x["s"]), "")
    whole = part.groupBy("gene_id", "strand", *own.columns).agg(joined("seq").alias("ref_cds"), F.when(F.count("new") == F.count(F.lit(1)), joined("new")).alias("alt_cds"), F.sum("d").alias("delta"))
    return _effects(whole, table, None)


def _effects(df: DataFrame, table: int, offset: Column | None, hidden: Column | None = None) -> DataFrame:
    """What follows from ref_cds, alt_cds (null: unknown) and delta. hidden: residues can't be told."""
    offset, hidden = F.lit(0) if offset is None else offset, F.lit(False) if hidden is None else hidden
    known = F.col("alt_cds").isNotNull()
    raw = F.pmod(F.length("ref") - F.length("alt"), F.lit(3)) != 0
    df = df.withColumn("frameshift", F.when(known, F.pmod("delta", F.lit(3)) != 0).otherwise(raw & ~F.col("alt").startswith("<")))
    df = df.withColumn("ref_protein", translate(F.col("ref_cds"), table)).withColumn("alt_protein", translate(F.col("alt_cds"), table))
    until = lambda p: F.when(F.locate("*", p) > 0, F.substr(p, F.lit(1), F.locate("*", p))).otherwise(p)
    change = indel_change_type(F.col("ref_protein"), F.col("alt_protein"), F.col("frameshift"))
    past = ~F.col("frameshift") & (until(F.col("ref_protein")) == until(F.col("alt_protein"))) & (change == "In-frame Indel")
    blind = F.when(F.col("alt").startswith("<"), "Unknown").when(F.col("frameshift"), "Frameshift Indel").otherwise("In-frame Indel")
    df = df.withColumn("change_type", F.when(~known, blind).when(past, "Synonymous").otherwise(change))
    text = lambda o: F.when(~known, "Unknown").when(F.col("change_type") == "Synonymous", "Synonymous").when(hidden, "Unknown").otherwise(protein_change(F.col("ref_protein"), F.col("alt_protein"), o, F.col("frameshift")))
    df = df.withColumn("protein_change", text(offset)).withColumn("local_change", text(F.lit(0)))
    return df.withColumn("ref_stop", first_stop(F.col("ref_protein"))).withColumn("alt_stop", first_stop(F.col("alt_protein")))


def premature_stop(ref_stop: Column, alt_stop: Column, delta: Column, ref_length: Column) -> Column:
    """Residue of the altered protein's stop in reference codons (its place less the delta), where it precedes the reference's own; null otherwise."""
    back = (alt_stop - 1) * 3 - delta
    own = F.coalesce(ref_stop, F.floor(ref_length / 3) + 1)
    found = F.floor(back / 3) + 1
    return F.when((back >= 0) & (found < own), found)


def first_changed(component: Column, strand: Column, start: Column, end: Column) -> Column:
    """0-based offset in an unspliced feature of the first base that a component changes, in transcript order."""
    last = component["pos"] + F.greatest(F.length(component["ref"]) - 1, F.lit(0))
    plus = F.when(component["kind"] == "INS", component["pos"] + 1).otherwise(F.greatest(component["pos"], start)) - start
    minus = end - F.when(component["kind"] == "INS", component["pos"]).otherwise(F.least(last, end))
    return F.when(strand == "+", plus).otherwise(minus)


def premature_stops(effects: DataFrame, least: float = 0.5) -> DataFrame:
    """gene_id, ptc: residue of the premature stop of genes with exactly one frame-shifting indel that passes the gate. effects: protein_effects with af."""
    seen = F.col("observed") if "observed" in effects.columns else F.lit(None).cast("double")
    rows = effects.where(F.col("frameshift") & F.col("alt_cds").isNotNull() & passes_gate(seen, F.col("af"), least))
    ptc = premature_stop(F.col("ref_stop"), F.col("alt_stop"), F.col("delta"), F.length("ref_cds"))
    return rows.withColumn("_p", ptc).groupBy("gene_id").agg(F.count(F.lit(1)).alias("_k"), F.max("_p").alias("ptc")).where("_k = 1 and ptc is not null").select("gene_id", F.col("ptc").cast("long").alias("ptc"))


TEXTS = ("aa_change", "snp_aa_changes", "local_aa_change", "local_snp_aa_changes")


def relabel_rows(rows: DataFrame, states: DataFrame, stops: DataFrame) -> DataFrame:
    """Codon rows (gene_id, codon_start, aa_local, TEXTS, change_type) as upstream indels leave them.

    In a shifted frame every residue text is marked (fs), or, behind the gene's
    premature stop, replaced; where an indel lies in the codon, or the shift
    can't be known, the residues are unknown, which outranks both. trans_shift,
    where rows have it, is taken from a row's shift.
    """
    df = rows.join(states.select("gene_id", "codon_start", F.col("shift").alias("_d"), F.col("overlap").alias("_o")), ["gene_id", "codon_start"], "left").join(stops, "gene_id", "left")
    over, shift = F.coalesce("_o", F.lit(False)), F.coalesce("_d", F.lit(0))
    if "trans_shift" in df.columns:
        shift = shift - F.coalesce("trans_shift", F.lit(0))
    off = (F.pmod(shift, F.lit(3)) != 0) & ~over
    past = off & F.coalesce(F.col("aa_local") > F.col("ptc"), F.lit(False))
    one = lambda x: F.when(over, "Unknown").when(past, "downstream of premature stop").when(off, F.concat(x, F.lit(" (fs)"))).otherwise(x)
    for c in TEXTS:
        if c in df.columns:
            df = df.withColumn(c, F.array_join(F.transform(F.split(c, ", "), one), ", "))
    df = df.withColumn("change_type", relabel(F.col("change_type"), shift, over, past))
    return df.drop("_d", "_o", "ptc")


def nmd(ptc_offset: Column, last_junction: Column) -> Column:
    """50-base rule: a stop more than 50 bases before the last junction triggers decay; null without a junction."""
    return F.when(last_junction.isNotNull() & ptc_offset.isNotNull(), F.when(ptc_offset + NMD_BASES < last_junction, "NMD-triggering").otherwise("NMD-escaping"))


def relabel(change: Column, state_shift: Column, overlap: Column, past_stop: Column) -> Column:
    """Change type of a codon given upstream indels: overlap outranks a frameshift, which outranks the plain change."""
    from strandmill.functions.consequence import FRAMESHIFTED

    shifted = F.when(past_stop, "Downstream of premature stop")
    for k, v in FRAMESHIFTED.items():
        shifted = shifted.when(change == k, v)
    return F.when(overlap, "Indel overlap").when(F.pmod(state_shift, F.lit(3)) != 0, shifted.otherwise(change)).otherwise(change)
