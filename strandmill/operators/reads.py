"""Aligned reads: CIGAR expansion, molecules, support, linkage, local haplotypes.

reads: read_id, qname, contig, start, flag, mapq, cigar, seq, qual (phred+33 text or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.alleles import observed_span
from strandmill.functions.stats import fisher_exact, linkage
from strandmill.operators.intervals import interval_join

#: Flag bits of records that are never counted: secondary, failed, duplicate, supplementary.
SKIP_FLAGS, REVERSE, FIRST_LAST = 0xF00, 0x10, 0xC0
MAX_QUALITY = 255


def usable(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Primary reads of at least min_mapq (missing counts as 255)."""
    return reads.where((F.col("flag").bitwiseAND(SKIP_FLAGS) == 0) & (F.coalesce("mapq", F.lit(MAX_QUALITY)) >= min_mapq))


def molecule_key(pair_aware: bool = True) -> Column:
    """Identity under which reads are one molecule: the name, or name, flags and start; unnamed records never merge."""
    alone = F.concat(F.lit("#"), F.col("read_id").cast("string"))
    record = F.concat_ws("|", "qname", F.col("flag").bitwiseAND(FIRST_LAST).cast("string"), F.col("start").cast("string"))
    return F.when(F.col("qname").isNull() | (F.col("qname") == "*"), alone).otherwise(F.col("qname") if pair_aware else record)


def cigar_ops(cigar: Column, start: Column) -> Column:
    """Array of (op, n, q0, r0) of a CIGAR text: 0-based query start and reference position of each operation."""
    lens = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    zipped = F.arrays_zip(F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)).alias("op"), lens.alias("n"))
    init = F.struct(F.lit(0).alias("q"), start.cast("long").alias("r"), F.expr("cast(array() as array<struct<op:string,n:int,q0:int,r0:bigint>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        takes = lambda s: F.when(x["op"].isin(*s), x["n"]).otherwise(0)
        row = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["q"].alias("q0"), acc["r"].alias("r0"))
        return F.struct((acc["q"] + takes("MIS=X")).alias("q"), (acc["r"] + takes("MDN=X")).alias("r"), F.concat(acc["out"], F.array(row)).alias("out"))

    # most reads are one block: no list is built step by step for them
    n = F.substr(cigar, F.lit(1), F.length(cigar) - 1).cast("int")
    one = F.array(F.struct(F.substr(cigar, F.length(cigar), F.lit(1)).alias("op"), n.alias("n"), F.lit(0).alias("q0"), start.cast("long").alias("r0")))
    return F.when(cigar.rlike("^[0-9]+[M=X]$"), one).otherwise(F.aggregate(zipped, init, step, lambda a: a["out"]))


def cigar_blocks(reads: DataFrame) -> DataFrame:
    """A row per CIGAR operation: op, n, q0 (0-based query start), r0 (reference position)."""
    return reads.withColumn("_b", F.explode(cigar_ops(F.col("cigar"), F.col("start")))).select(*reads.columns, "_b.*")


def observe_sites(reads: DataFrame, sites: DataFrame, pair_aware: bool = True, bin_size: int = 256) -> DataFrame:
    """A row per read and site its aligned blocks cover: molecule, is_reverse, base, quality. sites: contig, pos (distinct).

    Blocks meet sites by bins, so only sites are looked at, never every base; a
    block's bin holds the bases and qualities in it alone, so what is shuffled
    is as long as the reads.
    """
    own = reads.withColumn("molecule", molecule_key(pair_aware)).withColumn("is_reverse", F.col("flag").bitwiseAND(REVERSE) != 0)
    blocks = cigar_blocks(own).where(F.col("op").isin("M", "=", "X")).withColumn("r1", F.col("r0") + F.col("n") - 1)
    dealt = blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("r0") / bin_size), F.floor(F.col("r1") / bin_size))))
    lo, hi = F.greatest("r0", F.col("_bin") * bin_size), F.least("r1", F.col("_bin") * bin_size + bin_size - 1)
    piece = lambda c: F.substr(c, (F.col("q0") + lo - F.col("r0") + 1).cast("int"), (hi - lo + 1).cast("int"))
    missing = F.col("qual").isNull() | (F.col("qual") == "*")
    dealt = dealt.select("contig", "_bin", "read_id", "molecule", "is_reverse", lo.alias("_lo"), hi.alias("_hi"), piece("seq").alias("_seq"), F.when(~missing, piece("qual")).alias("_qual"))
    at = sites.select(F.col("contig").alias("_c"), F.col("pos").alias("pos"), F.floor(F.col("pos") / bin_size).alias("_pb"))
    rows = dealt.join(at, (F.col("contig") == F.col("_c")) & (F.col("_bin") == F.col("_pb")) & F.col("pos").between(F.col("_lo"), F.col("_hi")))
    i = (F.col("pos") - F.col("_lo") + 1).cast("int")
    quality = F.when(F.col("_qual").isNull(), MAX_QUALITY).otherwise(F.ascii(F.substr("_qual", i, F.lit(1))) - 33)
    return rows.select("contig", "pos", "read_id", "molecule", "is_reverse", F.substr("_seq", i, F.lit(1)).alias("base"), quality.alias("quality")).where("base <> 'N'")


def merge_molecules(observed: DataFrame) -> DataFrame:
    """One row per molecule and site: mates that agree merge (best quality, both strands), mates that disagree leave the site unseen.

    Bases are compared as numbers, which are aggregated without sorting; rows
    move by site, where what follows wants them.
    """
    code = F.ascii(F.upper("base"))
    rows = observed.select("contig", "pos", "molecule", code.alias("_b"), "quality", "is_reverse").repartition("contig", "pos").groupBy("contig", "pos", "molecule").agg(
        F.min("_b").alias("_lo"),
        F.max("_b").alias("_hi"),
        F.max("quality").alias("quality"),
        F.max(~F.col("is_reverse")).alias("fwd"),
        F.max("is_reverse").alias("rev"),
    )
    return rows.where("_lo = _hi").select("contig", "pos", "molecule", F.when(F.col("_lo") > 0, F.char("_lo")).otherwise("").alias("base"), "quality", "fwd", "rev")


def snp_support(merged: DataFrame, snvs: DataFrame, min_quality: int = 20) -> DataFrame:
    """Per SNV: alt molecules by strand and depth by strand."""
    seen = merged.where(F.col("quality") >= min_quality)
    rows = snvs.join(seen, ["contig", "pos"], "left")
    is_alt = F.upper("alt") == F.col("base")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*snvs.columns).agg(
        n(is_alt).alias("snp_reads"),
        n(is_alt & F.col("fwd")).alias("snp_forward"),
        n(is_alt & F.col("rev")).alias("snp_reverse"),
        n(F.col("base").isNotNull()).alias("depth"),
        n(F.col("base").isNotNull() & F.col("fwd")).alias("depth_forward"),
        n(F.col("base").isNotNull() & F.col("rev")).alias("depth_reverse"),
    )


def molecule_patterns(merged: DataFrame, members: DataFrame, keys: list[str], min_quality: int = 20) -> DataFrame:
    """Per haplotype (keys) and molecule that sees any of its sites: carries, spans, fwd, rev, pattern.

    members: keys, contig, pos, alt, idx (from 0), n. carries: all alternates
    are there; spans: all sites seen; pattern: 0/1 by site, only meaningful with
    spans. A strand counts for the haplotype if it carries every alternate.
    """
    seen = merged.where(F.col("quality") >= min_quality)
    rows = members.join(seen, ["contig", "pos"]).withColumn("hit", F.upper("alt") == F.col("base"))
    return rows.groupBy(*keys, "n", "molecule").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count(F.when(F.col("hit"), 1)).alias("hits"),
        F.count(F.when(F.col("hit") & F.col("fwd"), 1)).alias("hits_fwd"),
        F.count(F.when(F.col("hit") & F.col("rev"), 1)).alias("hits_rev"),
        F.min("fwd").alias("span_fwd"),
        F.min("rev").alias("span_rev"),
        F.array_sort(F.collect_list(F.struct("idx", F.col("hit").cast("int").alias("hit"), F.col("fwd").cast("int").alias("fwd"), F.col("rev").cast("int").alias("rev")))).alias("sites"),
    ).select(
        *keys,
        "n",
        "molecule",
        (F.col("seen") == F.col("n")).alias("spans"),
        (F.col("hits") == F.col("n")).alias("carries"),
        (F.col("hits_fwd") == F.col("n")).alias("carries_fwd"),
        (F.col("hits_rev") == F.col("n")).alias("carries_rev"),
        F.col("span_fwd"),
        F.col("span_rev"),
        F.array_join(F.transform("sites", lambda x: x["hit"].cast("string")), "").alias("pattern"),
        "sites",
    )


def mnv_support(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Per haplotype: molecules that carry it, by strand, and molecules that span it, by strand."""
    n = lambda c: F.count(F.when(c, 1))
    return patterns.groupBy(*keys).agg(
        n(F.col("carries")).alias("mnv_reads"),
        n(F.col("carries_fwd")).alias("mnv_forward"),
        n(F.col("carries_rev")).alias("mnv_reverse"),
        n(F.col("spans")).alias("mnv_depth"),
        n(F.col("spans") & F.col("span_fwd")).alias("mnv_depth_forward"),
        n(F.col("spans") & F.col("span_rev")).alias("mnv_depth_reverse"),
    )


def solo_support(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Per haplotype and site: molecules with the alternate but not the whole haplotype (all, and those that span it)."""
    rows = patterns.where("not carries").select(*keys, "spans", F.explode("sites").alias("s")).where("s.hit = 1")
    return rows.groupBy(*keys, F.col("s.idx").alias("idx")).agg(F.count(F.lit(1)).alias("solo_reads"), F.count(F.when(F.col("spans"), 1)).alias("solo_informative"))


def pattern_counts(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Per haplotype and 0/1 pattern: spanning molecules."""
    return patterns.where("spans").groupBy(*keys, "n", "pattern").agg(F.count(F.lit(1)).alias("molecules"))


def phasing_support(patterns: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Per haplotype: haplotype reads, the informative denominator and their ratio (null when it is 0)."""
    solo = solo_support(patterns, keys)
    least = members.select(*keys, "idx").join(solo, [*keys, "idx"], "left").groupBy(*keys).agg(F.min(F.coalesce("solo_informative", F.lit(0))).alias("least_solo"))
    both = least.join(mnv_support(patterns, keys), keys, "left").withColumn("mnv_reads", F.coalesce("mnv_reads", F.lit(0)))
    total = F.col("mnv_reads") + F.col("least_solo")
    return both.select(*keys, "mnv_reads", total.alias("informative"), F.when(total > 0, F.col("mnv_reads") / total).alias("phasing_support"))


def codon_linkage(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per haplotype: the pair of sites of smallest D' (ties: the first pair) with r squared, molecules and the pair's table."""
    pairs = F.expr("flatten(transform(sequence(1, n - 1), i -> transform(sequence(i + 1, n), j -> struct(i, j))))")
    rows = counts.where("n > 1").withColumn("_p", F.explode(pairs)).select(*keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), F.substr("pattern", F.col("_p.i"), F.lit(1)).alias("a"), F.substr("pattern", F.col("_p.j"), F.lit(1)).alias("b"), "molecules")
    cell = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("molecules")).otherwise(0))
    tables = rows.groupBy(*keys, "i", "j").agg(cell("1", "1").alias("both"), cell("1", "0").alias("first"), cell("0", "1").alias("second"), cell("0", "0").alias("neither"))
    linked = tables.withColumn("l", linkage(F.col("both"), F.col("first"), F.col("second"), F.col("neither"))).where("l is not null")
    weakest = linked.groupBy(*keys).agg(F.min(F.struct(F.col("l.d_prime").alias("d_prime"), "i", "j", F.col("l.r_squared").alias("r_squared"), F.col("l.molecules").alias("molecules"), "both", "first", "second", "neither")).alias("w"))
    p = fisher_exact(F.col("both"), F.col("first"), F.col("second"), F.col("neither"))
    return weakest.select(*keys, "w.*").withColumn("p", p)


def observe_alleles(reads: DataFrame, variants: DataFrame, pair_aware: bool = True) -> DataFrame:
    """What each read says about each variant over the variant's own span, a row per pair that overlap.

    variants: contig, pos, ref, alt, components, and keys (kept). Added:
    molecule, read_id, is_reverse; anchor_q (quality at pos, null if unaligned);
    seen and quality over the REF span (every base aligned or deleted, at least
    one base read; skipped ones are not observed); whole: as far as one base
    behind where an indel needs it; shows: the bases over the REF span are ALT;
    runs_on: the deletion goes on behind REF; carries: every component is there.
    """
    own = reads.withColumn("molecule", molecule_key(pair_aware)).withColumn("is_reverse", F.col("flag").bitwiseAND(REVERSE) != 0).withColumn("_ops", cigar_ops(F.col("cigar"), F.col("start")))
    last = F.element_at("_ops", -1)
    own = own.withColumn("_end", last["r0"] + F.when(last["op"].isin("M", "=", "X", "D", "N"), last["n"]).otherwise(0) - 1)
    own = own.select(F.col("contig").alias("_rc"), F.col("start").alias("_start"), "_end", "_ops", "seq", F.nullif("qual", F.lit("*")).alias("qual"), "molecule", "read_id", "is_reverse")
    span = variants.withColumn("_n", F.length("ref")).withColumn("_x", observed_span(F.col("ref"), F.col("components"))).withColumn("_to", F.col("pos") + F.col("_x") - 1)
    rows = interval_join(span, own.withColumnRenamed("_rc", "contig"), "contig", "pos", "_to", "_start", "_end")
    ops = F.col("_ops")
    phred = lambda q, n: F.when(F.col("qual").isNull(), F.lit(MAX_QUALITY)).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substr("qual", q + i, F.lit(1))) - 33)))

    def at(p: Column) -> Column:
        hit = F.get(F.filter(ops, lambda x: x["op"].isin("M", "=", "X") & p.between(x["r0"], x["r0"] + x["n"] - 1)), F.lit(0))
        gone = F.exists(ops, lambda x: (x["op"] == "D") & p.between(x["r0"], x["r0"] + x["n"] - 1))
        put = F.get(F.filter(ops, lambda x: (x["op"] == "I") & (x["r0"] == p + 1)), F.lit(0))
        return F.struct(p.alias("p"), (hit["q0"] + (p - hit["r0"]).cast("int")).alias("q"), (gone & hit.isNull()).alias("gone"), put["q0"].alias("iq"), put["n"].alias("n"))

    def read(x: Column) -> Column:
        base = F.upper(F.substr("seq", x["q"] + 1, F.lit(1)))
        return F.struct(x["p"].alias("p"), base.alias("base"), x["gone"].alias("gone"), F.upper(F.substr("seq", x["iq"] + 1, x["n"])).alias("put"), F.when(x["q"].isNotNull(), phred(x["q"], F.lit(1))).alias("q"), F.when(x["iq"].isNotNull(), phred(x["iq"], x["n"])).alias("iq"))

    rows = rows.withColumn("_o", F.transform(F.transform(F.sequence(F.col("pos").cast("long"), F.col("_to").cast("long")), at), read)).drop("_ops", "seq", "qual")
    part = lambda n: F.slice("_o", F.lit(1), n)
    known = lambda n: F.forall(part(n), lambda x: x["base"].isNotNull() | x["gone"]) & F.exists(part(n), lambda x: x["base"].isNotNull() | x["put"].isNotNull())
    worst = lambda n: F.array_min(F.transform(part(n), lambda x: F.least(x["q"], x["iq"])))
    text = F.array_join(F.transform(part(F.col("_n")), lambda x: F.concat(F.coalesce(x["base"], F.lit("")), F.coalesce(x["put"], F.lit("")))), "")
    one = lambda c, f: F.exists("_o", lambda x: (x["p"] == c["pos"]) & F.coalesce(f(x), F.lit(False)))
    has = lambda c: (
        F.when(c["kind"] == "SNV", one(c, lambda x: x["base"] == F.upper(c["alt"])))
        .when(c["kind"] == "INS", one(c, lambda x: x["put"] == F.upper(c["alt"])))
        .when(c["kind"] == "DEL", F.size(F.filter("_o", lambda x: x["gone"] & x["p"].between(c["pos"], c["pos"] + F.length(c["ref"]) - 1))) == F.length(c["ref"]))
        .otherwise(c["kind"] == "DELINS")
    )
    return rows.select(
        *variants.columns,
        "molecule",
        "read_id",
        "is_reverse",
        F.get("_o", F.lit(0))["q"].alias("anchor_q"),
        known(F.col("_n")).alias("seen"),
        worst(F.col("_n")).alias("quality"),
        known(F.col("_x")).alias("whole"),
        worst(F.col("_x")).alias("whole_quality"),
        (text == F.upper("alt")).alias("shows"),
        ((F.col("_x") > F.col("_n")) & F.coalesce(F.get("_o", F.col("_n"))["gone"], F.lit(False))).alias("runs_on"),
        F.forall("components", has).alias("carries"),
    )


def indel_support(observed: DataFrame, keys: list[str], min_quality: int = 20, anchor_depth: bool = True) -> DataFrame:
    """Per indel of observe_alleles: molecules that show exactly it, by strand, and depth (by the anchor base, or by the whole REF span).

    A molecule any of whose records sees the whole allele and shows another is no support.
    """
    good = F.col("seen") & (F.col("quality") >= min_quality)
    supports = good & F.col("shows") & F.col("carries") & ~F.col("runs_on")
    covers = F.coalesce(F.col("anchor_q") >= min_quality, F.lit(False)) if anchor_depth else good
    per = observed.withColumn("_s", F.coalesce(supports, F.lit(False))).withColumn("_c", F.coalesce(covers, F.lit(False))).withColumn("_g", F.coalesce(good & F.col("whole"), F.lit(False)))
    per = per.groupBy(*keys, "molecule").agg(F.max("_s").alias("s"), F.max(F.col("_g") & ~F.col("_s")).alias("against"), F.max("_c").alias("c"), F.max(F.col("_s") & ~F.col("is_reverse")).alias("f"), F.max(F.col("_s") & F.col("is_reverse")).alias("r"))
    ok = F.col("s") & ~F.col("against")
    n = lambda c: F.count(F.when(c, 1))
    out = per.groupBy(*keys).agg(n(ok).alias("event_reads"), n(ok & F.col("f")).alias("event_forward"), n(ok & F.col("r")).alias("event_reverse"), n(F.col("c")).alias("event_depth"))
    return out.withColumn("event_freq", F.when(F.col("event_depth") > 0, F.col("event_reads") / F.col("event_depth")))


def indel_molecules(observed: DataFrame, keys: list[str], min_quality: int = 20) -> DataFrame:
    """Per indel and molecule that sees its whole allele: supports. Molecules whose records disagree are left out."""
    rows = observed.where(F.col("seen") & F.col("whole") & (F.col("quality") >= min_quality))
    return rows.groupBy(*keys, "molecule").agg(F.min("shows").alias("_lo"), F.max("shows").alias("supports")).where("_lo = supports").drop("_lo")


def snv_carriers(sites: DataFrame, snvs: DataFrame, min_quality: int = 20) -> DataFrame:
    """contig, pos, alt, molecule: molecules that show an SNV's alternate at the quality, in all of their records that show anything there."""
    rows = sites.where(F.col("quality") >= min_quality).join(snvs.select("contig", "pos", "alt"), ["contig", "pos"])
    return rows.groupBy("contig", "pos", "alt", "molecule").agg(F.min(F.upper("base") == F.upper("alt")).alias("_all")).where("_all").drop("_all")


def local_haplotypes(observed: DataFrame, members: DataFrame, keys: list[str], min_quality: int = 20) -> DataFrame:
    """Per window (keys) and combination of its members: pattern (0/1 by idx), molecules, forward, reverse.

    members: keys, contig, pos, ref, alt, idx (from 0), n. A molecule counts if
    its records saw every member, none of them differently; a strand counts if
    a record on it saw every member.
    """
    variant = ["contig", "pos", "ref", "alt"]
    seen = observed.where(F.col("whole") & (F.col("whole_quality") >= min_quality)).select(*variant, "molecule", "read_id", "is_reverse", "carries")
    rows = members.select(*keys, *variant, "idx", "n").join(seen, variant)
    record = rows.groupBy(*keys, "n", "molecule", "read_id", "is_reverse").agg(F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("idx", "carries")).alias("c"))
    every = F.col("k") == F.col("n")
    molecule = record.groupBy(*keys, "n", "molecule").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("c"), F.max(every & ~F.col("is_reverse")).alias("f"), F.max(every & F.col("is_reverse")).alias("r"))
    # one entry a member: all seen, none both ways
    whole = molecule.where((F.size("c") == F.col("n")) & (F.size(F.array_distinct(F.transform("c", lambda x: x["idx"]))) == F.col("n")))
    pattern = F.array_join(F.transform("c", lambda x: x["carries"].cast("int").cast("string")), "")
    n = lambda c: F.count(F.when(c, 1))
    return whole.groupBy(*keys, "n", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("molecules"), n(F.col("f")).alias("forward"), n(F.col("r")).alias("reverse"))


def phase_verdict(cis: Column, informative: Column, least: int = 2, trans_share: float = 0.1) -> Column:
    """trans, cis or unknown from the molecules that carry an SNV and span an indel."""
    return F.when(informative < least, "unknown").when(cis <= trans_share * informative, "trans").otherwise("cis")


def indel_snv_linkage(indel_molecules: DataFrame, snv_molecules: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per (indel, SNV) pair: informative and cis molecules and verdict.

    indel_molecules: indel_id, molecule, supports; snv_molecules: snv_id,
    molecule (carriers); pairs: keys incl. indel_id, snv_id, near each other.
    """
    rows = pairs.join(snv_molecules, "snv_id").join(indel_molecules, ["indel_id", "molecule"])
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("informative"), F.count(F.when(F.col("supports"), 1)).alias("cis"))
    every = pairs.select(*keys).join(out, keys, "left").withColumn("informative", F.coalesce("informative", F.lit(0))).withColumn("cis", F.coalesce("cis", F.lit(0)))
    return every.withColumn("verdict", phase_verdict(F.col("cis"), F.col("informative")))


def mnv_strand_bias(support: DataFrame) -> DataFrame:
    """mnv_support with strand_bias_p: haplotype against other spanning molecules, by strand."""
    other = [F.greatest(F.col(f"mnv_depth_{s}") - F.col(f"mnv_{s}"), F.lit(0)) for s in ("forward", "reverse")]
    return support.withColumn("strand_bias_p", fisher_exact(F.col("mnv_forward"), F.col("mnv_reverse"), *other))


def read_classes(observed: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """What each read shows of a haplotype: mnv (every alternate), partial (some), reference (none, all sites as the reference), other; a row per read that sees a site.

    members: keys, contig, pos, ref, alt, n.
    """
    rows = members.join(observed, ["contig", "pos"])
    hit, same = F.upper("base") == F.upper("alt"), F.upper("base") == F.upper("ref")
    per = rows.groupBy(*keys, "n", "read_id", "molecule", "is_reverse").agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(hit, 1)).alias("alts"), F.count(F.when(same, 1)).alias("refs"))
    kind = F.when(F.col("alts") == F.col("n"), "mnv").when(F.col("alts") > 0, "partial").when(F.col("refs") == F.col("seen"), "reference").otherwise("other")
    return per.withColumn("class", kind)


def shown_reads(classes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` reads of each haplotype for a display, the classes taking turns: shown numbers them."""
    rank = F.when(F.col("class") == "mnv", 0).when(F.col("class") == "partial", 1).when(F.col("class") == "reference", 2).otherwise(3)
    turn = F.row_number().over(Window.partitionBy(*keys, "class").orderBy("read_id"))
    rows = classes.withColumn("_turn", turn).withColumn("_rank", rank)
    return rows.withColumn("shown", F.row_number().over(Window.partitionBy(*keys).orderBy("_turn", "_rank"))).where(F.col("shown") <= most).drop("_turn", "_rank")


def top_haplotypes(counts: DataFrame, keys: list[str], limit: int = 64) -> DataFrame:
    """The most frequent patterns of each window, ties by pattern."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("molecules"), "pattern"))
    return counts.withColumn("place", place).where(F.col("place") <= limit)
