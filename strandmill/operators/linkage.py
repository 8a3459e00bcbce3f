"""What reads say of upstream indels and a codon's SNVs: the frequency of each indel, and whether one molecule carries both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import reads
from strandmill.operators.intervals import interval_join
from strandmill.scratch import materialize

ALLELE = ["contig", "pos", "ref", "alt"]
#: Bases between an indel and an SNV beyond which reads aren't asked.
LINK_BASES = 600
#: Order of verdicts: the first one that any SNV of a codon gets is the codon's.
VERDICTS = ("trans", "cis", "unknown")


@dataclass(frozen=True)
class Evidence:
    """observed: ALLELE, observed (frequency of an indel, null without depth). pairs: contig, ipos, iref, ialt, spos, salt, verdict, cis, informative."""

    observed: DataFrame
    pairs: DataFrame


def indel_evidence(indels: DataFrame, snvs: DataFrame, aligned: DataFrame, quality: int = 20, min_mapq: int = 0, pair_aware: bool = True) -> Evidence:
    """Evidence of aligned reads on indels (ALLELE, components; symbolic ones aren't asked for) and SNVs (ALLELE) within LINK_BASES of them."""
    use = reads.usable(aligned, min_mapq)
    spelled = indels.where(~F.col("alt").startswith("<"))
    views = materialize(reads.observe_alleles(use, spelled.select(*ALLELE, "components").dropDuplicates(ALLELE), pair_aware), "indel-views")
    observed = reads.indel_support(views, ALLELE, quality).select(*ALLELE, F.col("event_freq").alias("observed"))
    near = spelled.select("contig", F.col("pos").alias("ipos"), F.col("ref").alias("iref"), F.col("alt").alias("ialt")).distinct()
    near = near.withColumn("_lo", F.greatest(F.col("ipos") - LINK_BASES, F.lit(1))).withColumn("_hi", F.col("ipos") + LINK_BASES)
    sites = snvs.select(*ALLELE).distinct().withColumn("_p", F.col("pos"))
    pairs = interval_join(sites, near, "contig", "pos", "_p", "_lo", "_hi").select("contig", "ipos", "iref", "ialt", F.col("pos").alias("spos"), F.col("alt").alias("salt"))
    pairs = materialize(pairs, "linked-pairs")
    asked = pairs.select("contig", F.col("spos").alias("pos"), F.col("salt").alias("alt")).distinct()
    carriers = reads.snv_carriers(reads.observe_sites(use, asked.select("contig", "pos").distinct(), pair_aware), asked, quality)
    indel, snv = F.struct("contig", "ipos", "iref", "ialt"), F.struct("contig", "spos", "salt")
    shown = reads.indel_molecules(views, ALLELE, quality).select(F.struct("contig", F.col("pos").alias("ipos"), F.col("ref").alias("iref"), F.col("alt").alias("ialt")).alias("indel_id"), "molecule", "supports")
    held = carriers.select(F.struct("contig", F.col("pos").alias("spos"), F.col("alt").alias("salt")).alias("snv_id"), "molecule")
    told = reads.indel_snv_linkage(shown, held, pairs.select(indel.alias("indel_id"), snv.alias("snv_id")), ["indel_id", "snv_id"])
    told = told.select("indel_id.*", "snv_id.spos", "snv_id.salt", "verdict", "cis", "informative")
    return Evidence(observed, materialize(told, "linkage"))


def codon_linkage(rows: DataFrame, upstream: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per codon row (gene_id, codon_start, snvs): trans_shift, the summed deltas of upstream indels that some SNV of the row is in trans with, and frameshift_phasing.

    rows: contig, gene_id, codon_start, snvs, place. upstream: gene_id, ALLELE,
    order (the indel is upstream of a row if below its place), delta; those that
    pass the gate. Of the SNVs of a row the one with the first verdict (trans,
    cis, unknown) and the fewest cis molecules speaks for the indel; the text
    lists an entry an indel, by position.
    """
    one = rows.select("contig", "gene_id", "codon_start", "snvs", "place", F.explode("snvs").alias("s"))
    one = one.select("contig", "gene_id", "codon_start", "snvs", "place", F.col("s.pos").alias("spos"), F.upper("s.alt").alias("salt")).distinct()
    rank = F.when(F.col("verdict") == VERDICTS[0], 0).when(F.col("verdict") == VERDICTS[1], 1).otherwise(2)
    asked = pairs.select("contig", "ipos", "iref", "ialt", "spos", F.upper("salt").alias("salt"), F.struct(rank.alias("rank"), "cis", "informative").alias("said"))
    own = upstream.select("gene_id", F.col("pos").alias("ipos"), F.col("ref").alias("iref"), F.col("alt").alias("ialt"), "order", "delta")
    met = one.join(asked, ["contig", "spos", "salt"]).join(own, ["gene_id", "ipos", "iref", "ialt"]).where("order < place")
    each = met.groupBy("gene_id", "codon_start", "snvs", "ipos", "iref", "ialt", "delta").agg(F.min("said").alias("said"))
    name = F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("said.rank") + 1)
    text = F.format_string("%s:%d:%d/%d", name, F.col("ipos"), F.col("said.cis"), F.col("said.informative"))
    entries = F.array_sort(F.collect_list(F.struct("ipos", "iref", "ialt", text.alias("text"))))
    out = each.groupBy("gene_id", "codon_start", "snvs").agg(F.sum(F.when(F.col("said.rank") == 0, F.coalesce("delta", F.lit(0))).otherwise(0)).alias("trans_shift"), entries.alias("e"))
    return out.withColumn("frameshift_phasing", F.array_join(F.transform("e", lambda x: x["text"]), " | ")).drop("e")
