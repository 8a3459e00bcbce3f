"""Secret scan with corpus-wide ownership frequency.

Every text is searched for base patterns (assignments, access keys, long hex
runs) and for a wider candidate pattern (long tokens that mix letters and
digits, have the entropy of a random value and hold a long unbroken run, so
that paths and identifiers of short words are none). Only hashes of the
candidates are kept. They are aggregated over the corpus by distinct owners,
distinct repositories and rows: a value that several owners hold, or several
repositories of one owner, or many rows, is a copied example; one that is
specific to an owner looks live. Base findings always stay; of the wider
candidates, the live-looking ones are added as kind "live".

Only DataFrame functions are used: a pattern's matches and the gaps between
them (split by the same pattern) give positions by a running sum in each text.

Defined results: a null text is empty and has no spans; a null owner or
repository is an owner or repository of its own; rows that repeat a doc_id are
scanned each for itself; positions count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, skew_safe_join

#: Kind, pattern, group that holds the value, least length of the value, in the order of the contract.
#: For access and hex the least length is in the pattern: a match starts where a maximal run does, so this finds
#: exactly the runs that pass, without an array entry for every short run in prose.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The wider candidates: at least this many characters with a letter and a digit.
WIDE = ("live", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: Live-looking candidates: least entropy in bits a character, least length of an unbroken run that mixes letters and digits.
ENTROPY, RUN = 3.0, 16
#: A cheap test that no text with a match fails, so that most texts are never split.
PROBE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "live": r"[A-Za-z0-9+/_=-]{20}",
}
KINDS = tuple(k for k, *_ in (*BASE, WIDE))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters of a text, bits a character, rounded."""
    n = F.length(value).cast("double")
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n
    return F.round(F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, c: a - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0)), 6)


def looks_random(value: Column) -> Column:
    """Entropy and an unbroken run as a generated value has them."""
    run = F.exists(F.split(value, "[/_-]"), lambda x: (F.length(x) >= RUN) & x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
    return run & (entropy(value) >= ENTROPY)


def _hits(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (gap, length, value) of all matches; gap: code points since the last match."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    found = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("len"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.expr("cast(array() as array<struct<gap:int,len:int,value:string>>)")
    probe = F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(PROBE[kind]))
    return F.when(probe, found).otherwise(none)


def candidates(docs: DataFrame, owner: str, repositories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row per document with its row number, and a span per candidate with position and hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("k"), F.lit(least).alias("least"), _hits(text, k, p, g).alias("hits")) for i, (k, p, g, least) in enumerate((*BASE, WIDE))))
    own = F.xxhash64(F.lit("o"), F.col(owner).isNull(), F.col(owner)).alias("owner")
    repo = F.xxhash64(F.lit("r"), *(x for c in (owner, *repositories) for x in (F.col(c).isNull(), F.col(c)))).alias("repo")
    table = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), own, repo, F.filter(every, lambda x: F.size(x["hits"]) > 0).alias("found")), "secrets")
    rows = table.select("doc_id", "rid")
    one = table.where(F.size("found") > 0).select("rid", "owner", "repo", F.explode("found").alias("f"))
    one = one.select("rid", "owner", "repo", "f.kind", "f.k", "f.least", F.posexplode("f.hits").alias("i", "h"))
    each = Window.partitionBy("rid", "k").orderBy("i")
    end = F.sum(F.col("h.gap") + F.col("h.len")).over(each)
    value = F.col("h.value")
    spans = one.withColumn("end", end).select("rid", "owner", "repo", "kind", "k", (F.col("end") - F.col("h.len")).alias("start"), "end", F.sha2(value, 256).alias("hash"), (F.length(value) >= F.col("least")).alias("ok"), ((F.col("kind") != "live") | looks_random(value)).alias("mixed"))
    spans = spans.where("ok and mixed").drop("ok", "mixed")
    # a wide candidate that a base finding of the same text overlaps is the same secret: the base one speaks for it
    base_end = F.max(F.when(F.col("kind") != "live", F.col("end"))).over(Window.partitionBy("rid").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, 0))
    next_base = F.min(F.when(F.col("kind") != "live", F.col("start"))).over(Window.partitionBy("rid").orderBy("start", "k").rowsBetween(0, Window.unboundedFollowing))
    spans = spans.withColumn("be", base_end).withColumn("nb", next_base).where("kind <> 'live' or (coalesce(be, 0) <= start and coalesce(nb, end) >= end)").drop("be", "nb")
    return rows, materialize(spans, "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """Per hash: n_owners, n_repos, n_rows; every step adds up in the tasks first, so a hash of a third of all rows costs a row a task."""
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def scan_secrets(docs: DataFrame, owner: str = "source", repositories: tuple[str, ...] = ("lang",), live_owners: int = 1, live_repos: int = 2, live_rows: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live_looking, n_copied.

    n_live_looking counts base and added findings that at most live_owners
    owners, live_repos repositories and live_rows findings hold, n_copied the
    base findings that more hold.
    """
    rows, spans = candidates(docs, owner, list(repositories))
    freq = materialize(ownership(spans), "ownership")
    judged = skew_safe_join(spans, freq, "hash", "n_rows", total=spans.count()).withColumn("live", (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos) & (F.col("n_rows") <= live_rows))
    judged = judged.where("kind <> 'live' or live")
    at = F.struct("start", "k", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    count = lambda what: F.count(F.when(what, 1))
    per = judged.groupBy("rid").agg(
        *(count(F.col("kind") == k).alias(f"n_{k}") for k, *_ in BASE),
        F.sort_array(F.collect_list(at)).alias("all"),
        count(F.col("live")).alias("n_live_looking"),
        count(~F.col("live")).alias("n_copied"),
    )
    joined = rows.join(per, "rid", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,k:int,s:string>>)")
    every = F.coalesce("all", none)
    names = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), ",")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id",
        *(zero(f"n_{k}") for k, *_ in BASE),
        F.sha2(names(F.filter(every, lambda x: x["k"] < len(BASE))), 256).alias("base_sha256"),
        names(every).alias("spans"),
        zero("n_live_looking"),
        zero("n_copied"),
    )
