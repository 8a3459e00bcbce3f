"""Columns that decompose a REF/ALT pair into an event class and its components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.dna import count_to, let

COMPONENT = "struct<kind:string,pos:bigint,ref:string,alt:string>"
NONE = f"cast(array() as array<{COMPONENT}>)"


def _char(s: Column, i) -> Column:
    return F.substr(s, i, F.lit(1))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(count_to(n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.upper(_char(a, i)) == F.upper(_char(b, i))), i).otherwise(acc))


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """Common suffix of what follows the prefix in both."""
    n = F.least(F.length(a), F.length(b)) - prefix
    at = lambda s, i: _char(s, F.length(s) - i + 1)
    return F.aggregate(count_to(n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.upper(at(a, i)) == F.upper(at(b, i))), i).otherwise(acc))


def component(kind: str, pos: Column, ref: Column, alt: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pos.cast("bigint").alias("pos"), ref.alias("ref"), alt.alias("alt"))


def event_of(pos: Column, ref: Column, alt: Column) -> Column:
    """Struct of event_class, components, affected_start and affected_end of an allele."""

    def whole(x: Column) -> Column:
        return let(F.struct(x["p"].alias("p"), x["r"].alias("r"), x["a"].alias("a"), x["pre"].alias("pre"), common_suffix(x["r"], x["a"], x["pre"]).alias("suf")), cores)

    def cores(x: Column) -> Column:
        cut = lambda s: F.substr(s, x["pre"] + 1, F.length(s) - x["pre"] - x["suf"])
        return let(F.struct(x["p"].alias("p"), x["r"].alias("r"), x["a"].alias("a"), (x["p"] + x["pre"]).alias("at"), cut(x["r"]).alias("rc"), cut(x["a"]).alias("ac")), parts)

    def substitutions(x: Column, y: Column, start: Column, n: Column) -> Column:
        every = F.transform(count_to(n), lambda i: component("SNV", start + i - 1, _char(x, i), _char(y, i)))
        return F.filter(every, lambda c: F.upper(c["ref"]) != F.upper(c["alt"]))

    def parts(x: Column) -> Column:
        p, r, a, at, rc, ac = (x[k] for k in ("p", "r", "a", "at", "rc", "ac"))
        core = F.least(F.length(rc), F.length(ac))
        tail = F.when(F.length(rc) > core, F.array(component("DEL", at + core, F.substr(rc, core + 1, F.length(rc) - core), F.lit("")))).otherwise(
            F.array(component("INS", at + F.greatest(core - 1, F.lit(0)), F.lit(""), F.substr(ac, core + 1, F.length(ac) - core)))
        )
        found = (
            F.when(a.rlike("^<.*>$"), F.array(component("SYMBOLIC", p, r, a)))
            .when(F.length(r) == F.length(a), substitutions(r, a, p, F.length(r)))
            .when(F.length(rc) == 0, F.array(component("INS", at - 1, F.lit(""), ac)))
            .when(F.length(ac) == 0, F.array(component("DEL", at, rc, F.lit(""))))
            .otherwise(F.concat(substitutions(rc, ac, at, core), tail))
        )
        return let(F.struct(*(x[k].alias(k) for k in ("p", "r", "a", "at", "rc", "ac")), found.alias("c")), named)

    def named(x: Column) -> Column:
        p, r, a, at, rc, ac, c = (x[k] for k in ("p", "r", "a", "at", "rc", "ac", "c"))
        symbolic, equal = a.rlike("^<.*>$"), F.length(r) == F.length(a)
        n = F.size(F.filter(c, lambda k: k["kind"] == "SNV"))
        cls = (
            F.when(symbolic, "symbolic")
            .when(equal, F.when(n == 0, "reference").when(n == 1, "snp").otherwise("mnv"))
            .when(F.length(rc) == 0, "insertion")
            .when(F.length(ac) == 0, "deletion")
            .when(n > 0, "complex_indel")
            .otherwise("delins")
        )
        full = symbolic | equal | (F.length(rc) == 0)
        end = F.when(full, p + F.greatest(F.length(r) - 1, F.lit(0))).otherwise(at + F.greatest(F.length(rc) - 1, F.lit(0)))
        return F.struct(cls.alias("event_class"), c.alias("components"), F.when(full, p).otherwise(at).cast("bigint").alias("affected_start"), end.cast("bigint").alias("affected_end"))

    return let(F.struct(pos.cast("bigint").alias("p"), ref.alias("r"), alt.alias("a"), common_prefix(ref, alt).alias("pre")), whole)


def with_event(df, pos: str = "pos", ref: str = "ref", alt: str = "alt"):
    """df with event_class, components, affected_start and affected_end of each allele."""
    return df.withColumn("_event", event_of(F.col(pos), F.col(ref), F.col(alt))).select("*", "_event.*").drop("_event")


def substitution_components(components: Column) -> Column:
    """The components of an allele that is made of substitutions only, else none."""
    return F.when(F.forall(components, lambda c: c["kind"] == "SNV"), components).otherwise(F.expr(NONE))


def label(c: Column) -> Column:
    """Text of a component: SNV:p:R>A, INS:p:+S, DEL:p:S or DEL:p-q:S, others KIND:p:R>A."""
    pos, end = c["pos"].cast("string"), (c["pos"] + F.length(c["ref"]) - 1).cast("string")
    return (
        F.when(c["kind"] == "INS", F.concat(F.lit("INS:"), pos, F.lit(":+"), c["alt"]))
        .when(c["kind"] == "DEL", F.concat(F.lit("DEL:"), pos, F.when(F.length(c["ref"]) > 1, F.concat(F.lit("-"), end)).otherwise(""), F.lit(":"), c["ref"]))
        .otherwise(F.concat(c["kind"], F.lit(":"), pos, F.lit(":"), c["ref"], F.lit(">"), c["alt"]))
    )


def labels(components: Column, sep: str = " | ") -> Column:
    return F.array_join(F.transform(components, label), sep)


def parse_label(text: Column) -> Column:
    """The component that a label describes."""
    kind = F.regexp_extract(text, r"^([A-Z]+):", 1)
    pos = F.regexp_extract(text, r"^[A-Z]+:(\d+)", 1).cast("bigint")
    rest = F.regexp_extract(text, r"^[A-Z]+:\d+(?:-\d+)?:(.*)$", 1)
    ref = F.when(kind == "INS", "").when(kind == "DEL", rest).otherwise(F.regexp_extract(rest, r"^(.*?)>", 1))
    alt = F.when(kind == "INS", F.regexp_extract(rest, r"^\+(.*)$", 1)).when(kind == "DEL", "").otherwise(F.regexp_extract(rest, r">(.*)$", 1))
    return F.struct(kind.alias("kind"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt"))


def changed_positions(components: Column, pos: Column) -> Column:
    """Sorted distinct positions that the components change: anchors, and whole deleted spans; pos where there are none."""
    spans = F.transform(components, lambda c: F.when(c["kind"].isin("DEL", "DELINS", "SYMBOLIC"), F.sequence(c["pos"], c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0)))).otherwise(F.array(c["pos"])))
    every = F.array_sort(F.array_distinct(F.flatten(spans)))
    return F.when(F.size(components) > 0, every).otherwise(F.array(pos.cast("bigint")))


def overlaps(c: Column, start: Column, end: Column) -> Column:
    """A component touches [start, end]: an insertion sits between its anchor and the next base, so the anchor must lie before the end."""
    last = c["pos"] + F.greatest(F.length(c["ref"]) - 1, F.lit(0))
    return F.when(c["kind"] == "INS", (c["pos"] >= start) & (c["pos"] < end)).otherwise((c["pos"] <= end) & (last >= start))


def observed_span(ref: Column, components: Column) -> Column:
    """Reference bases that must be seen to judge an allele: one more for insertions and deletions."""
    return F.length(ref) + F.when(F.exists(components, lambda c: c["kind"].isin("INS", "DEL")), 1).otherwise(0)


def normalise(df, pos: str = "pos", ref: str = "ref", alt: str = "alt"):
    """Trims shared suffix and prefix down to one base where the decomposition stays the same, else the prefix only, else nothing."""
    r, a = F.col(ref), F.col(alt)
    keep = F.least(F.length(r), F.length(a)) - 1
    suf = F.least(common_suffix(r, a, F.lit(0)), keep)
    df = df.withColumn("_s", suf)
    r1, a1 = F.substr(r, F.lit(1), F.length(r) - F.col("_s")), F.substr(a, F.lit(1), F.length(a) - F.col("_s"))
    df = df.withColumn("_r1", r1).withColumn("_a1", a1)
    cut = lambda x, y: F.least(common_prefix(x, y), F.least(F.length(x), F.length(y)) - 1)
    df = df.withColumn("_p1", cut(F.col("_r1"), F.col("_a1"))).withColumn("_p0", cut(r, a))
    both = df.withColumn("_pos2", F.col(pos) + F.col("_p1")).withColumn("_ref2", F.expr("substr(_r1, _p1 + 1)")).withColumn("_alt2", F.expr("substr(_a1, _p1 + 1)"))
    both = both.withColumn("_pos3", F.col(pos) + F.col("_p0")).withColumn("_ref3", F.expr(f"substr({ref}, _p0 + 1)")).withColumn("_alt3", F.expr(f"substr({alt}, _p0 + 1)"))

    text = lambda p, x, y: labels(event_of(F.col(p), F.col(x), F.col(y))["components"])
    d = both.withColumn("_l1", text(pos, ref, alt)).withColumn("_l2", text("_pos2", "_ref2", "_alt2")).withColumn("_l3", text("_pos3", "_ref3", "_alt3"))
    pick = lambda two, three, one: F.when(F.col("_l2") == F.col("_l1"), two).when(F.col("_l3") == F.col("_l1"), three).otherwise(one)
    d = d.withColumn("_np", pick(F.col("_pos2"), F.col("_pos3"), F.col(pos))).withColumn("_nr", pick(F.col("_ref2"), F.col("_ref3"), r)).withColumn("_na", pick(F.col("_alt2"), F.col("_alt3"), a))
    d = d.withColumn(pos, F.col("_np")).withColumn(ref, F.col("_nr")).withColumn(alt, F.col("_na"))
    return d.drop(*(c for c in d.columns if c.startswith("_")))
