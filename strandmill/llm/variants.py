"""Spelling variant grouping: near words are found by asymmetric q-chunks, each word's form is its most frequent near word.

Of two near words the shorter one (or either, if they are as long) gives two
disjoint chunks, its halves; the other gives its positional grams of that
length. One edit lies within one half, so the other half is kept, at the same
place or, behind an insertion, one place on. So a gram can only meet a chunk
within a shift of one, and the grams that can are the ones that are made.

A key (length, chunk, place) that more than MOST_ROWS words share isn't met pair
by pair: what is left of its words is split into two chunks again, and the same
argument holds for the rest. This ends where the rest is one character, when
every pair of a key is a pair of near words. So no key makes more than
MOST_ROWS squared pairs, or as many as its true pairs, and none is left out.
What shares a key is verified by edit distance.

Defined results: null text has no words; a null doc_id counts as empty in the
hash; repeated rows count as often as they occur; runs of any length take part;
an empty table gives no words; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, skew_safe_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run, shortest word, rows of a key that are met pair by pair.
LETTERS, SHORTEST, MOST_ROWS = r"A-Za-zÀ-ÿ", 7, 32


def lower_ascii(word: Column) -> Column:
    """A-Z folded; most words hold none and stay as they are."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, UPPER, LOWER))


def dropped_letter(doc_id: Column, run: Column, every: int = 31) -> Column:
    """run, without one code point where the crc32 of doc_id:run is a multiple of every."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, every: int = 31) -> DataFrame:
    """word, n: words of at least shortest code points that occur least times. Runs below shortest can't become words and aren't read out."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    runs = docs.select(F.col("doc_id"), F.explode(found).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    words = runs.select(dropped_letter(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame, parts: int) -> DataFrame:
    """rows (word, n, longer, size, part) with key: the word without the part-th of parts pieces, at its length.

    size is the length of the word that gives the chunks. The grams of a word
    that is one longer leave out one character more and lie one place on behind it.
    """
    lo, hi = F.floor(F.col("part") * F.col("size") / parts), F.floor((F.col("part") + 1) * F.col("size") / parts)
    before = F.substr("word", F.lit(1), lo.cast("int"))
    after = F.substr("word", (hi + 1 + F.col("longer").cast("int")).cast("int"))
    return rows.withColumn("key", F.xxhash64("size", "part", before, after))


def near_words(words: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """a, an, b, bn: each unordered pair of words (word, n; a written table without repeated words) that differ by one inserted, deleted or replaced code point, once."""
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    rows = both.withColumn("size", F.length("word") - F.col("longer").cast("int")).withColumn("part", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    found, parts = [], 2
    while True:
        keyed = _keyed(rows, parts)
        own = F.sum(F.when(~F.col("longer"), 1).otherwise(0))
        index = materialize(keyed.groupBy("key").agg(F.count("*").alias("rows"), own.alias("own")).where("rows > 1 and own > 0").drop("own"), "chunk-keys")
        sized = materialize(skew_safe_join(keyed, index, "key", "rows", how="inner"), "chunks")
        small = (F.col("rows") <= most_rows) | (F.col("size") <= parts)
        met = sized.where(small)
        a, b = met.where(~F.col("longer")).alias("a"), met.alias("b")
        on = (F.col("a.key") == F.col("b.key")) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word"))) & (F.levenshtein("a.word", "b.word", 1) == 1)
        found.append(a.join(b, on).select(F.col("a.word").alias("a"), F.col("a.n").alias("an"), F.col("b.word").alias("b"), F.col("b.n").alias("bn")))
        rest = sized.where(~small)
        if rest.isEmpty():
            break
        half = F.explode(F.array(2 * F.col("part"), 2 * F.col("part") + 1))
        rows, parts = rest.select("word", "n", "longer", "size", half.alias("part")), 2 * parts
    return reduce(DataFrame.unionByName, found).distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form) from each word. Each form is ratio times as frequent, so chains are short, and each step doubles what it follows."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        index = roots.groupBy("root").agg(F.count("*").alias("size")).join(step, "root", "inner")
        index = materialize(index, "root-steps")
        if index.isEmpty():
            return roots
        joined = skew_safe_join(roots, index, "root", "size")
        roots = materialize(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word. form: of the near words the most frequent one (ties: the smallest), if it is at least ratio times as frequent."""
    words = materialize(count_words(docs, shortest, least, every), "words")
    pairs = materialize(near_words(words), "near-words")
    ends = pairs.select("a", "an", "b", "bn").union(pairs.select("b", "bn", "a", "an"))
    near = ends.groupBy(F.col("a").alias("word")).agg(F.max("an").alias("wn"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("n"), F.col("b").alias("form"))).alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("wn")
    near = materialize(near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = follow_forms(near.where("form is not null").select("word", "form"))
    known = near.join(roots, "word", "left")
    out = words.join(known, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
