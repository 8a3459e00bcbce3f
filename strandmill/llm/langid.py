"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character 1-, 2- and 3-grams (a word
boundary counts as a character); a text's own most frequent n-grams are
compared with every profile by the out-of-place distance: the sum of rank
differences, with a fixed penalty for n-grams that a profile lacks.

Profiles are learned from a bounded sample of labelled rows: TRAIN_DOCS a
language as expected number, drawn by a hash of the identifier, so that
training cost doesn't grow. Prediction uses whole texts.

Defined results: a text that is null or has no letter is "und" with score 0, as
is every text when nothing was learned; ties of distance go to the smaller
language name; null labels and null identifiers are not learned from; each row
is predicted by itself, so repeated rows agree. The score is 1 less the
distance over the largest possible distance, between 0 and 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import crc_bucket, held_out, map_batches, text_bytes

#: Expected number of sampled rows a language, n-grams of a profile and of a text, and languages at most.
TRAIN_DOCS, PROFILE, LANGUAGES = 4000, 400, 10_000
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"
BITS = 21
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: bytes | None) -> np.ndarray:
    """All 1-, 2- and 3-grams of a text as integers of BITS bits a character; 0x20 stands for a word boundary. Empty without a letter."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes[~letter] = 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([0x20], codes[keep], [0x20]))
    b = c == 0x20
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    return np.concatenate((c[~b], two[~(b[:-1] & b[1:])], three[~b[1:-1]]))


def ranked(ids: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent of ids, ties to the smaller."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    counts = np.diff(np.append(first, len(ids)))
    return ids[first][np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Sorted n-grams of all profiles and their rank in each language (PROFILE where it has none)."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.langs = sorted(ranks)
        self.known = np.unique(np.array([g for r in ranks.values() for g in r], np.int64))
        self.rank = np.full((len(self.langs), len(self.known) + 1), PROFILE, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.known, np.array(ranks[lang], np.int64))] = np.arange(len(ranks[lang]))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        ids = grams(text)
        if not len(ids) or not self.langs:
            return "und", 0.0
        top = ranked(ids)
        at = np.searchsorted(self.known, top)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == top, at, len(self.known))
        rank = self.rank[:, at]
        out = np.where(rank < PROFILE, np.abs(rank - np.arange(len(top))), PROFILE).sum(1)
        best = int(out.argmin())
        return self.langs[best], 1.0 - float(out[best]) / (PROFILE * len(top))


def learn(docs: DataFrame, folds: int = 5, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles from docs whose crc32(doc_id) modulo folds is not 0 and whose lang is not null (folds 0: from all with a lang)."""
    usable = docs.where(F.col("lang").isNotNull() & ((crc_bucket(F.col("doc_id"), folds) != 0) if folds else F.lit(True)))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Profiles({})
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, train_docs / r.n)) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches):
        seen: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
                ids, n = np.unique(grams(text), return_counts=True)
                seen.setdefault(lang, []).append((ids, n))
                if len(seen[lang]) >= 64:
                    seen[lang] = [_added(seen[lang])]
        for lang, parts in seen.items():
            ids, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(n)], names=["lang", "gram", "n"])

    counts = map_batches(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranks: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect():
        ranks.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranks)


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    ids, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def task(batches):
        for batch in batches:
            said = [profiles.predict(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], schema=OUT)

    out = held_out(F.col("doc_id"), folds) if folds else F.lit(False)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text"), task, OUT_DDL)


def language_id(docs: DataFrame, folds: int = 5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    return identify(docs, learn(docs, folds, train_docs), folds)


def keep_identified(docs: DataFrame, least: float = 0.0, folds: int = 5) -> DataFrame:
    """docs whose language is recognised with a score above least, columns as they were; a null lang is filled with the prediction."""
    profiles, schema = learn(docs, folds), docs.schema

    def task(batches):
        for batch in batches:
            said = [profiles.predict(t) for t in text_bytes(batch.column("text"))]
            keep = pa.array([s[0] != "und" and s[1] > least for s in said])
            lang = pc.coalesce(batch.column("lang"), pa.array([s[0] for s in said], batch.schema.field("lang").type))
            yield batch.set_column(batch.schema.get_field_index("lang"), batch.schema.field("lang"), lang).filter(keep)

    return map_batches(docs, task, schema)
