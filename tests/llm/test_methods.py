"""Methods held against plain-Python versions: tag-path ratios, out-of-place distances, and the pipeline on odd tables."""

import math
import os
import random
import re
from collections import Counter

import pytest
from strandmill.llm import html_text, langid

SAID = "The first long paragraph, with several commas, says what the page is about. It goes on for a while, as texts do."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class=post><p>{SAID}</p><p>{SAID}</p></div><div class="user-comments"><p>I liked it, really, a lot.</p></div><div class="reader-comments"><div><p>Me too, thanks.</p></div></div>', f"{SAID}\n\n{SAID}"),
        (f'<div class="post comment-open"><p>{SAID}</p><p>{SAID}</p></div>', f"{SAID}\n\n{SAID}"),
        (f"<div class=post><p>{SAID}</p><p>{SAID}</p></div><div>Copyright 2024 Example Inc. All rights reserved.</div>", f"{SAID}\n\n{SAID}"),
        (f"<article><p>{SAID}</p><p>All rights reserved.</p></article>", f"{SAID}\n\nAll rights reserved."),
        (f"<div class=a><p>{SAID}</p><p>{SAID}</p></div><div class=b><h3>Later</h3><p class=z>Short line.</p></div>", f"{SAID}\n\n{SAID}\n\nLater\n\nShort line."),
        ("<p>Click <button>Go</button> now, please.</p>", "Click now, please."),
        (f"<div><p>{SAID} <select><option>a<option>b</select> End.</p></div>", f"{SAID} End."),
        (f"<p>{SAID}</p><button>never closed", SAID),
    ],
)
def test_html_cases(page, want):
    assert html_text.extract(page) == want


def plain_ratios(found):
    """Per path: means of text outside links and of punctuation, smoothed over blocks within two places, multiplied."""
    of = lambda f: {p: sum(f(b) for b in found if b.node.path == p) / sum(b.node.path == p for b in found) for p in {b.node.path for b in found}}
    out = None
    for f, floor in ((lambda b: b.plain, 0.0), (lambda b: sum(c in ".,;:!?。、，！？" for c in b.text), 0.1)):
        ratio, smooth = of(f), []
        for i in range(len(found)):
            near = [(math.exp(-((j - i) ** 2) / (2 * html_text.SIGMA**2)), ratio[found[j].node.path]) for j in range(max(0, i - 2), min(len(found), i + 3))]
            smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        mean = {p: sum(s for s, b in zip(smooth, found) if b.node.path == p) / sum(b.node.path == p for b in found) + floor for p in ratio}
        out = mean if out is None else {p: out[p] * mean[p] for p in mean}
    return out


def test_ratios_against_plain_python():
    rng = random.Random(4)
    for _ in range(30):
        tags = ["<p>", "<li>", "<div class=x>", "<h2>", "<td>"]
        page = "".join(f"{rng.choice(tags)}{'word, ' * rng.randrange(9)}{'<a href=x>link text</a>' * rng.randrange(2)}." for _ in range(rng.randrange(1, 40)))
        found = html_text.blocks(page)
        got, want = html_text.fused_ratios(found), plain_ratios(found)
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in got)
        least = html_text.THRESHOLD * sum(want[b.node.path] for b in found) / len(found)
        assert html_text.content_paths(found) == ({p for p, x in want.items() if x >= least and x > 0} or set(want))


def plain_grams(text):
    """1- to 3-grams of letters with one mark between words and at both ends."""
    marked = re.sub(r"\0+", "\0", "".join(c if c.isalpha() else "\0" for c in text.lower()))
    if not marked.strip("\0"):
        return []
    marked = "\0" + marked.strip("\0") + "\0"
    every = [marked[i : i + k] for k in (1, 2, 3) for i in range(len(marked) - k + 1)]
    return [g for g in every if g != "\0" and not (len(g) == 3 and g[1] == "\0")]


def plain_profile(n):
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], sum((ord(c) if c != "\0" else 0x20) << (langid.BITS * (len(x[0]) - 1 - i)) for i, c in enumerate(x[0]))))][: langid.PROFILE]


def test_language_against_plain_python(spark):
    """Predictions equal those of a plain out-of-place distance, and nearly all held-out texts of the given table are right."""
    at = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("needs the given tables")
    docs = spark.read.parquet(at)
    got = {r.doc_id: r for r in langid.language_id(docs, folds=5).collect()}
    rows, counts = docs.collect(), {}
    for r in rows:
        if not got[r.doc_id].held_out and r.lang is not None and r.text:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    rank = {lang: {g: i for i, g in enumerate(plain_profile(n))} for lang, n in counts.items()}
    right = total = 0
    for r in rows:
        own = plain_profile(Counter(plain_grams(r.text or "")))
        if not own:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        far = {lang: sum(abs(k[g] - i) if g in k else langid.PROFILE for i, g in enumerate(own)) for lang, k in rank.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id].lang_pred == best and math.isclose(got[r.doc_id].score, 1 - far[best] / (langid.PROFILE * len(own)), rel_tol=1e-9)
        if got[r.doc_id].held_out and len((r.text or "").split()) >= 20:
            total += 1
            right += best == r.lang
    assert total > 10 and right >= 0.97 * total


def plain_near(texts):
    words = {i: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for i, w in words.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i in texts if root[i] == i}


PIPE_DDL = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, th long, size long, __key string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    base = [f"wort{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 30))):
            w[rng.randrange(120)] = f"neu{rng.randrange(9)}"
        rows.append((i, " ".join(w), "de", rng.choice(["a", "b", None])))
    rows += [(50, "one two three four five six", "en", "a")] * 3 + [(None, "no name here at all", "en", None), (51, None, None, None), (52, "", "en", "a")]
    df = spark.createDataFrame([(*r, 1, True, 2, 3, "x") for r in rows], PIPE_DDL)
    kept, cols = [], df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{len(kept)}")
        df = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        assert df.columns == cols
        kept.append(df.collect())
    named = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert Counter(r.doc_id for r in kept[0]) == Counter(r[0] for r in named)
    once = {}
    for i, t, *_ in sorted(named, key=lambda r: (r[0] is None, r[0] or 0)):
        once.setdefault(re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t), i)
    assert Counter(r.doc_id for r in kept[1]) == Counter(once.values())
    texts = {1 << 60 if i is None else i: t for t, i in once.items()}
    assert {1 << 60 if r.doc_id is None else r.doc_id for r in kept[2]} == plain_near(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in kept[3])
    none = spark.createDataFrame([], PIPE_DDL)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0
