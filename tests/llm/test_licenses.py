"""The license scan against a plain scan of every window."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tapewright.llm import licenses as lc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(doc_id, text, templates=lc.TEMPLATES, threshold=lc.THRESHOLD):
    words = lc.words_of(text or "")
    places = [(i, label) for phrase, label in lc.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    own, best = set(), 0.0
    for k in range(0, len(words), lc.STEP_WORDS):
        block = set(words[k : k + lc.BLOCK_WORDS])
        for label, text in templates:
            template = set(lc.words_of(text))
            share = len(block & template) / len(template)
            if share >= threshold - 1e-9:
                own.add(label)
                best = max(best, share)
    at, base = [p for p, _ in places], {label for _, label in places}
    return (doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if at else best)


def found(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def expected(rows, **given):
    return sorted(repr(plain(d, t, **given)) for d, t in rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(lc.op12_license_scan(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def texts():
    """Notices whole, with words missing or put between, over window edges, among words of other templates."""
    draw = random.Random(3)
    vocabulary = [*lc.template_words(lc.TEMPLATES), *(f"w{i}" for i in range(60))]
    out = []
    for n in range(160):
        words = [draw.choice(vocabulary[-60:]) for _ in range(draw.randrange(150))]
        label, text = draw.choice(lc.TEMPLATES)
        notice = [w for w in lc.words_of(text) if draw.random() < 0.92]
        for _ in range(draw.randrange(3)):
            notice.insert(draw.randrange(len(notice) + 1), draw.choice(vocabulary))
        at = draw.randrange(len(words) + 1)
        out.append((n, draw.choice([" ", ", ", "\n", "-"]).join(words[:at] + notice + words[at:]).upper() if n % 3 else " ".join(draw.choices(vocabulary, k=90))))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_containment_join_is_exact(spark, threshold):
    rows = texts()
    got = lc.noticed(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold)
    want = expected(rows, threshold=threshold)
    assert found(got) == want and len({r.split("'")[3] for r in want}) > 5


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\x01"), (4, "cc by"), (5, "CC BY cc by,cc  by"), (5, "CC BY cc by,cc  by"), (5, "other"), (None, "All Rights\nReserved."), (6, "ALL RIGHTS RÉSERVED all rights"),
        (7, "İ cc-by É general public licenses General Public License"), (8, "x" * 300_000 + " cc by"), (9, "xcc by cc byx cc by"), (10, "K cc by"), (11, "released under mit license"),
        (12, "license " * 500), (13, "general public license all rights reserved cc by"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "spaced", "word", "block", "labels", "n_words", "score", "template", "at", "keep_0")])
    assert found(lc.op12_license_scan(clashing)) == expected(rows)


def test_empty_table(spark):
    assert lc.op12_license_scan(spark.createDataFrame([], DOCS)).collect() == []


def test_time_follows_the_length_of_a_text(spark):
    """A text of 400,000 words with a notice in every tenth window is read once, not once a window."""
    long = ("lorem ipsum " * 160 + "released under the mit license ") * 1200
    began = time.perf_counter()
    got = lc.op12_license_scan(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["labels"]) for r in got} == {1: (325 * 1200, "mit"), 2: (0, "")}
    assert time.perf_counter() - began < 60
