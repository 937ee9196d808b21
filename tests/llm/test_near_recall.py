"""Near copies that bucket ends or repeated lines hide."""

from collections import defaultdict

import numpy as np
import pytest

from tapewright.llm import minhash


def words(rng, n):
    return [f"w{v}" for v in rng.integers(0, 10**6, n)]


def classes_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in minhash.op6_near_duplicates(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    return {frozenset(ids) for ids in got.values()}


def test_near_pairs_inside_a_template(spark):
    """Documents on one template, alike to 0.72, meet in large buckets; many true pairs of 0.81 share no other and are no bucket's ends."""
    rng = np.random.default_rng(3)
    template, texts, pairs = words(rng, 134), [], set()
    for _ in range(400):
        text = template + words(rng, 26)
        texts += [" ".join(text), " ".join(text[:-16] + words(rng, 16))]
        pairs.add(frozenset((len(texts) - 2, len(texts) - 1)))
    assert {c for c in classes_of(spark, texts) if len(c) > 1} == pairs


def sets_of_variants(rng, repeats=False):
    """40 sets near one base, some members of which come again, as lists of (first, again)."""
    base = rng.integers(0, 2**62, 200)
    sets = []
    for i in range(40):
        first = base.copy()
        at = rng.choice(200, 24, replace=False)
        first[at] = rng.integers(0, 2**62, 24)
        more = first[: 10 * (i % 4)] if repeats else first[:0]
        sets.append(([int(v) for v in first], [int(v) ^ 1 << 62 for v in more]))
    return sets


def likeness(x, y):
    (a, more_a), (b, more_b) = x, y
    plain = len({*a} & {*b}) / len({*a} | {*b})
    return max(plain, len({*a, *more_a} & {*b, *more_b}) / len({*a, *more_a} | {*b, *more_b}))


def open_tables(spark, sets):
    shingles = spark.createDataFrame([(i, a, more) for i, (a, more) in enumerate(sets)], "node long, first array<bigint>, again array<bigint>")
    return shingles.selectExpr("node", "node div 2 as component"), shingles


@pytest.mark.parametrize("repeats", [False, True])
def test_prefix_join_loses_no_pair(spark, repeats):
    sets = sets_of_variants(np.random.default_rng(4), repeats)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 2 != b // 2 and likeness(sets[a], sets[b]) >= 0.64}
    assert 20 < len(want) < 700
    nodes, shingles = open_tables(spark, sets)
    for block in (6, 1024):
        pairs = minhash.prefix_pairs(nodes, shingles, 0.64, block)
        assert {tuple(r) for r in minhash.settled(pairs, shingles, 0.64).collect()} == want


def test_links_across_join_the_classes_that_all_pairs_join(spark):
    rng = np.random.default_rng(6)
    sets = sets_of_variants(rng, True) + sets_of_variants(rng) + [([int(v) for v in rng.integers(0, 2**62, 5)], []) for _ in range(4)]
    nodes, shingles = open_tables(spark, sets)
    found = [tuple(r) for r in minhash.links_across(nodes, shingles, 0.66, 6).collect()]
    assert all(a // 2 != b // 2 and likeness(sets[a], sets[b]) >= 0.66 for a, b in found)

    def classes(links):
        own = [i // 2 for i in range(len(sets))]
        for a, b in links:
            own = [own[b] if c == own[a] else c for c in own]
        return {frozenset(i for i, c in enumerate(own) if c == one) for one in own}

    every = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if likeness(sets[a], sets[b]) >= 0.66]
    assert classes(found) == classes(every)


def test_open_texts_of_none(spark):
    nodes, shingles = open_tables(spark, [([1, 2, 3], [])])
    for some in (nodes, nodes.limit(0)):
        assert minhash.links_across(some, shingles, 0.8).count() == 0


def test_a_repeated_line_hides_no_copy(spark):
    """Equal in their shingles but for one line repeated 400 times: plain likeness near 1, weighted about 0.2; and two copies of such a text."""
    rng = np.random.default_rng(5)
    texts, pairs = [], set()
    for _ in range(20):
        text, line = words(rng, 1000), words(rng, 10)
        texts += [" ".join(text + line), " ".join(text + line * 400)]
        pairs.add(frozenset((len(texts) - 2, len(texts) - 1)))
    line = words(rng, 10)
    texts += [" ".join(words(rng, 60) + line * 400) for _ in range(2)]
    pairs.add(frozenset((len(texts) - 2, len(texts) - 1)))
    assert {c for c in classes_of(spark, texts) if len(c) > 1} == pairs
