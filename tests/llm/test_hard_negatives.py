"""Hard negatives against scores of every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, shift=True, step=100):
    taking = []
    for u, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if shift and vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taking.append((u, vec_id, label, [int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x) for x in map(float, np.array(vector, np.float32))]))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for u, anchor, label, q in taking:
        if anchor is None or anchor % step:
            continue
        scored = [(sum(a * b for a, b in zip(q, p, strict=False)), v, other) for w, v, other, p in taking if w != u]
        for p_score, positive, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 80 * p_score <= 100 * s[0] <= 100 * p_score), key=key)[:5]
            out += [(anchor, positive, i, v, p_score, s) for i, (s, v, _) in enumerate(fit, 1)]
    return sorted(map(repr, out))


def found(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def clustered(n, dim=12, seed=2, spread=0.15):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    return [(i, (centres[i % 6] + spread * draw.normal(size=dim)).astype(np.float32).tolist(), int(draw.integers(10))) for i in range(n)]


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    got = found(hn.op11_hard_negatives(rows))
    assert got == expected([tuple(r) for r in rows.collect()]) and got


@pytest.mark.parametrize("step", [3, 20])
def test_many_blocks_and_salts(spark, step, monkeypatch):
    """Anchors over several blocks, candidates over several salts, ties in most scores."""
    for name, value in (("BLOCK_ANCHORS", 9), ("LEAST_SALT", 40), ("MOST_SALT", 70)):
        monkeypatch.setattr(hn, name, value)
    draw = random.Random(4)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)], draw.randrange(3)) for i in range(260)]
    for data in (rows, clustered(240)):
        assert found(hn.mined(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % step == 0)) == expected(data, False, step)


def test_bounds_spare_scores_and_lose_none():
    rows = clustered(2400, spread=0.05)
    points = np.floor(np.array([v for _, v, _ in rows]) * 256)
    anchors, labels = points[::12], np.zeros(200)
    order, parent, edge = hn.spanning_forest(anchors, labels)
    place = np.empty(200, int)
    place[order] = range(200)
    own = anchors[order]
    tops = [np.sort(points @ a)[-20] for a in own]
    window = lambda k: (tops[k], np.inf)
    everyone = np.ones(len(points), bool)
    looked = 0
    for k, met, scores in hn.scored(points, own, np.where(parent[order] < 0, -1, place[parent[order]]), edge[order], window, lambda k: everyone):
        assert (scores == points[met] @ own[k]).all()
        assert set(np.flatnonzero(points @ own[k] >= tops[k])) <= set(met)
        looked += len(met)
    assert looked < 0.5 * len(points) * len(own)


def test_forest_is_least():
    draw = np.random.default_rng(7)
    points, groups = draw.normal(size=(60, 3)), draw.integers(0, 3, 60)
    order, parent, edge = hn.spanning_forest(points, groups)
    assert sorted(order) == list(range(60)) and all(list(order).index(p) < list(order).index(i) for i, p in enumerate(parent) if p >= 0)
    for g in range(3):
        rows = np.flatnonzero(groups == g)
        joined, total = {rows[0]}, 0.0
        while len(joined) < len(rows):
            d, b = min((np.linalg.norm(points[a] - points[b]), b) for a in joined for b in rows if b not in joined)
            joined.add(b)
            total += d
        assert edge[rows].sum() == pytest.approx(total)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (200, None, 1), (300, [0.5, None], 1), (400, [nan, 0.1], 1), (500, [inf, 0.1], 1), (600, [0.5, 0.4], None),
        (None, [0.45, 0.5], 2), (None, [0.45, 0.5], 2), (None, [0.5, 0.5], 1), (7, [0.45, 0.5], 0), (8, [0.5], 2), (9, [], 2), (10, [0.49, 0.49, 0.3], 3), (11, [-0.5, -0.5], 1), (700, [-0.5, 0.1], 4), (12, [0.5, -0.1], 4),
        (-100, [0.3, 0.3], 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("uid", "vector", "block", "salt", "at", "positives", "anchor", "score", "rank")])
    assert found(hn.op11_hard_negatives(clashing)) == expected(rows)


def test_scores_beyond_exact_doubles(spark):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) * 1e6, float(draw.randrange(3)), 3e4], draw.randrange(2)) for i in range(60)]
    assert found(hn.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == expected(rows, False, 10)
    huge = [(i, [1e30 if i % 2 else 1.0], i % 3) for i in range(12)]
    assert hn.mined(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") % 2 == 0).count() > 0


def test_empty_tables(spark):
    assert hn.op11_hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.op11_hard_negatives(spark.createDataFrame([(1, [0.5], 1)], SCHEMA)).collect() == []
    assert hn.op11_hard_negatives(spark.createDataFrame([(0, [0.5], 1)], SCHEMA)).collect() == []
