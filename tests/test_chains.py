"""Chains over ranges, medians, halves and counts in value order, against plain passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import chains, ranges


def plain(rows, following):
    """Picks of one key: ``following(i)`` is the next pick after i."""
    picks, i = [], 0
    while i < len(rows):
        picks.append(i)
        i = following(i)
    return picks


@pytest.mark.parametrize("width", [40, 1000, 100_000])
@pytest.mark.parametrize("rule", ["spaced", "bursts"])
def test_chains_are_those_of_one_pass(spark, rule, width):
    """Dense keys and thin ones, ranges narrower than a jump, ties of time, chains that cover whole ranges."""
    rng = np.random.default_rng(3)
    data = []
    for key, (n, span, share) in {"dense": (1500, 3000, 0.02), "thin": (40, 90_000, 0.5), "large": (300, 2500, 0.0), "one": (1, 1, 0.0)}.items():
        ts = np.sort(rng.integers(0, span, n))
        data += [(key, int(t), i, 5.0 if rng.random() < share else 50.0) for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "k string, ts_ms long, id long, qty double")
    made = {"spaced": chains.spaced(170), "bursts": chains.bursts(170, 30.0)}[rule]
    got = chains.with_chains(df, ["k"], ("ts_ms", "id"), made, width, ("ts_ms", "qty")).collect()
    for key in ("dense", "thin", "large", "one"):
        rows = [r for r in data if r[0] == key]

        def following(i, rows=rows):
            j = i + 1
            if rule == "spaced":
                while j < len(rows) and rows[j][1] - rows[i][1] < 170:
                    j += 1
            else:
                while j < len(rows) and rows[j][1] - rows[i][1] <= 170 and rows[j][3] >= 30:
                    j += 1
            return j

        want = plain(rows, following)
        own = sorted((r for r in got if r["k"] == key), key=lambda r: r["id"])
        assert [r["id"] for r in own if r["picked"]] == want
        owner = np.searchsorted(want, range(len(rows)), "right") - 1
        first = {r["id"]: r["chain"] for r in own if r["picked"]}
        assert [r["chain"] for r in own] == [first[want[i]] for i in owner]


def values(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x), i) for i, x in enumerate(rng.normal(size=301))] + [("b", float(x), i) for i, x in enumerate(rng.integers(0, 4, 500))]
    rows += [("c", 7.0, i) for i in range(40)] + [("d", None, 0), ("d", 1.5, 1), ("e", None, 0)]
    return rows, spark.createDataFrame(rows, "k string, v double, rn long")


def test_exact_median_and_half(spark):
    rows, df = values(spark)
    got = {r["k"]: r["median"] for r in ranges.exact_median(df, ["k"], "v").collect()}
    want = {k: float(np.median([v for key, v, _ in rows if key == k and v is not None])) for k in "abcd"}
    assert got == pytest.approx(want)
    known = df.where("v is not null")
    half = ranges.with_least_half(known, ["k"], "v", "rn", "near").collect()
    for k in "abcd":
        own = sorted((v, rn) for key, v, rn in rows if key == k and v is not None)
        assert {r["rn"] for r in half if r["k"] == k and r["near"]} == {rn for _, rn in own[: len(own) // 2]}
    assert len(half) == known.count()


def test_counts_under_thresholds(spark):
    rows, df = values(spark)
    asked = [(k, t, side) for k in "abcdef" for t in (-0.5, 0.0, 1.0, 2.0, 7.0, 99.0, None) for side in ("up", "down")]
    thresholds = spark.createDataFrame(asked, "k string, t double, side string")
    got = ranges.with_counts_under(thresholds, "t", F.col("side") == "down", df, "v", ["k"], ("under", "n", "nulls")).collect()
    want = []
    for k, t, side in asked:
        own = [v for key, v, _ in rows if key == k]
        known = [v for v in own if v is not None]
        under = None if t is None else sum(v < t or side == "down" and v == t for v in known)
        if own:
            want.append((k, t, side, under, len(known), len(own) - len(known)))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_no_window_holds_a_whole_key(spark):
    """Exact selection orders values inside ranges only; what is ordered by key alone is one row a range."""
    df = spark.range(1000).selectExpr("'k' as k", "cast(id as double) as v")
    plan = ranges.exact_median(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line or "_total" in line or "_carried" in line for line in windows)
