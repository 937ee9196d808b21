"""Trade clusters against one plain scan of a key."""

import numpy as np
import pytest

from tapewright.operators import bars


@pytest.mark.parametrize("gap_ms", [1500, 15_000])
def test_clusters_equal_the_plain_scan(spark, gap_ms):
    rng = np.random.default_rng(2)
    ts = np.sort(np.r_[rng.integers(0, 3 * 3_600_000, 3000), *[h * 3_600_000 + rng.integers(-5000, 5000, 60) for h in (1, 2)]]).tolist()
    qty = np.where(rng.random(len(ts)) < 0.06, 5, rng.integers(30, 90, len(ts))).astype(float).tolist()
    tape = [("S", "spot", i, t, 1.0, q, False) for i, (t, q) in enumerate(zip(ts, qty, strict=True))]
    want, i = [], 0
    while i < len(tape):
        j = i + 1
        while j < len(tape) and ts[j] - ts[i] <= gap_ms and qty[j] >= 30:
            j += 1
        want += [(ts[i], j - i, sum(qty[i:j]))] if j - i >= 3 else []
        i = j
    df = spark.createDataFrame(tape, "symbol string, venue string, trade_id long, ts_ms long, price double, qty double, is_buyer_maker boolean")
    got = bars.trade_clusters(df, gap_ms=gap_ms, keep=10_000).orderBy("ts_ms").collect()
    assert [(r["ts_ms"], r["trade_count"], r["total_qty"]) for r in got] == want
