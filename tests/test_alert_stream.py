"""The alert stream against a plain scan of each key."""

from collections import defaultdict

from tapewright.plans.all import registered
from tapewright.sources.views import Market


def test_alerts_are_those_of_a_plain_scan(spark, sf_dir):
    quotes = defaultdict(list)
    for r in Market(spark, sf_dir).quotes.select("symbol", "venue", "ts_ms", "bid_qty", "ask_qty").collect():
        quotes[r["symbol"], r["venue"]].append((r["ts_ms"], "bid_heavy" if r["bid_qty"] > r["ask_qty"] else "ask_heavy"))
    want = []
    for key, rows in quotes.items():
        ts0 = state0 = flip = None
        for ts, state in sorted(rows):
            if ts0 is not None and ts <= ts0:
                continue
            if ts0 is None:
                want.append((*key, ts, "first_data", state, None))
            else:
                if ts - ts0 > 120_000:
                    want.append((*key, ts, "recovery", state, state0))
                if ts // 900_000 != ts0 // 900_000:
                    want.append((*key, ts, "rollover", state, state0))
                if state != state0 and (flip is None or ts - flip >= 60_000):
                    want.append((*key, ts, "state_flip", state, state0))
                    flip = ts
            ts0, state0 = ts, state
    got = [tuple(r) for r in registered()["x9_alert_stream"].run(spark, sf_dir).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want))
