"""Forward fits take no label across a capture gap."""

from collections import defaultdict

from tapewright.operators import rules
from tapewright.plans import models
from tapewright.sources.views import Market


def test_no_case_overlaps_a_degraded_span(spark, sf_dir):
    m = Market(spark, sf_dir)
    spans = defaultdict(list)
    for s in rules.status_spans(m.capture_status).collect():
        spans[s["symbol"]].append((s["lo"], float("inf") if s["hi"] is None else s["hi"]))
    cases = models.cases(m).collect()
    assert cases and spans
    for c in cases:
        assert not any(lo < c["ts_ms"] + c["horizon_ms"] and hi > c["ts_ms"] for lo, hi in spans[c["symbol"]])
