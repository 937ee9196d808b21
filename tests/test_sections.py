"""Sections of a report are picked by name and group."""

import pytest

from tapewright.plans.reports import selected_sections
from tapewright.sources.views import Market


def test_picked_sections(spark, sf_dir):
    market = Market(spark, sf_dir)
    assert {r[0] for r in selected_sections(market, names=["turnover"]).select("section").distinct().collect()} == {"turnover"}
    assert selected_sections(market).collect() == []
    with pytest.raises(ValueError, match="unknown"):
        selected_sections(market, groups=["none"])
