"""Large raw snapshots come in several rows, none dropped."""

from pyspark.sql import functions as F

from tapewright.plans import store as plans
from tapewright.sources import records
from tapewright.sources.views import Market


def exploded(snapshots):
    return sorted(tuple(r) for r in records.trades_from_snapshots(snapshots).select("symbol", "observed_at_ms", "venue", "trade_id", "ts_ms", "qty").collect())


def test_parts_hold_what_whole_snapshots_hold(spark, sf_dir):
    m = Market(spark, sf_dir)
    whole, parts = plans.snapshots(m, 10**9), plans.snapshots(m, 4)
    size = F.size("spot.trades_normalized") + F.size("futures.trades_normalized")
    largest, n = parts.agg(F.max(size), F.count("*")).first()
    most = whole.agg(F.max(size)).first()[0]
    assert most > 12 and n > whole.count()
    assert largest < most  # dealt by hash to parts of 4 on average
    assert exploded(parts) == exploded(whole)
