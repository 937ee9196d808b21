"""Operators on hand-made tables: cases that the generated tables don't hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import bars, book, micro, models, recall, rules, tape
from tapewright.sources import records, store
from tapewright.streaming import twins

TRADES = "symbol string, venue string, trade_id long, ts_ms long, price double, qty double, is_buyer_maker boolean"


def trades(spark, *rows):
    return spark.createDataFrame([("S", "spot", *r) for r in rows], TRADES)


def test_flow_summary_by_hand(spark):
    t = trades(spark, (1, 1000, 100.0, 2.0, False), (2, 2000, 101.0, 1.0, True), (3, 2000, 102.0, 30.0, False))
    r = tape.flow_summary(t).first()
    assert (r["buy_vol"], r["sell_vol"], r["cvd"], r["last_price"], r["median_qty"]) == (32.0, 1.0, 31.0, 102.0, 2.0)
    assert r["large_trade_count"] == 1 and r["vwap"] == pytest.approx((200 + 101 + 3060) / 33)


def test_dedupe_keeps_rows_without_id(spark):
    t = trades(spark, (1, 1, 1.0, 1.0, True), (1, 2, 2.0, 1.0, True), (None, 3, 1.0, 1.0, True), (None, 3, 1.0, 1.0, True))
    assert sorted(r["ts_ms"] for r in tape.dedupe_trades(t).collect()) == [1, 3, 3]


def test_empty_and_constant_series_have_no_correlation(spark):
    t = trades(spark, (1, 1, 1.0, 1.0, True), (2, 2, 1.0, 2.0, True))
    assert t.agg(tape.guarded_corr("price", "qty").alias("r")).first()["r"] is None
    assert t.where("false").agg(tape.guarded_corr("price", "qty").alias("r")).first()["r"] is None


def test_trade_clusters_are_anchored_at_their_first_print(spark):
    t = trades(spark, (1, 0, 1.0, 1.0, False), (2, 1000, 1.0, 30.0, False), (3, 1500, 1.0, 40.0, True), (4, 1600, 1.0, 50.0, False), (5, 2900, 1.0, 50.0, False), (6, 3000, 1.0, 50.0, False))
    got = bars.trade_clusters(t).orderBy("ts_ms").collect()
    assert [(r["ts_ms"], r["trade_count"], r["total_qty"]) for r in got] == [(0, 3, 71.0), (1600, 3, 150.0)]


def test_clusters_span_the_hour_once(spark):
    h = 3_600_000
    t = trades(spark, (1, h - 500, 1.0, 30.0, False), (2, h + 100, 1.0, 30.0, False), (3, h + 900, 1.0, 30.0, False))
    got = [(r["ts_ms"], r["trade_count"]) for r in bars.trade_clusters(t).collect()]
    assert (h - 500, 3) in got


def test_keystone_falls_back_without_bids_in_the_band(spark):
    levels = spark.createDataFrame([("S", 1, "bid", 9000, 90.0, 5.0), ("S", 1, "ask", 10010, 100.1, 5.0)], "symbol string, snapshot_id long, side string, price_ticks long, price double, qty double")
    prices = spark.createDataFrame([("S", 1, 100.0)], "symbol string, snapshot_id long, price double")
    r = book.find_keystone(levels, prices).first()
    assert r["keystone"] == pytest.approx(99.7) and r["window_qty"] == 0


def test_price_impact_recovers_the_slope(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 50, 80)
    rows = [("S", "spot", i * 10_000, float(v), float(0.02 * v + 0.5 + e), 10.0) for i, (v, e) in enumerate(zip(x, rng.normal(0, 0.1, 80), strict=True))]
    r = models.fit_price_impact(spark.createDataFrame(rows, "symbol string, venue string, start_ms long, x double, y double, average_depth double")).first()
    assert r["beta"] == pytest.approx(0.02, rel=0.05) and r["status"] == "validated" and r["n"] == 80


def test_no_flow_variance_is_insufficient(spark):
    rows = [("S", "spot", i * 1000, 1.0, float(i), 1.0) for i in range(40)]
    r = models.fit_price_impact(spark.createDataFrame(rows, "symbol string, venue string, start_ms long, x double, y double, average_depth double")).first()
    assert r["status"] == "insufficient" and r["stderr_beta"] is None


def test_forward_ols_against_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.2, 200)
    rows = [("S", "spot", i, i, 1000, float(y[i]), float(x[i, 0]), float(x[i, 1]), i + 1, 200, i < 140) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, venue string, ts_ms long, update_id long, horizon_ms int, y_ticks double, f1 double, f2 double, rn int, n long, train boolean")
    r = models.fit_forward_ols(df, ["f1", "f2"]).first()
    design = np.c_[np.ones(200), x]
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [r["betas"][k] for k in ("intercept", "f1", "f2")] == pytest.approx(want, abs=1e-9)
    e = y - design @ want
    inv = np.linalg.inv(design.T @ design)
    hc0 = np.sqrt(np.diag(inv @ (design * e[:, None] ** 2).T @ design @ inv))
    assert [r["stderr"][k] for k in ("intercept", "f1", "f2")] == pytest.approx(hc0, rel=1e-6)
    train = np.linalg.lstsq(design[:140], y[:140], rcond=None)[0]
    sse, sst = ((y[140:] - design[140:] @ train) ** 2).sum(), ((y[140:] - y[:140].mean()) ** 2).sum()
    assert r["oos_skill"] == pytest.approx(1 - sse / sst) and r["validation_status"] == "validated"


def test_forward_labels_look_only_ahead(spark):
    q = [("S", "spot", i, i * 1000, 100 + i, 102 + i, 1.0 + i % 2, 1.0) for i in range(8)]
    events = micro.book_events(spark.createDataFrame(q, "symbol string, venue string, update_id long, ts_ms long, bid_ticks long, ask_ticks long, bid_qty double, ask_qty double"))
    got = {(r["update_id"], r["horizon_ms"]): (r["y_ticks"], r["excluded"]) for r in micro.forward_labels(events, events, (1000, 5000)).collect()}
    assert got[2, 1000] == (1.0, None) and got[2, 5000] == (5.0, None) and got[5, 5000] == (None, "end_of_window")


def test_absorption_keeps_the_first_of_each_span(spark):
    rows = spark.createDataFrame([("S", "spot", t, i) for i, t in enumerate([0, 10_000, 59_000, 60_000, 61_000, 130_000])], "symbol string, venue string, ts_ms long, update_id long")
    assert sorted(r["ts_ms"] for r in micro.thinned(rows, 60_000).collect()) == [0, 60_000, 130_000]


def test_norm_cdf_on_a_grid(spark):
    """Near, middle and far parts against the error function, and what has no value."""
    zs = [i / 500 for i in range(-6_000, 6_001)] + [-50.0, 50.0, float("-inf"), float("inf")]
    got = spark.createDataFrame([(z,) for z in [*zs, None, float("nan")]], "z double").select("z", models.norm_cdf(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in got if r["z"] is None or r["z"] != r["z"]] == [None, None]
    for r in got[: len(zs)]:
        assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) <= 1e-15, r
        if -11 < r["z"] < 0:
            assert math.isclose(r["p"], 0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel_tol=1e-12), r


def test_norm_cdf(spark):
    got = spark.createDataFrame([(0.0,), (1.96,), (None,)], "z double").select(models.norm_cdf("z").alias("p")).collect()
    assert got[0]["p"] == 0.5 and got[1]["p"] == pytest.approx(0.9750021) and got[2]["p"] is None


def test_rule_columns_on_nulls(spark):
    none = spark.createDataFrame([("S", None, None, None, None, None, None)], "symbol string, spot_cvd double, futures_cvd double, spot_share double, futures_share double, funding double, long_pct double")
    r = rules.demand_verdict(none.withColumn("top_long_pct", F.lit(None).cast("double"))).first()
    assert r["verdict"].startswith("MIXED-ABSORPTION")


def test_open_status_span_has_no_end(spark):
    rows = spark.createDataFrame([("S", 1, "running"), ("S", 2, "gap"), ("S", 3, "reconnecting"), ("S", 4, "running"), ("S", 5, "gap")], "symbol string, updated_at_ms long, state string")
    assert [(r["lo"], r["hi"], r["reason"]) for r in rules.status_spans(rows).orderBy("lo").collect()] == [(2, 4, "gap"), (5, None, "gap")]


def test_append_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/tape"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    for _ in range(2):
        store.append_idempotent(rows, path, ["id"])
    store.append_idempotent(spark.createDataFrame([(2, "other"), (3, "c")], "id long, v string"), path, ["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_append_reads_what_the_batch_can_meet(spark, tmp_path):
    """The stored rows that are read follow the batch: its partitions, and its range of keys; nothing is appended twice."""
    path = f"{tmp_path}/tape"
    rows = spark.range(20_000).selectExpr("concat('S', id % 4) as symbol", "id", "cast(id * 2 as double) as v")
    store.append_idempotent(rows, path, ["symbol", "id"], ["symbol"])
    batch = spark.createDataFrame([("S1", 19_997, 0.0), ("S1", 20_001, 1.0), (None, 5, 2.0)], rows.schema)
    near = store.reachable(spark.read.schema(rows.schema).parquet(path), batch.where("symbol is not null"), ["symbol", "id"], ["symbol"])
    assert [tuple(r) for r in near.select("symbol", "id").collect()] == [("S1", 19_997)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters:")[1].split("]")[0] and "GreaterThanOrEqual(id,19997)" in plan
    for _ in range(2):
        store.append_idempotent(batch.where("symbol is not null"), path, ["symbol", "id"], ["symbol"])
    assert spark.read.parquet(path).count() == 20_001


def test_read_snapshots_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"symbol":"S","observed_at_ms":5,"spot":{"trades_normalized":[{"id":1,"ts":4,"price":2.0,"qty":1.0,"is_buyer_maker":false}]}}\n{"symbol": oops\n')
    rows = records.read_snapshots(spark, str(tmp_path / "s.json")).cache()
    assert rows.count() == 2 and rows.where("_corrupt is not null").count() == 1
    assert records.trades_from_snapshots(rows).collect()[0]["trade_id"] == 1


def test_read_quote_tape(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"ts": 1, "bid": "100.01", "bidQty": "2", "ask": "bad", "askQty": "1"}]')
    r = records.read_quote_tape(spark, str(tmp_path / "q.json")).first()
    assert str(r["bid_price"]) == "100.01000000" and r["ask_price"] is None


def test_fingerprint_ignores_order_case_and_numbers(spark):
    texts = ["Analyse SOL OFI depth", "depth, ofi sol ANALYSE 42!", "what is it", None]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(recall.text_fingerprint(F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] != "-" and got[2:] == ["-", "-"]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    twins.use_rocksdb(spark)
    rng = np.random.default_rng(4)
    rows, high = [], {"spot": 0, "futures": 0}
    for i in range(300):
        venue = ("spot", "futures")[int(rng.integers(2))]
        high[venue] += int(rng.integers(0, 3))
        rows.append(("S", venue, high[venue], int(i * 20_000 + rng.integers(-90_000, 1)) + 100_000, 10.0, float(rng.integers(1, 9)), bool(rng.integers(2)), i))
    df = spark.createDataFrame(rows, TRADES + ", arrival long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = twins.drain(twins.horizon_fold(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 900_000, 60_000), str(tmp_path), "update")
    cols = ["segment_ms", "venue", "trades", "buy_notional", "sell_notional"]
    want = twins.horizon_fold_batch(df, 900_000, 60_000)
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())
    assert got.first()["duplicates"] > 0 and got.first()["late"] > 0


def test_warm_start_overlap_is_absorbed(spark, tmp_path):
    rows = [("S", "spot", i, i * 1000, 1.0, 1.0, True, i) for i in range(1, 20)]
    df = spark.createDataFrame(rows, TRADES + ", arrival long")
    got = twins.horizon_fold_batch(df.where("trade_id <= 12").unionByName(df.where("trade_id > 8")), 900_000, 60_000)
    assert got.agg(F.sum("trades")).first()[0] == 19
