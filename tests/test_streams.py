"""Streams in bounded triggers against the same rows at once, sinks whose batches run twice, and what the state holds."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapewright.sources.views import START_MS, Market
from tapewright.streaming import replay, twins

STEPS = (86_400_000, 50_000)


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    twins.use_rocksdb(spark)


@pytest.fixture(scope="module")
def market(spark, sf_dir):
    return Market(spark, sf_dir)


def arriving(rows, step, tmp_path, **given):
    return replay.arriving(rows, F.expr(f"(ts_ms - {START_MS}) div {step}"), str(tmp_path), **given)


def found(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_triggers_follow_the_order_of_arrival(spark, market, tmp_path):
    stream = arriving(market.quotes, 25_000, tmp_path)
    progress = replay.run_to_end(stream.select("ts_ms"), f"{tmp_path}/run", "append")
    rows = replay.written_batches(spark, stream.select("ts_ms"), f"{tmp_path}/run").groupBy(replay.BATCH).agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).orderBy(replay.BATCH).collect()
    assert len(rows) > 5 and all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(p["numInputRows"] <= 100 for p in progress)


@pytest.mark.parametrize("operator", ["book", "ofi", "alerts"])
def test_one_trigger_or_many(spark, market, tmp_path, operator):
    """The same rows whether the tape comes at once or in several triggers."""
    deltas = market.depth_deltas
    quotes = market.quotes.select("symbol", "venue", "ts_ms", F.when(F.col("bid_qty") > F.col("ask_qty"), "b").otherwise("a").alias("state"))
    made = {"book": lambda s: twins.book_reconstruct(s), "ofi": lambda s: twins.ofi_from_depth(s, 5_000), "alerts": lambda s: twins.alert_stream(s, 60_000, 4_000, 10_000)}[operator]
    once, often = (found(replay.drain(made(arriving(quotes if operator == "alerts" else deltas, step, tmp_path)), str(tmp_path), "append")) for step in STEPS)
    assert once == often and once


def test_fold_in_one_trigger_or_many(market, tmp_path):
    trades = market.trades.withColumn("arrival", F.col("ts_ms"))
    once, often = (found(replay.drain(twins.horizon_fold(arriving(trades, step, tmp_path), 14_400_000, 900_000), str(tmp_path), "update", ["symbol"])) for step in (86_400_000, 14_400_000))
    assert once == often and once


def test_late_rows_and_windows_are_the_whole_tape(spark, tmp_path):
    """Windows leave the state as the watermark passes; what comes after that is counted aside, and nothing is lost."""
    rows = [("S", "spot", i, START_MS + i * 1000 - (1_500_000 if i % 50 == 0 and i > 2000 else 0), 1.0, 1.0, False, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "symbol string, venue string, trade_id long, ts_ms long, price double, qty double, is_buyer_maker boolean, at long")
    beat = spark.createDataFrame([(None, None, None, START_MS + 10**9, None, None, None, None)], df.schema)
    stream = replay.arriving(df, F.expr("at div 300"), str(tmp_path), beat)
    flow = twins.bucketed_flow(stream)
    progress = replay.run_to_end(flow, f"{tmp_path}/run", "append")
    out = replay.written_batches(spark, flow, f"{tmp_path}/run")
    late = replay.late_rows(stream, str(tmp_path), 60_000, 600_000)
    assert out.groupBy("start_ms").count().where("count > 1").count() == 0
    assert late.count() > 0 and out.agg(F.sum("trades")).first()[0] + late.count() == len(rows)
    assert late.where("at % 50 <> 0").count() == 0
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # Ten minutes of lateness, and at most two triggers of five minutes: a hundred minutes of tape are never held.
    assert max(state) <= 25 and len(state) > 15


def test_silence_is_told_once(spark, tmp_path):
    """By the timer where no row follows, by the next row where one does, and not while a row is in time."""
    base = 1_704_067_200_000
    rows = [("A", "x", base + t, "s") for t in (0, 5_000, 10_000, 40_000, 45_000)] + [("B", "x", base + t, "s") for t in range(0, 120_001, 2_500)]
    df = spark.createDataFrame(rows, "symbol string, venue string, ts_ms long, state string")
    want = [("A", base + 15_000), ("A", base + 50_000)]
    for step in (1_000_000, 30_000):
        stream = replay.arriving(df, F.expr(f"(ts_ms - {base}) div {step}"), str(tmp_path))
        got = replay.drain(twins.alert_stream(stream, 10**9, 5_000, 10**9, "5 seconds"), str(tmp_path), "append")
        assert sorted((r["symbol"], r["ts_ms"]) for r in got.where("trigger = 'staleness'").collect()) == want
        assert [r["ts_ms"] for r in got.where("trigger = 'recovery'").collect()] == [base + 40_000]


def test_gap_drops_the_interval_it_cuts(spark, tmp_path):
    frames = [(1, 0, "bid", 99, 1.0), (2, 0, "ask", 101, 1.0), (3, 2_000, "bid", 99, 2.0), (4, 11_000, "bid", 99, 3.0), (5, 21_000, "bid", 99, 1.0), (9, 22_000, "bid", 98, 5.0), (10, 23_000, "ask", 102, 1.0), (11, 24_000, "ask", 102, 4.0), (12, 35_000, "ask", 102, 2.0)]
    rows = [("S", "spot", START_MS + t, u, u, side, p, q) for u, t, side, p, q in frames]
    df = spark.createDataFrame(rows, "symbol string, venue string, ts_ms long, first_update_id long, final_update_id long, side string, price_ticks long, qty double")
    for step in (10**6, 6_000):
        got = replay.drain(twins.ofi_from_depth(arriving(df, step, tmp_path)), str(tmp_path), "append").orderBy("session", "start_ms").collect()
        # 20 s of the first session is cut by the gap before frame 9; 30 s of the second is still open.
        assert [(r["session"], r["start_ms"] - START_MS, r["event_count"], r["ofi"], r["first_update_id"]) for r in got] == [(0, 0, 1, 1.0, 3), (0, 10_000, 1, 1.0, 4), (1, 20_000, 1, -3.0, 11)]


def test_sink_takes_a_batch_once(spark, tmp_path):
    schema = "symbol string, ts long, v double"
    sink = replay.LatestAndHistory(str(tmp_path), ["symbol"], ["ts"], spark.createDataFrame([], schema).schema, buckets=4)
    batches = [[("S", 1, 1.0), ("T", 5, 1.0)], [("S", 3, 3.0)], [("S", 2, 2.0), ("U", 1, None)], []]
    for number, rows in enumerate(batches):
        for _ in range(2):
            sink.write(spark.createDataFrame(rows, schema), number)
    assert found(sink.latest(spark)) == found(spark.createDataFrame([("S", 3, 3.0), ("T", 5, 1.0), ("U", 1, None)], schema))
    assert sink.history(spark).count() == 5
    # An uncommitted batch isn't seen; an early one that runs again leaves the later ones as they are.
    spark.createDataFrame([("S", 9, 9.0)], schema).write.parquet(f"{tmp_path}/history/{replay.BATCH}=7")
    sink.write(spark.createDataFrame(batches[1], schema), 1)
    assert sink.history(spark).count() == 5 and sink.latest(spark).where("symbol = 'S'").first()["v"] == 3.0


def test_sink_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    schema = "k long, ts long"
    sink = replay.LatestAndHistory(str(tmp_path), ["k"], ["ts"], spark.createDataFrame([], schema).schema)
    sink.write(spark.range(400).selectExpr("id as k", "1 as ts").selectExpr("k", "cast(ts as long) as ts"), 0)
    sink.write(spark.createDataFrame([(7, 2)], schema), 1)
    versions = sink._versions(spark)
    assert sorted(versions.values()).count(1) == 1 and sink.latest(spark).count() == 400
    assert {r["k"]: r["ts"] for r in sink.latest(spark).where("ts = 2").collect()} == {7: 2}


def test_stream_of_a_sink_restarts(spark, market, tmp_path):
    quotes = arriving(market.quotes.select("symbol", "venue", "ts_ms", "update_id"), 60_000, tmp_path)
    sink = replay.LatestAndHistory(f"{tmp_path}/sink", ["symbol", "venue"], ["ts_ms", "update_id"], quotes.schema)
    for _ in range(2):
        sink.drained(quotes)
    assert sink.history(spark).count() == market.quotes.count()
    newest = defaultdict(tuple)
    for r in market.quotes.collect():
        newest[r["symbol"], r["venue"]] = max(newest[r["symbol"], r["venue"]], (r["ts_ms"], r["update_id"]))
    assert {(r[0], r[1]): (r[2], r[3]) for r in sink.latest(spark).collect()} == dict(newest)
