"""Findings of the third round: each test failed before its fix."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright.operators import book, micro, tape
from tapewright.plans.all import registered
from tapewright.sources.views import Market
from tapewright.streaming import replay, twins

from test_queries_match_sql import rows


def same_as_sql(spark, folder, name):
    """A query and its SQL over a folder that holds the tables it reads."""
    query, con = registered()[name], duckdb.connect()
    for table in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want, got = con.execute(query.oracle()), query.run(spark, str(folder))
    columns = [d[0] for d in want.description]
    return rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.fixture
def grown(sf_dir, tmp_path):
    """The tables with the keys of copies, so ids are as large as those of a big table."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT l.* REPLACE (l_orderkey + c * 150000000 AS l_orderkey) FROM '{sf_dir}/lineitem.parquet' l, range(6) r(c)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM '{sf_dir}/events.parquet') TO '{tmp_path}/events.parquet'")
    return tmp_path


def test_candles_follow_their_sql_where_ids_are_large(spark, grown):
    assert Market(spark, str(grown)).trades.agg(F.max("trade_id")).first()[0] > 10_000_000
    assert same_as_sql(spark, grown, "a38_fold_candles")


def test_warm_start_takes_a_history_of_many_batches(spark, tmp_path):
    """More trades of a symbol than one Arrow batch holds: their order across batches doesn't count."""
    con = duckdb.connect()
    line = "SELECT (i * 7919) % 200003 AS l_orderkey, (i * 31) % 2000 AS l_partkey, (i // 40000) * 5 AS l_suppkey, (i % 7 + 1)::INTEGER AS l_linenumber, (i % 50 + 1)::DOUBLE AS l_quantity, CASE WHEN i % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus"
    con.execute(f"COPY ({line} FROM range(80000) r(i)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT 1 AS event_id) TO '{tmp_path}/events.parquet'")
    assert same_as_sql(spark, tmp_path, "x7_stream_warm_start")


def test_triggers_of_several_files(spark, tmp_path):
    """A range in several files is one trigger, also where it has fewer rows than files."""
    df = spark.range(1000, numPartitions=6).selectExpr("id as ts_ms", "case when id < 3 then 0 else 1 + id div 400 end as place")
    stream = replay.arriving(df, F.col("place"), str(tmp_path), files=4).select("ts_ms")
    replay.run_to_end(stream, f"{tmp_path}/run", "append")
    got = replay.written_batches(spark, stream, f"{tmp_path}/run").groupBy(replay.BATCH).agg(F.min("ts_ms"), F.max("ts_ms"), F.count("*")).orderBy(replay.BATCH)
    assert [tuple(r)[1:] for r in got.collect()] == [(0, 2, 3), (3, 399, 397), (400, 799, 400), (800, 999, 200)]


def test_replay_of_many_sessions_is_no_call_a_session(spark, sf_dir):
    """Short sessions share a task's call, and a session may lie in several batches of rows."""
    deltas = Market(spark, sf_dir).depth_deltas
    found = lambda: sorted(map(tuple, micro.replay_book(deltas, 60_000).collect()), key=repr)
    whole = found()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found() == whole and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in micro.replay_book(deltas)._jdf.queryExecution().toString()


def test_degraded_spans_are_no_pairs(spark):
    """Spans that overlap, touch, hold each other or stay open, against a plain scan; labels aren't dealt to blocks and paired."""
    spans = [("S", (i * 3_701) % 90_000, (i * 3_701) % 90_000 + (i % 7) * 900, f"r{i % 3}") for i in range(40)] + [("S", 20_000, 50_000, "long"), ("S", 97_000, None, "open"), ("T", 5_000, 5_000, "empty")]
    labels = [(s, "spot", t, t, h, 1.0, None) for s in "STU" for t in range(0, 100_000, 450) for h in (1_000, 5_000)]
    df = spark.createDataFrame(labels, "symbol string, venue string, ts_ms long, update_id long, horizon_ms int, y_ticks double, excluded string")
    table = spark.createDataFrame(spans, "symbol string, lo long, hi long, reason string")
    got = micro.exclude_degraded(df, table, 10_000)
    end = max(t + h for _, _, t, _, h, _, _ in labels) + 1

    def scan(s, t, h):
        hits = [(lo, end if hi is None else hi, r) for k, lo, hi, r in spans if k == s]
        hits = sorted(x for x in hits if x[1] > x[0] and x[0] < t + h and x[1] > t)
        return hits[0][2] if hits else None

    assert {(r["symbol"], r["ts_ms"], r["horizon_ms"]): r["excluded"] for r in got.collect()} == {(s, t, h): scan(s, t, h) for s, _, t, _, h, _, _ in labels}
    assert got.where("(excluded is null) <> (y_ticks is not null)").count() == 0
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_tables_of_a_row_a_key_meet_trades_by_broadcast(spark, sf_dir):
    """A sort-merge join by key would put all trades of a busy symbol into one task."""
    m = Market(spark, sf_dir)
    keystones = spark.createDataFrame([("S0", 98.5), ("S1", 99.0)], "symbol string, keystone double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark does where it doubts the size
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (book.keystone_trade_intensity(m.trades, keystones), tape.large_trades(m.trades), tape.flow_persistence(m.trades))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
        assert "BroadcastHashJoin" in plan and not [j for j in joins if "_range" not in j]


def test_stateful_operators_get_few_wide_rows(spark, tmp_path):
    """Depth deltas and quotes reach the book and the intervals as a row a key and Arrow batch, not one by one; null quotes stay null."""
    df = spark.range(3_000, numPartitions=2).selectExpr("concat('S', id % 3) as symbol", "id", "nullif(id % 7, 0) as price_ticks", "if(id % 2 = 0, 'bid', null) as side")
    wide = twins.packed(df, ["symbol"], ["id", "price_ticks", "side"])
    assert wide.count() == 6
    assert sorted(map(tuple, wide.selectExpr("symbol", "inline(arrays_zip(id, price_ticks, side))").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    deltas = spark.createDataFrame([], "symbol string, venue string, first_update_id long, final_update_id long, ts_ms long, side string, price_ticks long, qty double")
    deltas.write.parquet(f"{tmp_path}/deltas")
    plan = twins.ofi_from_depth(spark.readStream.schema(deltas.schema).parquet(f"{tmp_path}/deltas"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2 == plan.count("TransformWithStateInPySpark")


def test_packed_book_follows_a_plain_one(spark, tmp_path):
    """Levels that go and come back, gaps, stale frames and ids over several triggers, against a scan that sorts all prices."""
    rng, rows, uid, frames = random.Random(5), [], 0, []
    for i in range(900):
        first = uid + (1 if rng.random() > 0.02 else 3)
        uid = first + rng.randrange(3)
        frames.append((i // 300, "S", "spot", first, uid, i * 100, rng.choice(("bid", "ask")), rng.randrange(12), float(rng.choice((0, 0, 1, 2)))))
        if rng.random() < 0.05:  # an old frame once more
            frames.append((i // 300, *rng.choice(frames)[1:4], uid - rng.randrange(4), i * 100, "ask", 1, 9.0))
    last, session, book = None, 0, {"bid": {}, "ask": {}}
    for _, *f in sorted(frames, key=lambda f: (f[0], f[4], f[6], f[7])):
        _, _, first, final, _, side, price, qty = f
        if last is not None and final <= last:
            continue
        if last is not None and first > last + 1:
            session, book = session + 1, {"bid": {}, "ask": {}}
        last = final
        book[side].pop(price, None)
        if qty:
            book[side][price] = qty
        bid, ask = max(book["bid"], default=None), min(book["ask"], default=None)
        rows.append((final, session, bid, book["bid"].get(bid), ask, book["ask"].get(ask)))
    df = spark.createDataFrame(frames, "step long, symbol string, venue string, first_update_id long, final_update_id long, ts_ms long, side string, price_ticks long, qty double")
    twins.use_rocksdb(spark)
    try:
        got = replay.drain(twins.book_reconstruct(replay.arriving(df, F.col("step"), str(tmp_path))), str(tmp_path), "append")
        got = [tuple(r) for r in got.select("final_update_id", "session", "bid_ticks", "bid_qty", "ask_ticks", "ask_qty").orderBy("final_update_id").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert session > 3 and got == rows
