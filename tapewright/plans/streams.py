"""Registered streaming queries: each runs its stream over the whole table, as ``availableNow``, and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.plans import micro as pm
from tapewright.plans import tape as ptape
from tapewright.plans.registry import QUERIES, folder, query
from tapewright.sources.views import START_MS, VIEWS, Market
from tapewright.streaming import replay, twins


def stream(m: Market, view: str, table: str) -> DataFrame:
    """A market view over the table's files as they arrive."""
    schema = m.spark.read.parquet(f"{m.sf_dir}/{table}.parquet").schema
    rows = m.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{m.sf_dir}/{table}.parquet*")
    return m.spark.sql(VIEWS[view], **{table: rows})


#: Rows of one file of a replay, and rows of one key that a trigger takes, about; no tape comes in fewer triggers than this.
FILE_ROWS, KEY_ROWS, LEAST_TRIGGERS = 500_000, 500_000, 3
#: Triggers of a tape whose operator sums rows where they lie, so that no task holds a key's rows.
MOST_TRIGGERS = 12


def heartbeat(m: Market, rows):
    """One row days after the tape: it moves the watermark past all windows."""
    return m.spark.range(1).select(*[F.lit(START_MS + 10 * 86_400_000 if c == "ts_ms" else None).cast(t).alias(c) for c, t in rows.dtypes])


def files_of(rows: int, triggers: int) -> int:
    """Files of a trigger: as many tasks read it."""
    return max(1, -(-rows // (triggers * FILE_ROWS)))


def in_order(m: Market, view: str, closing: bool = False, key_rows: int | None = KEY_ROWS, keys: tuple[str, ...] = ("symbol", "venue")):
    """A market view as it arrives, in triggers of equal spans of time.

    ``key_rows``: rows of the busiest of the ``keys`` that a trigger holds, about; None where no task holds a key's rows.
    """
    rows = getattr(m, view)
    counts = rows.groupBy(*keys).agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"), F.count("*").alias("n"))
    lo, hi, n, busiest = (v or 0 for v in counts.agg(F.min("lo"), F.max("hi"), F.sum("n"), F.max("n")).first())
    triggers = max(LEAST_TRIGGERS, min(MOST_TRIGGERS, -(-n // FILE_ROWS)) if key_rows is None else -(-busiest // key_rows))
    step = max(1, -(-(hi - lo + 1) // triggers))
    return replay.arriving(rows, F.expr(f"(ts_ms - {lo}) div {step}"), folder(m), heartbeat(m, rows) if closing else None, files_of(n, triggers))


@query("x1_stream_bucketed_flow", f"SELECT symbol, venue, t * 1000 AS start_ms, buy, sell, delta, trades FROM {ptape.CVD} c", "buy sell delta")
def _(m: Market):
    """Each window once, as the watermark closes it; the heartbeat closes the last ones."""
    return twins.drain(twins.bucketed_flow(in_order(m, "trades", closing=True, key_rows=None)), folder(m), "append")


#: Every tenth trade is reported two hours late.
REPORTED = "ts_ms + CASE WHEN trade_id % 10 = 0 THEN 7200000 ELSE 0 END"


@query("x1_late_flow", f"""WITH b AS (SELECT *, ({REPORTED} - {START_MS}) // 10800000 AS batch FROM {{trades}}), g AS (SELECT batch, max(ts_ms) AS high FROM b GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY batch) AS k FROM g),
  h AS (SELECT batch, max(high) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 600000 AS mark FROM n), l AS (SELECT b.*, coalesce(ts_ms // 60000 * 60000 + 60000 <= mark, false) AS late FROM b JOIN h ON b.batch = h.batch)
  SELECT symbol, venue, count(*) FILTER (NOT late) AS in_time, sum(CASE WHEN late THEN 0E0 ELSE qty END) AS qty_in_time, count(*) FILTER (late) AS late, sum(CASE WHEN late THEN qty ELSE 0E0 END) AS qty_late FROM l GROUP BY ALL""", "qty_in_time qty_late")
def _(m: Market):
    """What the windows of a tape with late reports take in, and what they leave out, counted in a side output of its own."""
    hours = 26  # of a day's tape and its late reports, three in a trigger
    arriving = replay.arriving(m.trades, F.expr(f"({REPORTED} - {START_MS}) div 10800000"), folder(m), heartbeat(m, m.trades), files_of(m.trades.count(), -(-hours // 3)))
    kept = twins.drain(twins.bucketed_flow(arriving), folder(m), "append").groupBy("symbol", "venue")
    late = replay.late_rows(arriving, folder(m), 60_000, 600_000).groupBy("symbol", "venue")
    kept = kept.agg(F.sum("trades").alias("in_time"), F.sum(F.col("buy") + F.col("sell")).alias("qty_in_time"))
    late = late.agg(F.count("*").alias("late"), F.sum("qty").alias("qty_late"))
    return kept.join(late, ["symbol", "venue"], "left").fillna(0, ["late", "qty_late"])


@query("x6_stream_ofi", f"SELECT symbol, venue, start_ms, event_count, ofi FROM {pm.INTERVALS} i WHERE event_count > 0", "ofi")
def _(m: Market):
    # The events come from a batch window; the stream sums them as they arrive.
    path = f"{folder(m)}/tapewright-events-{uuid.uuid4().hex}"
    pm.events(m).write.parquet(path)
    schema = m.spark.read.parquet(path).schema
    return twins.drain(twins.ofi(m.spark.readStream.schema(schema).parquet(path)), folder(m), "complete")


@query("x10_latest_projection_stream", "SELECT symbol, count(*) AS event_count, max(updated_at_ms) AS updated_at_ms, arg_max(state, updated_at_ms) AS state FROM {capture_status} GROUP BY ALL")
def _(m: Market):
    return twins.drain(twins.latest_projection(stream(m, "capture_status", "events"), ["symbol"], ["updated_at_ms"], ["state"]), folder(m), "complete")


@query("s9_s11_stream_dedupe", "SELECT DISTINCT symbol, venue, trade_id FROM {trades}")
def _(m: Market):
    rows = stream(m, "trades", "lineitem").select("symbol", "venue", "trade_id", "ts_ms")
    return twins.drain(twins.deduplicated(rows, ["symbol", "venue", "trade_id"], within="2 days"), folder(m), "append").select("symbol", "venue", "trade_id")


FOLD = """WITH a AS (SELECT *, max(trade_id) OVER (PARTITION BY symbol, venue ORDER BY ts_ms, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, ts_ms // 900000 * 900000 AS segment_ms FROM {trades}),
  d AS (SELECT symbol, count(*) FILTER (high IS NOT NULL AND trade_id <= high) AS duplicates FROM a GROUP BY ALL),
  f AS (SELECT *, max(segment_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM a WHERE high IS NULL OR trade_id > high),
  l AS (SELECT symbol, max(ts_ms) AS last_ts, count(*) FILTER (front IS NOT NULL AND segment_ms < front) AS late FROM f GROUP BY ALL)
  SELECT f.symbol, 14400000 AS horizon_ms, segment_ms, venue, count(*) AS trades, sum(CASE WHEN is_buyer_maker THEN 0E0 ELSE price * qty END) AS buy_notional, sum(CASE WHEN is_buyer_maker THEN price * qty ELSE 0E0 END) AS sell_notional, any_value(duplicates) AS duplicates, any_value(late) AS late
  FROM f JOIN l ON f.symbol = l.symbol JOIN d ON f.symbol = d.symbol WHERE (front IS NULL OR segment_ms >= front) AND segment_ms >= last_ts - 14400000 GROUP BY f.symbol, segment_ms, venue"""


#: Trades of a symbol in a trigger of the fold, which sheds the repeats of each file before the state sees them.
FOLD_ROWS = 2_000_000


@query("x2_stream_horizon_fold", FOLD, "buy_notional sell_notional")
def _(m: Market):
    twins.use_rocksdb(m.spark)
    trades = in_order(m, "trades", key_rows=FOLD_ROWS, keys=("symbol",)).withColumn("arrival", F.col("ts_ms"))
    return twins.drain(twins.horizon_fold(trades, 14_400_000, 900_000), folder(m), "update", ["symbol"])


@query("x7_stream_warm_start", f"SELECT symbol, segment_ms, venue, trades, buy_notional, sell_notional FROM ({FOLD}) f", "buy_notional sell_notional")
def _(m: Market):
    """The fold seeded from the tape up to a time, then streamed over the whole tape again: the overlap changes nothing."""
    twins.use_rocksdb(m.spark)
    trades = in_order(m, "trades", key_rows=FOLD_ROWS, keys=("symbol",)).withColumn("arrival", F.col("ts_ms"))
    history = m.trades.where("ts_ms < 1704110000000").withColumn("arrival", F.col("ts_ms"))
    return twins.drain(twins.horizon_fold(trades, 14_400_000, 900_000, history), folder(m), "update", ["symbol"]).drop("horizon_ms", "duplicates", "late")


@query("x8_alert_dedupe", "SELECT DISTINCT symbol, venue, ts_ms, CASE WHEN bid_qty > ask_qty THEN 'bid_heavy' ELSE 'ask_heavy' END AS trigger FROM {quotes}")
def _(m: Market):
    quotes = stream(m, "quotes", "events").select("symbol", "venue", "ts_ms", F.when(F.col("bid_qty") > F.col("ask_qty"), "bid_heavy").otherwise("ask_heavy").alias("trigger"))
    again = quotes.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return twins.drain(twins.alert_dedupe(again, "2 days"), folder(m), "append")


@query("x4_stream_book_reconstruct", QUERIES["x4_book_replay"].sql, "bid_qty ask_qty")
def _(m: Market):
    twins.use_rocksdb(m.spark)
    return twins.drain(twins.book_reconstruct(in_order(m, "depth_deltas")), folder(m), "append")


@query("x6_book_to_ofi_stream", f"""WITH k AS ({QUERIES["x4_book_replay"].sql}),
  q AS (SELECT *, lag(bid_ticks) OVER w AS pb, lag(ask_ticks) OVER w AS pa, lag(bid_qty) OVER w AS pbq, lag(ask_qty) OVER w AS paq FROM k WINDOW w AS (PARTITION BY symbol, venue, session ORDER BY final_update_id)),
  e AS (SELECT *, CASE WHEN bid_ticks >= pb THEN bid_qty ELSE 0E0 END - CASE WHEN bid_ticks <= pb THEN pbq ELSE 0E0 END - CASE WHEN ask_ticks <= pa THEN ask_qty ELSE 0E0 END + CASE WHEN ask_ticks >= pa THEN paq ELSE 0E0 END AS contribution
    FROM q WHERE pb IS NOT NULL AND pa IS NOT NULL AND bid_ticks IS NOT NULL AND ask_ticks IS NOT NULL AND (bid_ticks <> pb OR ask_ticks <> pa OR bid_qty <> pbq OR ask_qty <> paq)),
  i AS (SELECT symbol, venue, session, ts_ms // 10000 * 10000 AS start_ms, ts_ms // 10000 * 10000 + 10000 AS end_ms, count(*) AS event_count, sum(contribution) AS ofi, avg((bid_qty + ask_qty) / 2) AS average_depth, arg_min((pb + pa) / 2E0, final_update_id) AS mid_start,
    arg_max((bid_ticks + ask_ticks) / 2E0, final_update_id) AS mid_end, min(final_update_id) AS first_update_id, max(final_update_id) AS last_update_id FROM e GROUP BY symbol, venue, session, ts_ms // 10000 * 10000)
  SELECT * FROM i QUALIFY start_ms < max(start_ms) OVER (PARTITION BY symbol, venue, session)""",
       "ofi average_depth mid_start mid_end")
def _(m: Market):
    """Depth deltas to order flow in one plan; the interval that a gap cuts, and the one still open at the end, aren't there."""
    twins.use_rocksdb(m.spark)
    return twins.drain(twins.ofi_from_depth(in_order(m, "depth_deltas")), folder(m), "append")


def heavy_side(rows):
    return rows.select("symbol", "venue", "ts_ms", F.when(F.col("bid_qty") > F.col("ask_qty"), "bid_heavy").otherwise("ask_heavy").alias("state"))


def alerts_sql(stale_ms: int, period_ms: int = 900_000, cooldown_ms: int = 60_000, late_ms: int = 10_000) -> str:
    return f"""WITH RECURSIVE s AS (SELECT symbol, venue, ts_ms, CASE WHEN bid_qty > ask_qty THEN 'bid_heavy' ELSE 'ask_heavy' END AS state FROM {{quotes}}),
      q AS (SELECT *, lag(ts_ms) OVER w AS t0, lag(state) OVER w AS s0, lead(ts_ms) OVER w AS t1, max(ts_ms) OVER () AS newest FROM s WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts_ms)),
      c AS (SELECT symbol, venue, ts_ms FROM q WHERE state <> s0), n AS (SELECT *, min(ts_ms) OVER (PARTITION BY symbol, venue ORDER BY ts_ms RANGE BETWEEN {cooldown_ms} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms FROM c),
      f AS (SELECT symbol, venue, min(ts_ms) AS ts_ms FROM c GROUP BY ALL UNION ALL SELECT n.symbol, n.venue, n.next_ms FROM f JOIN n ON f.symbol = n.symbol AND f.venue = n.venue AND f.ts_ms = n.ts_ms WHERE n.next_ms IS NOT NULL)
      SELECT symbol, venue, ts_ms, 'first_data' AS trigger, state, NULL::VARCHAR AS previous_state FROM q WHERE t0 IS NULL
      UNION ALL SELECT symbol, venue, ts_ms + {stale_ms}, 'staleness', state, state FROM q WHERE CASE WHEN t1 IS NULL THEN ts_ms + {stale_ms} < newest - {late_ms} ELSE t1 - ts_ms > {stale_ms} END
      UNION ALL SELECT symbol, venue, ts_ms, 'recovery', state, s0 FROM q WHERE ts_ms - t0 > {stale_ms}
      UNION ALL SELECT symbol, venue, ts_ms, 'rollover', state, s0 FROM q WHERE ts_ms // {period_ms} <> t0 // {period_ms}
      UNION ALL SELECT q.symbol, q.venue, q.ts_ms, 'state_flip', state, s0 FROM q JOIN f ON q.symbol = f.symbol AND q.venue = f.venue AND q.ts_ms = f.ts_ms"""


@query("x9_alert_stream", alerts_sql(120_000))
def _(m: Market):
    twins.use_rocksdb(m.spark)
    return twins.drain(twins.alert_stream(heavy_side(in_order(m, "quotes"))), folder(m), "append")


@query("x9_staleness_alerts", alerts_sql(6_000))
def _(m: Market):
    """The same with six seconds of silence, which these tapes have."""
    twins.use_rocksdb(m.spark)
    return twins.drain(twins.alert_stream(heavy_side(in_order(m, "quotes")), stale_ms=6_000), folder(m), "append")


@query("s10_publish_latest", "SELECT *, count(*) OVER () AS keys, (SELECT count(*) FROM {quotes}) AS history_rows FROM (SELECT symbol, venue, ts_ms, update_id, bid_ticks, ask_ticks FROM {quotes} QUALIFY row_number() OVER (PARTITION BY symbol, venue ORDER BY ts_ms DESC, update_id DESC) = 1) x")
def _(m: Market):
    """The latest view that a sink keeps batch by batch, beside the history; one batch runs again at the end and changes nothing."""
    names = ["symbol", "venue", "ts_ms", "update_id", "bid_ticks", "ask_ticks"]
    quotes = in_order(m, "quotes", key_rows=None).select(*names)
    sink = replay.LatestAndHistory(f"{folder(m)}/tapewright-latest-{uuid.uuid4().hex}", ["symbol", "venue"], ["ts_ms", "update_id"], quotes.schema)
    sink.drained(quotes)
    first = m.spark.read.schema(quotes.schema).parquet(f"{sink.path}/history/{replay.BATCH}=0")
    first.write.parquet(f"{sink.path}/copy")  # a batch overwrites its own folder
    sink.write(m.spark.read.schema(quotes.schema).parquet(f"{sink.path}/copy"), 0)
    rows = sink.history(m.spark).agg(F.count("*").alias("history_rows"))
    latest = sink.latest(m.spark)
    return latest.join(F.broadcast(rows)).join(F.broadcast(latest.agg(F.count("*").alias("keys"))))  # one row each
