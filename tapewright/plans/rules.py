"""Registered rule, signal and cross-result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions.columns import bucket_start
from tapewright.operators import bars, book, rules, tape
from tapewright.plans import bars as pb
from tapewright.plans import book as pbook
from tapewright.plans import tape as ptape
from tapewright.plans.registry import query
from tapewright.sources.views import NEWEST_SNAPSHOT, Market

TRENDS = """(SELECT symbol, bucket_ms, CASE bucket_ms // 300000 % 3 WHEN 0 THEN 'BUY PRESSURE BUILDING' WHEN 1 THEN 'SELL PRESSURE BUILDING' ELSE 'NEUTRAL' END AS tbr_trend,
  CASE bucket_ms // 300000 % 4 WHEN 0 THEN 'OI RISING' WHEN 1 THEN 'OI FLAT' ELSE 'OI FALLING' END AS oi_trend FROM {taker_bars_5m})"""


@query("c12_tbr_oi_combo", f"""SELECT *, CASE WHEN tbr_trend LIKE 'BUY%' AND oi_trend = 'OI RISING' THEN 'NEW LONGS OPENING (real buyer demand)' WHEN tbr_trend LIKE 'BUY%' AND oi_trend = 'OI FLAT' THEN 'SHORT COVERING (paper support, not real demand)'
  WHEN tbr_trend LIKE 'BUY%' THEN 'SHORT COVERS + LIQUIDATIONS' WHEN tbr_trend LIKE 'SELL%' AND oi_trend = 'OI RISING' THEN 'NEW SHORTS OPENING (real paper selling)' WHEN tbr_trend LIKE 'SELL%' AND oi_trend = 'OI FLAT' THEN 'LONG UNWINDING (longs closing)'
  WHEN tbr_trend LIKE 'SELL%' THEN 'LIQUIDATION CASCADE' ELSE 'MIXED / NO CLEAR SIGNAL' END AS combo FROM {TRENDS} t""")  # fmt: skip
def _(m: Market):
    b = F.floor(F.col("bucket_ms") / 300_000)
    rows = m.taker_bars_5m.select(
        "symbol", "bucket_ms", F.when(b % 3 == 0, "BUY PRESSURE BUILDING").when(b % 3 == 1, "SELL PRESSURE BUILDING").otherwise("NEUTRAL").alias("tbr_trend"),
        F.when(b % 4 == 0, "OI RISING").when(b % 4 == 1, "OI FLAT").otherwise("OI FALLING").alias("oi_trend"),
    )
    return rules.tbr_oi_combo(rows)


HOURLY_FUT = ptape._HOURLY
STAGE_ROWS = f"""(SELECT s.*, count(*) FILTER (migration = 'UP') AS up_steps, count(*) FILTER (migration = 'DOWN') AS down_steps FROM {pb.STAGE_IN} s JOIN {HOURLY_FUT} h ON s.symbol = h.symbol AND h.venue = 'futures' GROUP BY ALL)"""


def stage_rows(m: Market):
    hourly = tape.hourly_keystone_migration(m.trades.where("venue = 'futures'"))
    steps = hourly.groupBy("symbol").agg(F.count_if(F.col("migration") == "UP").alias("up_steps"), F.count_if(F.col("migration") == "DOWN").alias("down_steps"))
    return bars.stage_window_inputs(pb.futures(m), m.oi_history_5m).join(steps, "symbol")


_POINTS = """CAST((abs(px_chg_4h) < 1)::INT + (up_pct_4h > 50 AND up_pct_4h < 70)::INT + 2 * (px_chg_4h > 1 AND oi_chg_4h > 0.5)::INT + (up_steps > down_steps)::INT + 2 * (px_chg_4h < -0.5 AND abs(oi_chg_4h) < 0.5)::INT
  + 2 * (down_steps > up_steps)::INT + (up_pct_4h < 50)::INT + 2 * (px_chg_4h < -1 AND oi_chg_4h > 0.5)::INT AS BIGINT)"""


@query("c17_infer_stage", f"""WITH s AS (SELECT *, {_POINTS} AS score FROM {STAGE_ROWS} r),
  g AS (SELECT *, CASE WHEN score >= 4 AND down_steps > up_steps AND px_chg_4h < -0.5 AND abs(oi_chg_4h) < 0.5 THEN 'DISTRIBUTION (late stage — high conviction)' WHEN score >= 3 AND down_steps > up_steps THEN 'DISTRIBUTION (early/mid stage)'
    WHEN score >= 3 AND px_chg_4h > 1 AND oi_chg_4h > 0.5 THEN 'MARKUP' WHEN score >= 3 AND px_chg_4h < -1 AND oi_chg_4h > 0.5 THEN 'MARKDOWN' WHEN score <= 2 AND abs(px_chg_4h) < 1 THEN 'ACCUMULATION' ELSE 'TRANSITION / UNCLEAR' END AS stage FROM s)
  SELECT symbol, px_chg_4h, oi_chg_4h, up_pct_4h, up_steps, down_steps, score, stage, CASE WHEN stage LIKE 'DISTRIBUTION (late%' THEN 'HIGH' WHEN stage IN ('DISTRIBUTION (early/mid stage)', 'MARKUP', 'MARKDOWN') THEN 'MEDIUM' WHEN stage = 'ACCUMULATION' THEN 'LOW-MEDIUM' ELSE 'LOW' END AS confidence FROM g""",
       "px_chg_4h oi_chg_4h up_pct_4h")
def _(m: Market):
    rows = stage_rows(m).withColumn("distribution_clusters", F.lit(0.0)).withColumn("absorption_clusters", F.lit(0.0))
    return rules.infer_stage(rows).select("symbol", "px_chg_4h", "oi_chg_4h", "up_pct_4h", "up_steps", "down_steps", "score", "stage", "confidence")


AUCTION_ROWS = f"""(SELECT b.symbol, b.micro_price_skew_bps AS spot_skew_bps, i.obi_20 AS spot_obi, s.buy_share AS spot_share, p.trend AS spot_trend, f.buy_share AS futures_share, t.r AS taker_ratio
  FROM (SELECT * FROM {pbook.SUMMARY} x WHERE {NEWEST_SNAPSHOT}) b JOIN (SELECT symbol, snapshot_id, (sum({pbook.BQ}) - sum({pbook.AQ})) / nullif(sum(qty), 0) AS obi_20 FROM {pbook.RANKED} r WHERE level_rank <= 20 GROUP BY ALL) i ON b.symbol = i.symbol AND b.snapshot_id = i.snapshot_id
  JOIN (SELECT symbol, venue, sum({ptape.BUY_USD}) / sum(price * qty) AS buy_share FROM {{trades}} GROUP BY ALL) s ON b.symbol = s.symbol AND s.venue = 'spot' JOIN (SELECT symbol, venue, sum({ptape.BUY_USD}) / sum(price * qty) AS buy_share FROM {{trades}} GROUP BY ALL) f ON b.symbol = f.symbol AND f.venue = 'futures'
  JOIN {ptape.PERSISTENCE} p ON b.symbol = p.symbol AND p.venue = 'spot' JOIN (SELECT symbol, arg_max(buy_vol, bucket_ms) / nullif(arg_max(sell_vol, bucket_ms), 0) AS r FROM {{taker_bars_5m}} GROUP BY ALL) t ON b.symbol = t.symbol)"""


def auction_rows(m: Market):
    at = m.newest
    b = at(book.book_summary(m.book_levels)).select("symbol", F.col("micro_price_skew_bps").alias("spot_skew_bps"))
    i = at(book.depth_imbalance_slices(m.book_levels)).select("symbol", F.col("obi_20").alias("spot_obi"))
    flow = tape.initiated_flow(m.trades)
    p = tape.flow_persistence(m.trades.where("venue = 'spot'")).select("symbol", F.col("trend").alias("spot_trend"))
    taker = m.taker_bars_5m.groupBy("symbol").agg((F.max_by("buy_vol", "bucket_ms") / F.nullif(F.max_by("sell_vol", "bucket_ms"), F.lit(0.0))).alias("taker_ratio"))
    out = b.join(i, "symbol").join(p, "symbol").join(taker, "symbol")
    for venue in ("spot", "futures"):
        out = out.join(flow.where(F.col("venue") == venue).select("symbol", F.col("buy_share").alias(f"{venue}_share")), "symbol")
    return out


def _two(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END, 0)"


_AUCTION_SCORE = " + ".join(
    _two(a, b) for a, b in (("spot_skew_bps > 0.5", "spot_skew_bps < -0.5"), ("spot_obi > 0.2", "spot_obi < -0.2"), ("spot_share > 0.55", "spot_share < 0.45"), ("spot_trend = 'accelerating-buy'", "spot_trend = 'accelerating-sell'"), ("taker_ratio > 1.05", "taker_ratio < 0.95"))
)
AUCTION = f"""(WITH s AS (SELECT *, CAST({_AUCTION_SCORE} AS BIGINT) AS score, coalesce((spot_share > 0.55) <> (futures_share > 0.55), false) AS contested FROM {AUCTION_ROWS} r)
  SELECT *, CASE WHEN contested THEN 'AUCTION CONTESTED — no consensus' WHEN score >= 4 THEN 'BUYERS WINNING THE AUCTION (clear dominance)' WHEN score >= 2 THEN 'BUYERS EDGE (slight lead)' WHEN score <= -4 THEN 'SELLERS WINNING THE AUCTION (clear dominance)'
    WHEN score <= -2 THEN 'SELLERS EDGE (slight lead)' ELSE 'AUCTION IN BALANCE (waiting for catalyst)' END AS verdict FROM s)"""


@query("c13_r2_auction_report", f"SELECT * FROM {AUCTION} a", "spot_skew_bps spot_obi spot_share futures_share taker_ratio")
def _(m: Market):
    return rules.auction_verdict(auction_rows(m)).drop("reasons")


FLOWS = f"(SELECT symbol, venue, ts_ms - ts_ms % 3600000 AS bucket_ms, sum({ptape.BUY}) - sum({ptape.SELL}) AS cvd, sum({ptape.BUY}) / sum(qty) AS share FROM {{trades}} GROUP BY ALL)"
DEMAND_ROWS = f"""(SELECT s.symbol, s.bucket_ms, s.cvd AS spot_cvd, f.cvd AS futures_cvd, s.share AS spot_share, f.share AS futures_share, d.funding, d.long_pct, d.long_pct - 0.1E0 + 0.2E0 * (s.bucket_ms // 3600000 % 2) AS top_long_pct
  FROM {FLOWS} s JOIN {FLOWS} f ON s.symbol = f.symbol AND s.bucket_ms = f.bucket_ms AND s.venue = 'spot' AND f.venue = 'futures' JOIN {pb.DERIVED} d ON s.symbol = d.symbol AND s.bucket_ms = d.bucket_ms)"""


def demand_rows(m: Market):
    buy = ~F.col("is_buyer_maker")
    flows = m.trades.groupBy("symbol", "venue", bucket_start("ts_ms", 3_600_000).alias("bucket_ms")).agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("cvd"), (F.sum(F.when(buy, F.col("qty")).otherwise(0.0)) / F.sum("qty")).alias("share")
    )
    side = lambda v: flows.where(F.col("venue") == v).select("symbol", "bucket_ms", F.col("cvd").alias(f"{v}_cvd"), F.col("share").alias(f"{v}_share"))
    j = side("spot").join(side("futures"), ["symbol", "bucket_ms"]).join(pb.derived(m).drop("oi"), ["symbol", "bucket_ms"])
    return j.withColumn("top_long_pct", F.col("long_pct") - 0.1 + F.floor(F.col("bucket_ms") / 3_600_000) % 2 * 0.2)


_sb, _ss, _fb, _fs = "(spot_cvd > 0 AND spot_share > 0.55)", "(spot_cvd < 0 AND spot_share < 0.45)", "(futures_cvd > 0 AND futures_share > 0.55)", "(futures_cvd < 0 AND futures_share < 0.45)"
_paper = "abs(futures_cvd) > greatest(abs(spot_cvd), 1) * 3"


@query("c14_j16_r7_demand_report", f"""SELECT *, CASE WHEN {_sb} AND {_fs} AND funding <= 0 AND long_pct > 0.65 THEN 'SPOT-ACCUMULATION-vs-FUT-DISTRIBUTION (real bid, but retail crowded long — squeeze risk both ways)'
  WHEN {_sb} AND {_fs} AND funding <= 0 THEN 'SPOT-ACCUMULATION-vs-FUT-DISTRIBUTION (real bid, smart-money absorbing leverage)' WHEN {_sb} AND NOT {_fs} THEN 'SPOT-DEMAND (durable bid)' WHEN {_ss} AND {_fb} THEN 'DISTRIBUTION-ON-RIP (real sellers to paper buyers — weak tape)'
  WHEN {_fs} AND {_paper} THEN 'FUTURES-DOMINATED (paper selling, thin spot — fragile)' WHEN {_fb} AND {_paper} THEN 'LEV-LONG-BUILD (paper longs only — reversible)' WHEN {_ss} AND {_fs} THEN 'BOTH-SELLING (broad distribution, weak tape)'
  WHEN {_sb} AND {_fs} THEN 'SPOT-BID / FUTURES-DISTRIBUTION (paper friction against real bid)' ELSE 'MIXED-ABSORPTION (no clear direction)' END AS verdict FROM {DEMAND_ROWS} d""",
       "spot_cvd futures_cvd spot_share futures_share funding long_pct top_long_pct")
def _(m: Market):
    return rules.demand_verdict(demand_rows(m)).drop("reasons")


RET = f"(SELECT symbol, bucket_ms, (close - open) / open * 100 AS pct FROM {pb.FUT} k)"


@query("c15_macro_climate", f"""WITH j AS (SELECT c.symbol, c.bucket_ms, a.pct AS first_pct, b.pct AS second_pct, c.pct AS target_pct FROM {RET} c LEFT JOIN {RET} a ON c.bucket_ms = a.bucket_ms AND a.symbol = 'S0' LEFT JOIN {RET} b ON c.bucket_ms = b.bucket_ms AND b.symbol = 'S1' WHERE c.symbol NOT IN ('S0', 'S1'))
  SELECT *, CASE WHEN first_pct IS NULL OR second_pct IS NULL THEN 'MACRO: data unavailable' WHEN first_pct < -1.5 AND second_pct < -1.5 AND target_pct > first_pct + 0.5 THEN 'MACRO RISK-OFF: relative bid' WHEN first_pct < -1.5 AND second_pct < -1.5 THEN 'MACRO RISK-OFF: broad selling'
    WHEN first_pct > 1 AND second_pct > 1 THEN 'MACRO RISK-ON' WHEN first_pct > -1.5 AND first_pct < 1 THEN 'MACRO NEUTRAL-CHOPPY' ELSE 'MACRO MIXED' END AS climate FROM j""", "first_pct second_pct target_pct")  # fmt: skip
def _(m: Market):
    r = pb.futures(m).select("symbol", "bucket_ms", ((F.col("close") - F.col("open")) / F.col("open") * 100).alias("pct"))
    of = lambda s, name: r.where(F.col("symbol") == s).select("bucket_ms", F.col("pct").alias(name))
    rows = r.where("symbol not in ('S0', 'S1')").withColumnRenamed("pct", "target_pct").join(of("S0", "first_pct"), "bucket_ms", "left").join(of("S1", "second_pct"), "bucket_ms", "left")
    return rules.macro_climate(rows.select("symbol", "bucket_ms", "first_pct", "second_pct", "target_pct"))


REGIME_ROWS = f"""(SELECT t.symbol, t.last_price, t.vwap, t.cvd, b.obi, d.funding, 1 + d.long_pct AS ls_ratio, 1 + d.long_pct * 1.5E0 AS top_ls_ratio, t.lb AS large_buy_usd, t.ls AS large_sell_usd FROM
  (SELECT symbol, arg_max(price, (ts_ms - 1704067200000) * 10000000 + trade_id) AS last_price, sum(price * qty) / sum(qty) AS vwap, sum({ptape.BUY}) - sum({ptape.SELL}) AS cvd, sum(CASE WHEN qty >= 45 THEN {ptape.BUY_USD} ELSE 0E0 END) AS lb, sum(CASE WHEN qty >= 45 THEN {ptape.SELL_USD} ELSE 0E0 END) AS ls
   FROM {{trades}} WHERE venue = 'futures' GROUP BY ALL) t JOIN (SELECT symbol, obi FROM {pbook.SUMMARY} s WHERE {NEWEST_SNAPSHOT}) b ON t.symbol = b.symbol JOIN {pb.newest(pb.DERIVED, 1)} d ON t.symbol = d.symbol)"""


def regime_rows(m: Market):
    fut, buy, n = m.trades.where("venue = 'futures'"), ~F.col("is_buyer_maker"), F.col("price") * F.col("qty")
    big = F.col("qty") >= 45
    t = fut.groupBy("symbol").agg(
        F.max_by("price", F.struct("ts_ms", "trade_id")).alias("last_price"), (F.sum(n) / F.sum("qty")).alias("vwap"), F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("cvd"),
        F.sum(F.when(big & buy, n).otherwise(0.0)).alias("large_buy_usd"), F.sum(F.when(big & ~buy, n).otherwise(0.0)).alias("large_sell_usd"),
    )
    b = m.newest(book.book_summary(m.book_levels)).select("symbol", "obi")
    d = bars.newest_bars(pb.derived(m), 1).select("symbol", "funding", (F.col("long_pct") + 1).alias("ls_ratio"), (F.col("long_pct") * 1.5 + 1).alias("top_ls_ratio"))
    return t.join(b, "symbol").join(d, "symbol")


_bull, _bear = "last_price > vwap * 1.0005", "last_price < vwap * 0.9995"
REGIME = f"""(SELECT *, CASE WHEN {_bull} AND cvd > 0 THEN 'TREND-UP (long build confirmed)' WHEN {_bear} AND cvd < 0 THEN 'TREND-DOWN (short build confirmed)' WHEN ls_ratio > 1.8 AND top_ls_ratio < ls_ratio * 0.8 AND (cvd < 0 OR {_bear}) THEN 'TRAP-LONG (smart money fading retail longs)'
  WHEN ls_ratio < 0.55 AND top_ls_ratio > ls_ratio * 1.2 AND (cvd > 0 OR {_bull}) THEN 'TRAP-SHORT (smart money fading retail shorts)' WHEN funding > 0.0005 AND cvd < 0 THEN 'LONG-SQUEEZE RISK (crowded + sellers winning)' WHEN funding < -0.0005 AND cvd > 0 THEN 'SHORT-SQUEEZE RISK (crowded + buyers winning)'
  WHEN abs(obi) > 0.2 THEN 'ABSORPTION / SQUEEZE' WHEN NOT ({_bull}) AND NOT ({_bear}) THEN 'CHOP / RANGE' WHEN {_bull} THEN 'WEAK-UP' WHEN {_bear} THEN 'WEAK-DOWN' ELSE 'MIXED' END AS regime FROM {REGIME_ROWS} r)"""


@query("c16_r8_regime_report", f"SELECT * FROM {REGIME} r", "last_price vwap cvd obi funding ls_ratio top_ls_ratio large_buy_usd large_sell_usd")
def _(m: Market):
    return rules.regime_verdict(regime_rows(m)).drop("labels")


SNAPS = f"""(SELECT s.symbol, s.bucket_ms AS ts_ms, s.share AS spot_buy_share, f.share AS futures_buy_share, (CAST(s.bucket_ms // 3600000 AS BIGINT) % 5 - 2) * 0.3E0 AS spot_obi, o.sum_open_interest AS open_interest
  FROM {FLOWS} s LEFT JOIN {FLOWS} f ON s.symbol = f.symbol AND s.bucket_ms = f.bucket_ms AND f.venue = 'futures' LEFT JOIN {{oi_history_5m}} o ON s.symbol = o.symbol AND s.bucket_ms = o.bucket_ms WHERE s.venue = 'spot')"""


def snapshots(m: Market):
    buy = ~F.col("is_buyer_maker")
    flows = m.trades.groupBy("symbol", "venue", bucket_start("ts_ms", 3_600_000).alias("ts_ms")).agg((F.sum(F.when(buy, F.col("qty")).otherwise(0.0)) / F.sum("qty")).alias("share"))
    spot = flows.where("venue = 'spot'").select("symbol", "ts_ms", F.col("share").alias("spot_buy_share"))
    fut = flows.where("venue = 'futures'").select("symbol", "ts_ms", F.col("share").alias("futures_buy_share"))
    oi = m.oi_history_5m.select("symbol", F.col("bucket_ms").alias("ts_ms"), F.col("sum_open_interest").alias("open_interest"))
    return spot.join(fut, ["symbol", "ts_ms"], "left").join(oi, ["symbol", "ts_ms"], "left").withColumn("spot_obi", (F.floor(F.col("ts_ms") / 3_600_000) % 5 - 2) * 0.3)


_div = "CASE WHEN coalesce(spot_buy_share, 0.5) <= 0.4 AND coalesce(futures_buy_share, 0.5) >= 0.6 THEN 'spot_selling_futures_buying' WHEN coalesce(spot_buy_share, 0.5) >= 0.6 AND coalesce(futures_buy_share, 0.5) <= 0.4 THEN 'spot_buying_futures_selling' END"


@query("w28_deterministic_signals", f"""WITH s AS (SELECT *, {_div} AS d FROM {SNAPS} x), l AS (SELECT *, lag(d) OVER w AS pd, lag(spot_obi) OVER w AS po, (open_interest - lag(open_interest) OVER w) / nullif(lag(open_interest) OVER w, 0) AS c FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))
  SELECT symbol, ts_ms, 'spot_futures_divergence' AS signal_type, 3 AS severity, d AS detail FROM l WHERE d IS NOT NULL AND d IS DISTINCT FROM pd
  UNION ALL SELECT symbol, ts_ms, 'spot_depth_imbalance', 2, CASE WHEN spot_obi > 0 THEN 'bid' ELSE 'ask' END FROM l WHERE abs(spot_obi) >= 0.45 AND abs(coalesce(po, 0)) < 0.45
  UNION ALL SELECT symbol, ts_ms, 'open_interest_shift', 2, CASE WHEN c > 0 THEN 'up' ELSE 'down' END FROM l WHERE abs(c) >= 0.01""")  # fmt: skip
def _(m: Market):
    return rules.deterministic_signals(snapshots(m))


def flips_sql(table: str, state: str, keys: str, order: str, cols: str) -> str:
    return f"SELECT {cols}, previous_state FROM (SELECT *, lag({state}) OVER (PARTITION BY {keys} ORDER BY {order}) AS previous_state FROM {table} t) f WHERE previous_state IS NOT NULL AND {state} IS NOT NULL AND {state} <> previous_state"


CVD_STATE = "CASE WHEN delta > 0 THEN 'BUY' WHEN delta < 0 THEN 'SELL' END"


@query("w26_tape_state_flips", flips_sql(f"(SELECT symbol, venue, t, {CVD_STATE} AS state FROM {ptape.CVD} c)", "state", "symbol, venue", "t", "symbol, venue, t, state"))
def _(m: Market):
    rows = tape.bucketed_cvd(m.trades).select("symbol", "venue", "t", F.when(F.col("delta") > 0, "BUY").when(F.col("delta") < 0, "SELL").alias("state"))
    return rules.state_flips(rows, "state", ["symbol", "venue"], "t")


@query("w26_delta_state_flips", flips_sql(f"(SELECT symbol, snapshot_id, state FROM {pbook.DELTA} d)", "state", "symbol", "snapshot_id", "symbol, snapshot_id, state"))
def _(m: Market):
    return rules.state_flips(book.delta_variable(m.book_levels, m.book_prices, m.taker_bars_5m).select("symbol", "snapshot_id", "state"), "state", ["symbol"], "snapshot_id")


@query("w26_obi_band_crossings", f"""WITH b AS (SELECT symbol, snapshot_id, obi, CASE WHEN obi IS NOT NULL THEN (obi > -0.2)::INT + (obi > 0)::INT + (obi > 0.2)::INT END AS band FROM {pbook.SUMMARY} s), l AS (SELECT *, lag(band) OVER (PARTITION BY symbol ORDER BY snapshot_id) AS previous_state FROM b)
  SELECT * FROM l WHERE previous_state IS NOT NULL AND band IS NOT NULL AND band <> previous_state""", "obi")  # fmt: skip
def _(m: Market):
    return rules.band_crossings(book.book_summary(m.book_levels).select("symbol", "snapshot_id", "obi"), "obi", [-0.2, 0.0, 0.2], ["symbol"], "snapshot_id")


@query("w26_keystone_qty_jumps", f"""SELECT * FROM (SELECT symbol, snapshot_id, window_qty, lag(window_qty) OVER (PARTITION BY symbol ORDER BY snapshot_id) AS previous FROM {pbook.KEYSTONE} k) x WHERE previous > 0 AND (window_qty >= previous * 1.3 OR window_qty <= previous / 1.3)""", "window_qty previous")
def _(m: Market):
    return rules.ratio_jumps(pbook.keystones(m).select("symbol", "snapshot_id", "window_qty"), "window_qty", 1.3, ["symbol"], "snapshot_id")


@query("w27_oi_class_flips", flips_sql(f"(SELECT symbol, bucket_ms, class FROM {pb.ALIGNED} a)", "class", "symbol", "bucket_ms", "symbol, bucket_ms, class"))
def _(m: Market):
    return rules.state_flips(pb.aligned(m).select("symbol", "bucket_ms", "class"), "class", ["symbol"], "bucket_ms")


@query("w29_discontinuity_spans", "SELECT symbol, lo, hi, 'discontinuity' AS reason FROM (SELECT symbol, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS lo, ts_ms AS hi FROM {quotes}) q WHERE hi - lo >= 4000")
def _(m: Market):
    return rules.discontinuity_spans(m.quotes, 4_000)


SPANS = """(WITH s AS (SELECT *, state <> 'running' AS bad, lead(updated_at_ms) OVER w AS nxt, lag(state <> 'running') OVER w AS was FROM {capture_status} WINDOW w AS (PARTITION BY symbol ORDER BY updated_at_ms, state)),
  i AS (SELECT *, sum(CASE WHEN bad AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY updated_at_ms, state ROWS UNBOUNDED PRECEDING) AS island FROM s)
  SELECT symbol, min(updated_at_ms) AS lo, CASE WHEN count(nxt) = count(*) THEN max(nxt) END AS hi, arg_min(state, updated_at_ms) AS reason FROM i WHERE bad GROUP BY symbol, island)"""


@query("w30_status_spans", f"SELECT * FROM {SPANS} s")
def _(m: Market):
    return rules.status_spans(m.capture_status)


@query("w31_rollover_events", """SELECT symbol, venue, trade_id, ts_ms, bucket_ms, previous_bucket FROM (SELECT *, (ts_ms + 19800000) // 14400000 * 14400000 - 19800000 AS bucket_ms,
  lag((ts_ms + 19800000) // 14400000 * 14400000 - 19800000) OVER (PARTITION BY symbol, venue ORDER BY ts_ms, trade_id) AS previous_bucket FROM {trades}) x WHERE previous_bucket IS NOT NULL AND previous_bucket <> bucket_ms""")  # fmt: skip
def _(m: Market):
    return rules.rollover_events(m.trades, bucket_start("ts_ms", 14_400_000, 19_800_000)).select("symbol", "venue", "trade_id", "ts_ms", "bucket_ms", "previous_bucket")


@query("p6_freshness_flag", "SELECT symbol, bucket_ms, 1704130000000 - bucket_ms AS age_ms, 1704130000000 - bucket_ms BETWEEN 0 AND 900000 AS is_fresh FROM {oi_history_5m}")
def _(m: Market):
    return rules.freshness_flag(m.oi_history_5m.select("symbol", "bucket_ms"), "bucket_ms", F.lit(1704130000000), 900_000)


@query("p12_latest_age", """SELECT e.symbol, e.series, l.ts_ms IS NOT NULL AS available, 1704160000000 - l.ts_ms AS age_ms FROM (SELECT DISTINCT symbol, s AS series FROM {quotes}, (SELECT unnest(['oi', 'taker', 'funding']) AS s) x) e
  LEFT JOIN (SELECT symbol, 'oi' AS series, max(bucket_ms) AS ts_ms FROM {oi_history_5m} GROUP BY ALL UNION ALL SELECT symbol, 'taker', max(bucket_ms) FROM {taker_bars_5m} GROUP BY ALL) l ON e.symbol = l.symbol AND e.series = l.series""")  # fmt: skip
def _(m: Market):
    expected = m.quotes.select("symbol").distinct().withColumn("series", F.explode(F.array(F.lit("oi"), F.lit("taker"), F.lit("funding"))))
    of = lambda df, name: df.groupBy("symbol").agg(F.max("bucket_ms").alias("ts_ms")).withColumn("series", F.lit(name))
    return rules.latest_age(expected, of(m.oi_history_5m, "oi").unionByName(of(m.taker_bars_5m, "taker")), ["symbol", "series"], "ts_ms", F.lit(1704160000000))


@query("p14_contract_check", """SELECT symbol, ts_ms, CASE WHEN futures_buy_share IS NULL AND open_interest IS NULL THEN 'missing futures_buy_share,missing open_interest' WHEN futures_buy_share IS NULL THEN 'missing futures_buy_share' WHEN open_interest IS NULL THEN 'missing open_interest' ELSE '' END AS violations,
  futures_buy_share IS NOT NULL AND open_interest IS NOT NULL AS is_valid FROM """ + SNAPS + " s")  # fmt: skip
def _(m: Market):
    checked = rules.contract_check(snapshots(m), ["futures_buy_share", "open_interest"])
    return checked.select("symbol", "ts_ms", F.array_join("violations", ",").alias("violations"), "is_valid")


@query("j12_dependency_asof", """SELECT t.symbol, t.bucket_ms AS ts_ms, o.sum_open_interest AS value, o.bucket_ms AS up_ts, coalesce(t.bucket_ms - o.bucket_ms <= 300000, false) AS usable
  FROM {taker_bars_5m} t ASOF LEFT JOIN {oi_history_5m} o ON t.symbol = o.symbol AND t.bucket_ms >= o.bucket_ms""", "value")  # fmt: skip
def _(m: Market):
    results = m.taker_bars_5m.select("symbol", F.col("bucket_ms").alias("ts_ms"))
    upstream = m.oi_history_5m.select("symbol", F.col("bucket_ms").alias("ts_ms"), F.col("sum_open_interest").alias("value"))
    return rules.dependency_asof(results, upstream, 300_000)


@query("p9_live_price", """WITH q AS (SELECT symbol, arg_max((bid_ticks + ask_ticks) / 200E0, update_id) AS mid FROM {quotes} GROUP BY ALL), k AS (SELECT symbol, arg_max(close, bucket_ms) AS price FROM """ + pb.FUT + """ f WHERE symbol IN ('S0', 'S1') GROUP BY ALL),
  e AS (SELECT symbol, price FROM {book_prices} WHERE """ + NEWEST_SNAPSHOT + """ AND symbol IN ('S1', 'S2'))
  SELECT q.symbol, coalesce(k.price, e.price, mid) AS price, CASE WHEN k.price IS NOT NULL THEN 'mark' WHEN e.price IS NOT NULL THEN 'evidence' ELSE 'book_mid' END AS price_source FROM q LEFT JOIN k ON q.symbol = k.symbol LEFT JOIN e ON q.symbol = e.symbol""", "price")  # fmt: skip
def _(m: Market):
    quotes = m.quotes.groupBy("symbol").agg(F.max_by((F.col("bid_ticks") + F.col("ask_ticks")) / 200, "update_id").alias("price"))
    mark = pb.futures(m).where("symbol in ('S0', 'S1')").groupBy("symbol").agg(F.max_by("close", "bucket_ms").alias("price"))
    evidence = m.newest(m.book_prices).where("symbol in ('S1', 'S2')").select("symbol", "price")
    return rules.live_price(quotes.select("symbol"), mark, evidence, quotes)


@query("p10_classify_horizon", """SELECT symbol, h AS horizon_ms, CASE WHEN h IN (1000, 5000, 30000, 60000) THEN 'native' WHEN h IN (900000, 3600000, 14400000) THEN 'long' ELSE 'unsupported' END AS kind FROM (SELECT DISTINCT symbol FROM {quotes}) s, (SELECT unnest([1000, 7000, 60000, 900000]) AS h) x""")
def _(m: Market):
    rows = m.quotes.select("symbol").distinct().withColumn("horizon_ms", F.explode(F.array(*[F.lit(h) for h in (1000, 7000, 60000, 900000)])))
    return rows.withColumn("kind", rules.classify_horizon(F.col("horizon_ms")))


@query("p15_base_asset", "SELECT l_orderkey, l_linenumber, lower(regexp_replace(concat(l_returnflag, l_linestatus, CASE WHEN l_orderkey % 2 = 0 THEN 'USDT' ELSE 'USD' END), '(?:USDT|USDC|BUSD|USD)$', '')) AS asset FROM lineitem")
def _(m: Market):
    symbol = F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_orderkey") % 2 == 0, "USDT").otherwise("USD"))
    return m.lineitem.select("l_orderkey", "l_linenumber", rules.base_asset(symbol).alias("asset"))
