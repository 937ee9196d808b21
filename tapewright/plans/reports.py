"""Registered reports: one row a key, joined from the operators' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import bars, book, rules, tape
from tapewright.plans import bars as pb
from tapewright.plans import book as pbook
from tapewright.plans import rules as pr
from tapewright.plans import tape as ptape
from tapewright.plans.registry import query
from tapewright.sources.views import NEWEST_SNAPSHOT, Market

KS = ["symbol", "snapshot_id"]


def on(*names: str, a: str = "a") -> str:
    return " AND ".join(f"{a}.{k} = {n}.{k}" for n in names for k in KS)


@query("r1_orderbook_report", f"""WITH t AS (SELECT symbol, snapshot_id, max(window_qty) FILTER (side = 'bid') AS densest_bid_qty, max(window_qty) FILTER (side = 'ask') AS densest_ask_qty FROM {pbook.DENSE} d GROUP BY ALL),
  l AS (SELECT symbol, snapshot_id, count(*) FILTER (qty >= 100) AS significant FROM {{book_levels}} GROUP BY ALL)
  SELECT a.symbol, a.snapshot_id, a.microprice, a.spread_bps, k.keystone, k.window_qty AS keystone_qty, t.densest_bid_qty, t.densest_ask_qty, l.significant FROM {pbook.SUMMARY} a JOIN {pbook.KEYSTONE} k ON a.symbol = k.symbol AND a.snapshot_id = k.snapshot_id
  JOIN t ON a.symbol = t.symbol AND a.snapshot_id = t.snapshot_id JOIN l ON a.symbol = l.symbol AND a.snapshot_id = l.snapshot_id""", "microprice spread_bps keystone keystone_qty densest_bid_qty densest_ask_qty")  # fmt: skip
def _(m: Market):
    dense = book.top_density_windows(m.book_levels, top_n=1).groupBy(*KS).agg(*[F.max(F.when(F.col("side") == s, F.col("window_qty"))).alias(f"densest_{s}_qty") for s in ("bid", "ask")])
    big = m.book_levels.groupBy(*KS).agg(F.count_if(F.col("qty") >= 100).alias("significant"))
    key = pbook.keystones(m).select(*KS, "keystone", F.col("window_qty").alias("keystone_qty"))
    return book.book_summary(m.book_levels).select(*KS, "microprice", "spread_bps").join(key, KS).join(dense, KS).join(big, KS)


@query("r3_delta_report", f"SELECT a.symbol, a.snapshot_id, b.price, a.wall_imbalance, a.flow_alignment, a.delta, a.state, a.tbr_last_pct, a.tbr_3avg_pct FROM {pbook.DELTA} a JOIN {{book_prices}} b ON a.symbol = b.symbol AND a.snapshot_id = b.snapshot_id",
       "price wall_imbalance flow_alignment delta tbr_last_pct tbr_3avg_pct")
def _(m: Market):
    delta = book.delta_variable(m.book_levels, m.book_prices, m.taker_bars_5m).drop("n_bands", "delta_raw")
    return delta.join(m.book_prices, KS)


@query("r4_oi_report", f"""WITH w AS (SELECT symbol, arg_min(price, rank) AS top_wall_price, max(qty) AS top_wall_qty FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY q DESC, price_ticks) AS rank, price, q AS qty FROM
    (SELECT *, sum(qty) OVER (PARTITION BY symbol, snapshot_id ORDER BY price_ticks RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS q FROM {pbook.NEAR} n WHERE side = 'ask' AND {NEWEST_SNAPSHOT}) c WHERE price_ticks - pt BETWEEN 5 AND 100) x WHERE rank = 1 GROUP BY ALL),
  o AS (SELECT symbol, sum_open_interest AS oi FROM {pb.newest("{oi_history_5m}", 1)} n), c AS (SELECT t.symbol, w.sum_open_interest - t.sum_open_interest AS change_12 FROM {pb.newest("{oi_history_5m}", 13)} t JOIN {pb.newest("{oi_history_5m}", 1)} w ON t.symbol = w.symbol WHERE t.age = 13)
  SELECT o.symbol, oi, change_12, top_wall_price, top_wall_qty FROM o LEFT JOIN c ON o.symbol = c.symbol LEFT JOIN w ON o.symbol = w.symbol""", "oi change_12 top_wall_price top_wall_qty")  # fmt: skip
def _(m: Market):
    oi = bars.newest_bars(m.oi_history_5m, 1).select("symbol", F.col("sum_open_interest").alias("oi"))
    change = bars.oi_inflow_outflow(m.oi_history_5m, (12,)).select("symbol", F.col("change").alias("change_12"))
    walls = book.find_walls(m.newest(m.book_levels), m.newest(m.book_prices), top_n=1).select("symbol", F.col("price").alias("top_wall_price"), F.col("qty").alias("top_wall_qty"))
    return oi.join(change, "symbol", "left").join(walls, "symbol", "left")


@query("r5_wall_report", f"""SELECT a.symbol, a.snapshot_id, a.bid_pool, a.ask_pool, a.ratio, c.walls_built, c.walls_eroded, k.keystone, b.wall_imbalance, b.state FROM {pbook.FUEL} a JOIN {pbook.COUNTS} c ON a.symbol = c.symbol AND a.snapshot_id = c.snapshot_id
  JOIN {pbook.KEYSTONE} k ON a.symbol = k.symbol AND a.snapshot_id = k.snapshot_id JOIN {pbook.DELTA} b ON a.symbol = b.symbol AND a.snapshot_id = b.snapshot_id""", "bid_pool ask_pool ratio keystone wall_imbalance")  # fmt: skip
def _(m: Market):
    fuel = book.wall_fuel_ratio(m.book_levels, m.book_prices).drop("verdict")
    delta = book.delta_variable(m.book_levels, m.book_prices, m.taker_bars_5m).select(*KS, "wall_imbalance", "state")
    return fuel.join(book.adjacent_wall_counts(m.book_levels), KS).join(pbook.keystones(m).select(*KS, "keystone"), KS).join(delta, KS)


@query("r6_path_report", f"""SELECT a.symbol, a.snapshot_id, a.ratio, f.fall_short_level, x.reached FROM {pbook.FUEL} a JOIN (SELECT symbol, snapshot_id, arg_min(level, n) FILTER (bid_fuel_remaining < 0) AS fall_short_level FROM {pbook.ASCENT} s GROUP BY ALL) f ON a.symbol = f.symbol AND a.snapshot_id = f.snapshot_id
  JOIN (SELECT symbol, snapshot_id, count(*) FILTER (verdict = 'BUYERS_REACH') AS reached FROM {pbook.ASCENT} s GROUP BY ALL) x ON a.symbol = x.symbol AND a.snapshot_id = x.snapshot_id""", "ratio fall_short_level")  # fmt: skip
def _(m: Market):
    ascent = book.path_ascent(m.book_levels, m.book_prices)
    walked = ascent.groupBy(*KS).agg(F.min_by("level", F.when(F.col("bid_fuel_remaining") < 0, F.col("n"))).alias("fall_short_level"), F.count_if(F.col("verdict") == "BUYERS_REACH").alias("reached"))
    return book.wall_fuel_ratio(m.book_levels, m.book_prices).select(*KS, "ratio").join(walked, KS)


@query("r8_stage_report", f"SELECT a.*, v.net_buckets FROM {pr.STAGE_ROWS} a JOIN (SELECT symbol, count(*) FILTER (migration = 'UP') - count(*) FILTER (migration = 'DOWN') AS net_buckets FROM {pr.HOURLY_FUT} h WHERE venue = 'futures' GROUP BY ALL) v ON a.symbol = v.symbol", "px_chg_4h oi_chg_4h up_pct_4h")
def _(m: Market):
    verdict = tape.migration_verdict(tape.hourly_keystone_migration(m.trades.where("venue = 'futures'"))).select("symbol", "net_buckets")
    return pr.stage_rows(m).join(verdict, "symbol")


@query("r9_liquidation_report", f"""WITH o AS (SELECT symbol, bucket_ms, sum_open_interest AS v, lag(sum_open_interest) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS prev FROM {{oi_history_5m}}),
  s AS (SELECT o.symbol, sum({pb.pct("v", "prev")}) AS oi_change_pct, sum({pb.pct("close", "open")}) AS price_change_pct FROM o LEFT JOIN {pb.FUT} k ON o.symbol = k.symbol AND o.bucket_ms = k.bucket_ms WHERE prev IS NOT NULL GROUP BY ALL)
  SELECT s.*, t.average_ratio FROM s JOIN (SELECT symbol, avg(buy_vol / greatest(buy_vol + sell_vol, 0.001)) AS average_ratio FROM {pb.newest('{taker_bars_5m}', 12)} n GROUP BY ALL) t ON s.symbol = t.symbol""", "oi_change_pct price_change_pct average_ratio")  # fmt: skip
def _(m: Market):
    d = bars.oi_price_divergence(m.oi_history_5m, pb.futures(m)).drop("bars", "signal")
    return d.join(bars.liquidation_inputs(m.taker_bars_5m).select("symbol", "average_ratio"), "symbol")


@query("r10_market_snapshot", f"""WITH f AS (SELECT symbol, venue, count(*) AS trades, sum({ptape.BUY}) - sum({ptape.SELL}) AS cvd, sum({ptape.BUY}) / sum(qty) AS buy_share, sum(price * qty) / sum(qty) AS vwap, count(*) - count(DISTINCT trade_id) AS duplicates FROM {{trades}} GROUP BY ALL)
  SELECT c.symbol, c.aligned_buckets, c.spot_vs_futures_corr, s.trades AS spot_trades, s.cvd AS spot_cvd, s.buy_share AS spot_buy_share, s.vwap AS spot_vwap, s.duplicates AS spot_duplicates, u.trades AS futures_trades, u.cvd AS futures_cvd, u.buy_share AS futures_buy_share, u.vwap AS futures_vwap, u.duplicates AS futures_duplicates, h.spot_share
  FROM ({ptape.CORR}) c JOIN f s ON c.symbol = s.symbol AND s.venue = 'spot' JOIN f u ON c.symbol = u.symbol AND u.venue = 'futures' JOIN ({ptape.SHARE}) h ON c.symbol = h.symbol""",
       "spot_vs_futures_corr spot_cvd spot_buy_share spot_vwap futures_cvd futures_buy_share futures_vwap spot_share")
def _(m: Market):
    flow = tape.flow_summary(m.trades).select("symbol", "venue", F.col("trade_count").alias("trades"), "cvd", "buy_share", "vwap")
    both = flow.join(tape.window_coverage(m.trades).select("symbol", "venue", F.col("duplicate_trades").alias("duplicates")), ["symbol", "venue"])
    side = lambda v: both.where(F.col("venue") == v).select("symbol", *[F.col(c).alias(f"{v}_{c}") for c in ("trades", "cvd", "buy_share", "vwap", "duplicates")])
    out = tape.cvd_series_corr(tape.bucketed_cvd(m.trades)).join(side("spot"), "symbol").join(side("futures"), "symbol")
    return out.join(tape.turnover_share(m.trades).select("symbol", "spot_share"), "symbol")


@query("w27_regime_flips", pr.flips_sql(f"(SELECT symbol, bucket_ms, class FROM {pb.ALIGNED} a WHERE class <> 'TWO_SIDED_FLAT')", "class", "symbol", "bucket_ms", "symbol, bucket_ms, class"))
def _(m: Market):
    rows = pb.aligned(m).where("class <> 'TWO_SIDED_FLAT'").select("symbol", "bucket_ms", "class")
    return rules.state_flips(rows, "class", ["symbol"], "bucket_ms")


@query("w22_multi_timeframe_delta", f"""WITH x AS (SELECT symbol, h AS horizon_min, max(snapshot_id) AS snapshot_id FROM (SELECT DISTINCT symbol, snapshot_id FROM {{book_prices}}) b, (SELECT unnest([5, 15, 240]) AS h) t WHERE 19 - snapshot_id <= h // 5 AND snapshot_id < 18 GROUP BY ALL),
  l AS (SELECT symbol, max(snapshot_id) AS live FROM {{book_prices}} GROUP BY ALL), p AS (SELECT l.symbol, t.h AS horizon_min, coalesce(x.snapshot_id, l.live) AS snapshot_id, CASE WHEN x.snapshot_id IS NULL THEN 'live' ELSE 'window' END AS book_source FROM l JOIN (SELECT unnest([5, 15, 240]) AS h) t ON true LEFT JOIN x ON x.symbol = l.symbol AND x.horizon_min = t.h)
  SELECT p.symbol, p.horizon_min, p.snapshot_id, p.book_source, d.wall_imbalance, d.delta FROM p JOIN {pbook.DELTA} d ON p.symbol = d.symbol AND p.snapshot_id = d.snapshot_id""", "wall_imbalance delta")  # fmt: skip
def _(m: Market):
    delta = book.delta_variable(m.book_levels, m.book_prices, m.taker_bars_5m).select(*KS, "wall_imbalance", "delta")
    # A snapshot is five minutes; the two newest count as live only.
    held = F.filter(F.array(F.lit(5), F.lit(15), F.lit(240)), lambda h: (19 - F.col("snapshot_id")) * 5 <= h)
    window = m.book_prices.where("snapshot_id < 18").select(*KS, F.explode(held).alias("horizon_min")).groupBy("symbol", "horizon_min").agg(F.max("snapshot_id").alias("w"))
    live = m.book_prices.groupBy("symbol").agg(F.max("snapshot_id").alias("live")).withColumn("horizon_min", F.explode(F.array(F.lit(5), F.lit(15), F.lit(240))))
    pick = live.join(window, ["symbol", "horizon_min"], "left").select("symbol", "horizon_min", F.coalesce("w", "live").alias("snapshot_id"), F.when(F.col("w").isNull(), "live").otherwise("window").alias("book_source"))
    return pick.join(delta, KS)


#: Sections of a report by name: their group, and a table with a row a symbol.
SECTIONS = {
    "correlation": ("flow", lambda m: tape.cvd_series_corr(tape.bucketed_cvd(m.trades)).select("symbol", "aligned_buckets", "spot_vs_futures_corr")),
    "turnover": ("flow", lambda m: tape.turnover_share(m.trades).select("symbol", "spot_share")),
    "open_interest": ("derivatives", lambda m: m.oi_history_5m.groupBy("symbol").agg(F.count("*").alias("bars"), F.max_by("sum_open_interest", "bucket_ms").alias("last_open_interest"))),
}


def selected_sections(m: Market, names=(), groups=()):
    """``section, symbol, metric, value`` of the sections asked for by name or group, in one table; unknown ones are an error."""
    known_groups = {g for g, _ in SECTIONS.values()}
    if unknown := (set(names) - SECTIONS.keys()) | (set(groups) - known_groups):
        raise ValueError(f"unknown sections or groups: {sorted(unknown)}")
    chosen = [n for n, (g, _) in SECTIONS.items() if n in names or g in groups]
    out = None
    for name in chosen:
        table = SECTIONS[name][1](m)
        metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in table.columns if c != "symbol"]))
        rows = table.select(F.lit(name).alias("section"), "symbol", metrics.alias("m")).select("section", "symbol", "m.metric", "m.value")
        out = rows if out is None else out.unionByName(rows)
    return m.spark.createDataFrame([], "section string, symbol string, metric string, value double") if out is None else out


@query("f3_selected_sections", f"""SELECT 'correlation' AS section, symbol, unnest(['aligned_buckets', 'spot_vs_futures_corr']) AS metric, unnest([aligned_buckets::DOUBLE, spot_vs_futures_corr]) AS value FROM ({ptape.CORR}) c
  UNION ALL SELECT 'turnover', symbol, 'spot_share', spot_share FROM ({ptape.SHARE}) s
  UNION ALL SELECT 'open_interest', symbol, unnest(['bars', 'last_open_interest']), unnest([count(*)::DOUBLE, arg_max(sum_open_interest, bucket_ms)::DOUBLE]) FROM {{oi_history_5m}} GROUP BY symbol""", "value")  # fmt: skip
def _(m: Market):
    return selected_sections(m, names=["open_interest"], groups=["flow"])
