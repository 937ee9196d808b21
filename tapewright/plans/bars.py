"""Registered candle and derivative-bar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import bars, tape
from tapewright.plans.book import NEAR
from tapewright.plans.registry import query
from tapewright.sources.views import NEWEST_SNAPSHOT, Market


def futures(m: Market):
    return m.klines_5m.where("venue = 'futures'").drop("venue")


FUT = "(SELECT * EXCLUDE venue FROM {klines_5m} WHERE venue = 'futures')"


def pct(now: str, before: str) -> str:
    return f"coalesce(({now} - {before}) * 100 / nullif({before}, 0), 0E0)"


CLASS = """CASE WHEN o > 0.05 AND p > 0.05 AND t >= 0.55 THEN 'AGGRESSIVE_LONG' WHEN o > 0.05 AND p > 0.05 AND t <= 0.45 THEN 'DISTRIBUTION' WHEN o > 0.05 AND p > 0.05 THEN 'NEUTRAL_LONG_BUILD'
  WHEN o > 0.05 AND p < -0.05 AND t >= 0.55 THEN 'ABSORPTION' WHEN o > 0.05 AND p < -0.05 AND t <= 0.45 THEN 'SHORT_BUILD' WHEN o > 0.05 AND p < -0.05 THEN 'NEUTRAL_SHORT_BUILD'
  WHEN o < -0.05 AND p > 0.05 THEN 'SHORT_COVER' WHEN o < -0.05 AND p < -0.05 THEN 'LONG_UNWIND' WHEN abs(o) <= 0.05 AND abs(p) <= 0.05 THEN 'TWO_SIDED_FLAT' ELSE 'NEUTRAL_MIXED' END"""
SCORE = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bars.PROACT_SCORE.items()) + " END"
ALIGNED = f"""(WITH j AS (SELECT o.symbol, o.bucket_ms, sum_open_interest AS oi, sum_open_interest_value AS oi_value, open AS px_open, close AS px_close, high AS px_high, low AS px_low, buy_vol, sell_vol
    FROM {{oi_history_5m}} o JOIN {{taker_bars_5m}} t ON o.symbol = t.symbol AND o.bucket_ms = t.bucket_ms JOIN {FUT} k ON o.symbol = k.symbol AND o.bucket_ms = k.bucket_ms),
  d AS (SELECT *, {pct("oi", "lag(oi) OVER w")} AS oi_delta_pct, {pct("px_close", "lag(px_close) OVER w")} AS px_delta_pct, coalesce(buy_vol / nullif(buy_vol + sell_vol, 0), 0.5) AS tbr FROM j WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
  c AS (SELECT symbol, bucket_ms, oi, oi_value, oi_delta_pct, px_open, px_close, px_high, px_low, px_delta_pct, tbr, buy_vol, sell_vol, buy_vol - sell_vol AS net_vol, {CLASS.replace(" o ", " oi_delta_pct ").replace("(o)", "(oi_delta_pct)").replace(" p ", " px_delta_pct ").replace("(p)", "(px_delta_pct)").replace(" t ", " tbr ")} AS class FROM d)
  SELECT *, CAST({SCORE} AS INTEGER) AS proactiveness FROM c)"""


def aligned(m: Market):
    return bars.align_oi_rows(m.oi_history_5m, m.taker_bars_5m, futures(m))


@query("j1_c6_align_oi_rows", f"SELECT * FROM {ALIGNED} a", "oi oi_value oi_delta_pct px_open px_close px_high px_low px_delta_pct tbr buy_vol sell_vol net_vol")
def _(m: Market):
    return aligned(m)


@query("w19_proactiveness", f"""WITH s AS (SELECT symbol, bucket_ms, CAST(sum(proactiveness) OVER w AS BIGINT) AS score, count(*) OVER w AS window_bars FROM {ALIGNED} a WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  SELECT *, CASE WHEN score >= 7 THEN 'PROACTIVE' WHEN score >= 4 THEN 'WARMING' WHEN score >= 1 THEN 'PASSIVE' ELSE 'ABSENT' END AS label, CASE WHEN score >= 7 THEN 'HIGH' WHEN score >= 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM s""")  # fmt: skip
def _(m: Market):
    return bars.proactiveness(aligned(m))


@query("j2_c7_oi_price_divergence", f"""WITH o AS (SELECT symbol, bucket_ms, sum_open_interest AS v, lag(sum_open_interest) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS prev FROM {{oi_history_5m}}),
  s AS (SELECT o.symbol, count(*) AS bars, sum({pct("v", "prev")}) AS oi_change_pct, sum({pct("close", "open")}) AS price_change_pct FROM o LEFT JOIN {FUT} k ON o.symbol = k.symbol AND o.bucket_ms = k.bucket_ms WHERE prev IS NOT NULL GROUP BY ALL)
  SELECT *, CASE WHEN oi_change_pct < -0.3 AND price_change_pct < -0.3 THEN 'LONG_LIQUIDATION_LIKELY' WHEN oi_change_pct < -0.3 AND price_change_pct > 0.3 THEN 'SHORT_LIQUIDATION_LIKELY' WHEN abs(oi_change_pct) < 0.2 AND price_change_pct < -0.3 THEN 'ORGANIC_SELLING'
    WHEN abs(oi_change_pct) < 0.2 AND price_change_pct > 0.3 THEN 'ORGANIC_BUYING' WHEN oi_change_pct > 0.3 AND price_change_pct < -0.3 THEN 'SHORT_ADDING_INTO_WEAKNESS' WHEN oi_change_pct > 0.3 AND price_change_pct > 0.3 THEN 'LONG_ADDING_INTO_STRENGTH' ELSE 'MIXED_RANGE_BOUND' END AS signal FROM s""",
       "oi_change_pct price_change_pct")
def _(m: Market):
    return bars.oi_price_divergence(m.oi_history_5m, futures(m))


@query("a30_vol_direction_split", """WITH s AS (SELECT symbol, venue, coalesce(sum(volume) FILTER (close > open), 0E0) AS up_vol, coalesce(sum(volume) FILTER (close < open), 0E0) AS down_vol FROM {klines_5m} GROUP BY ALL)
  SELECT *, coalesce(up_vol * 100 / nullif(up_vol + down_vol, 0), 0E0) AS up_pct FROM s""", "up_vol down_vol up_pct")  # fmt: skip
def _(m: Market):
    return bars.vol_direction_split(m.klines_5m)


def newest(table: str, n: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket_ms DESC) AS age FROM {table} t) x WHERE age <= {n})"


STAGE_IN = f"""(WITH k AS (SELECT symbol, arg_min(open, bucket_ms) AS fo, arg_max(close, bucket_ms) AS lc, coalesce(sum(volume) FILTER (close > open), 0E0) AS up, coalesce(sum(volume) FILTER (close < open), 0E0) AS down FROM {newest(FUT, 48)} n GROUP BY ALL),
  o AS (SELECT symbol, arg_min(sum_open_interest, bucket_ms) AS f, arg_max(sum_open_interest, bucket_ms) AS l FROM {newest("{oi_history_5m}", 48)} n GROUP BY ALL)
  SELECT k.symbol, {pct("lc", "fo")} AS px_chg_4h, {pct("l", "f")} AS oi_chg_4h, coalesce(up * 100 / nullif(up + down, 0), 0E0) AS up_pct_4h FROM k LEFT JOIN o ON k.symbol = o.symbol)"""


@query("a31_stage_window_inputs", f"SELECT * FROM {STAGE_IN} s", "px_chg_4h oi_chg_4h up_pct_4h")
def _(m: Market):
    return bars.stage_window_inputs(futures(m), m.oi_history_5m)


def _ema_sql(p: int) -> str:
    k = 2 / (p + 1)
    return f"CASE WHEN len(c) >= {p} THEN list_reduce(list_concat([list_avg(c[1:{p}])], c[{p + 1}:]), lambda a, x: x * {k!r}::DOUBLE + a * (1 - {k!r}::DOUBLE)) END AS ema{p}"


EMA = f"""(WITH s AS (SELECT symbol, venue, list(close ORDER BY bucket_ms) AS c, arg_max(high, bucket_ms) AS high, arg_max(low, bucket_ms) AS low, arg_max(close, bucket_ms) AS close FROM {{klines_5m}} GROUP BY ALL)
  SELECT symbol, venue, high, low, close, {", ".join(_ema_sql(p) for p in (9, 21, 50, 200))} FROM s)"""


@query("w10_ema", f"SELECT * FROM {EMA} e", "high low close ema9 ema21 ema50 ema200")
def _(m: Market):
    return bars.ema(m.klines_5m)


_pos = ", ".join(
    f"CASE WHEN ema{p} IS NOT NULL THEN CASE WHEN close > ema{p} THEN 'ABOVE' ELSE 'BELOW' END END AS ema{p}_position, "
    f"CASE WHEN high > ema{p} AND close < ema{p} THEN 'upper_wick_reject' WHEN low < ema{p} AND close > ema{p} THEN 'lower_wick_reject' END AS ema{p}_wick" for p in (9, 21, 50, 200)
)


@query("w11_w12_ema_position", f"SELECT symbol, venue, {_pos} FROM {EMA} e")
def _(m: Market):
    return bars.ema_position(bars.ema(m.klines_5m))


@query("w13_atr_pct", """WITH t AS (SELECT *, lag(close) OVER w AS prev, count(*) OVER (PARTITION BY symbol, venue) AS n, row_number() OVER (PARTITION BY symbol, venue ORDER BY bucket_ms DESC) AS age FROM {klines_5m} WINDOW w AS (PARTITION BY symbol, venue ORDER BY bucket_ms))
  SELECT symbol, venue, CASE WHEN max(n) > 14 THEN sum(greatest(high - low, abs(high - prev), abs(low - prev))) / 14 / arg_max(close, bucket_ms) * 100 END AS atr_pct FROM t WHERE age <= 14 GROUP BY ALL""", "atr_pct")  # fmt: skip
def _(m: Market):
    return bars.atr_pct(m.klines_5m)


def trend_sql(table: str, value: str, n: int = 3) -> str:
    return f"""SELECT symbol, arg_max({value}, bucket_ms) AS last, CASE WHEN count(*) > 1 THEN regr_slope({value}, -age) END AS slope_per_bar,
      CASE WHEN count(*) > 1 THEN arg_max({value}, bucket_ms) - arg_min({value}, bucket_ms) END AS drift, count(*) AS n_used FROM {newest(f"(SELECT * FROM {table} q WHERE {value} IS NOT NULL)", n)} z GROUP BY ALL"""


TREND = "last slope_per_bar drift"
OI_PCT = f"(SELECT symbol, bucket_ms, {pct('sum_open_interest', 'prev')} AS oi_pct FROM (SELECT *, lag(sum_open_interest) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS prev FROM {{oi_history_5m}}) l WHERE prev IS NOT NULL)"
SHARE = "(SELECT *, coalesce(buy_vol / nullif(buy_vol + sell_vol, 0), 0.5) AS share FROM {taker_bars_5m})"
#: Funding and long shares aren't in the tables; they are derived from the open-interest bars.
DERIVED = "(SELECT symbol, bucket_ms, (CAST(sum_open_interest AS BIGINT) % 41 - 20) * 1E-5 AS funding, 0.5E0 + (CAST(sum_open_interest AS BIGINT) % 37) * 1E-2 AS long_pct, sum_open_interest AS oi FROM {oi_history_5m})"


def derived(m: Market):
    oi = F.col("sum_open_interest").cast("long")
    return m.oi_history_5m.select("symbol", "bucket_ms", ((oi % 41 - 20) * 1e-5).alias("funding"), (F.lit(0.5) + (oi % 37) * 1e-2).alias("long_pct"), F.col("sum_open_interest").alias("oi"))


@query("w14_trend_slope_drift", trend_sql(FUT, "close", 20), TREND)
def _(m: Market):
    return bars.trend(futures(m), "close", 20)


@query("w15_taker_buy_trend", trend_sql(SHARE, "share"), TREND)
def _(m: Market):
    return bars.trend(bars.taker_share(m.taker_bars_5m), "share")


@query("w15_oi_change_trend", trend_sql(OI_PCT, "oi_pct"), TREND)
def _(m: Market):
    return bars.trend(bars.oi_changes(m.oi_history_5m), "oi_pct")


@query("w15_long_share_drift", trend_sql(DERIVED, "long_pct"), TREND)
def _(m: Market):
    return bars.trend(derived(m), "long_pct")


@query("w15_funding_trend", f"SELECT symbol, last * 1E4 AS last, slope_per_bar * 1E4 AS slope_per_bar, drift * 1E4 AS drift, n_used FROM ({trend_sql(DERIVED, 'funding')}) f", TREND)
def _(m: Market):
    t = bars.trend(derived(m), "funding")
    return t.select("symbol", *[(F.col(c) * 1e4).alias(c) for c in ("last", "slope_per_bar", "drift")], "n_used")


NET_BUY = "(SELECT symbol, ts_ms - ts_ms % 60000 AS bucket_ms, sum(CASE WHEN is_buyer_maker THEN 0E0 ELSE qty END) / sum(qty) AS buy_share FROM {trades} WHERE venue = 'spot' GROUP BY ALL)"


@query("w15_net_buy_trend", trend_sql(NET_BUY, "buy_share"), TREND)
def _(m: Market):
    return bars.trend(tape.bucketed_buy_share(m.trades.where("venue = 'spot'"), keys=("symbol",)), "buy_share")


@query("w16_funding_zscore", f"""WITH s AS (SELECT symbol, count(*) AS n, arg_max(funding, bucket_ms) AS last, avg(funding) AS mean, stddev_pop(funding) AS std FROM {newest(DERIVED, 30)} d GROUP BY ALL)
  SELECT symbol, n, last, mean, std, CASE WHEN n >= 3 AND std > 1e-12 THEN (last - mean) / std END AS zscore FROM s""", "last mean std zscore")  # fmt: skip
def _(m: Market):
    return bars.zscore(derived(m), "funding")


@query("w17_oi_inflow_outflow", f"""WITH r AS (SELECT * FROM {newest("{oi_history_5m}", 145)} n)
  SELECT t.symbol, t.age - 1 AS bars, w.sum_open_interest - t.sum_open_interest AS change, (w.sum_open_interest - t.sum_open_interest) * 100 / nullif(t.sum_open_interest, 0) AS change_pct
  FROM r t JOIN r w ON t.symbol = w.symbol AND w.age = 1 WHERE t.age - 1 IN (12, 24, 48, 72, 144)""", "change change_pct")  # fmt: skip
def _(m: Market):
    return bars.oi_inflow_outflow(m.oi_history_5m)


@query("w18_oi_implied_value", f"""WITH p AS (SELECT *, sum_open_interest_value / nullif(sum_open_interest, 0) AS per FROM {newest("{oi_history_5m}", 8)} n),
  s AS (SELECT symbol, count(*) AS bars, arg_min(per, bucket_ms) AS first_per_contract, arg_max(per, bucket_ms) AS last_per_contract FROM p GROUP BY ALL)
  SELECT *, CASE WHEN bars > 1 THEN (last_per_contract - first_per_contract) * 100 / nullif(first_per_contract, 0) END AS change_pct FROM s""", "first_per_contract last_per_contract change_pct")  # fmt: skip
def _(m: Market):
    return bars.oi_implied_value(m.oi_history_5m)


@query("a40_oi_weighted_contracts", f"""WITH l AS (SELECT symbol, oi, long_pct FROM {newest(DERIVED, 1)} d)
  SELECT symbol, oi, oi * long_pct AS top_long_contracts, oi * (1 - long_pct) AS top_short_contracts, oi * (long_pct - 0.05E0) AS global_long_contracts, oi * (1 - (long_pct - 0.05E0)) AS global_short_contracts FROM l""",
       "oi top_long_contracts top_short_contracts global_long_contracts global_short_contracts")
def _(m: Market):
    latest = bars.newest_bars(derived(m), 1).select("symbol", "oi", F.col("long_pct").alias("top_long_pct"), (F.col("long_pct") - 0.05).alias("global_long_pct"))
    return bars.oi_weighted_contracts(latest)


RETURNS = f"(SELECT symbol, bucket_ms, (close - open) / open AS r FROM {FUT} k WHERE open <> 0)"


@query("a41_a42_macro_returns", f"""WITH r AS (SELECT * FROM {RETURNS} x), w AS (SELECT symbol, (exp(sum(ln(1 + r))) - 1) * 100 AS return_pct FROM r GROUP BY ALL),
  p AS (SELECT a.symbol, count(*) AS bars, corr(a.r, b.r) AS corr, covar_pop(a.r, b.r) / var_pop(b.r) AS beta FROM r a JOIN r b ON a.bucket_ms = b.bucket_ms AND b.symbol = 'S0' GROUP BY ALL),
  f AS (SELECT w.symbol, bars, w.return_pct, corr, beta, beta * b.return_pct AS expected_pct, w.return_pct - beta * b.return_pct AS residual_pct FROM w LEFT JOIN p ON w.symbol = p.symbol JOIN w b ON b.symbol = 'S0')
  SELECT *, CASE WHEN residual_pct > 1 THEN 'OUTPERFORMING' WHEN residual_pct < -1 THEN 'UNDERPERFORMING' WHEN residual_pct IS NOT NULL THEN 'TRACKING' END AS label FROM f""", "return_pct corr beta expected_pct residual_pct")  # fmt: skip
def _(m: Market):
    return bars.macro_returns(futures(m), "S0")


@query("a43_relative_strength", f"""WITH s AS (SELECT symbol, arg_min(open, bucket_ms) AS o, arg_max(close, bucket_ms) AS last_price, sum(volume) AS volume FROM {FUT} k GROUP BY ALL)
  SELECT symbol, {pct("last_price", "o")} AS change_pct, last_price, volume, row_number() OVER (ORDER BY {pct("last_price", "o")} DESC, symbol) AS rank FROM s""", "change_pct last_price volume")  # fmt: skip
def _(m: Market):
    return bars.relative_strength(futures(m))


@query("c8_wall_break", f"""WITH mi AS (SELECT symbol, ts_ms - ts_ms % 60000 AS m, sum(CASE WHEN is_buyer_maker THEN 0E0 ELSE qty END) AS buy FROM {{trades}} WHERE venue = 'futures' GROUP BY ALL),
  r AS (SELECT symbol, arg_max(buy, m) AS current_rate, max(buy) AS peak_rate FROM mi GROUP BY ALL),
  w AS (SELECT symbol, sum(qty) AS total_wall FROM {NEAR} n WHERE side = 'ask' AND {NEWEST_SNAPSHOT} AND price_ticks - pt BETWEEN 5 AND 100 GROUP BY ALL)
  SELECT r.symbol, total_wall, current_rate, peak_rate, total_wall / 15 AS required_rate, current_rate / greatest(total_wall / 15, 1e-9) AS current_adequacy, peak_rate / greatest(total_wall / 15, 1e-9) AS peak_adequacy, total_wall / greatest(peak_rate, 1e-9) AS minutes_at_peak,
    CASE WHEN current_rate >= total_wall / 15 THEN 'BUYERS_CAN_BREAK' WHEN peak_rate >= total_wall / 15 THEN 'FIREPOWER_AVAILABLE' ELSE 'CANNOT_BREAK_VIA_BUY_FLOW' END AS verdict FROM r JOIN w ON r.symbol = w.symbol""",
       "total_wall current_rate peak_rate required_rate current_adequacy peak_adequacy minutes_at_peak")
def _(m: Market):
    from tapewright.operators import book

    near = book.with_price(m.newest(m.book_levels.where("side = 'ask'")), m.book_prices)
    total = near.where((F.col("price_ticks") - book.price_ticks()).between(5, 100)).groupBy("symbol").agg(F.sum("qty").alias("total_wall"))
    rates = tape.buy_rates(m.trades.where("venue = 'futures'"), keys=("symbol",))
    return bars.wall_break(total.join(rates, "symbol"))


@query("w24_trade_clusters", """WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts_ms, trade_id, price, qty) AS rn FROM {trades}),
  e AS (SELECT *, max(rn) OVER (PARTITION BY symbol, venue ORDER BY ts_ms RANGE BETWEEN CURRENT ROW AND 15000 FOLLOWING) + 1 AS late, min(CASE WHEN qty < 30 THEN rn END) OVER (PARTITION BY symbol, venue ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS small FROM t),
  j AS (SELECT symbol, venue, rn, ts_ms, least(late, coalesce(small, late)) AS nxt FROM e),
  f AS (SELECT * FROM j WHERE rn = 1 UNION ALL SELECT j.* FROM f JOIN j ON f.symbol = j.symbol AND f.venue = j.venue AND f.nxt = j.rn),
  g AS (SELECT f.symbol, f.venue, f.ts_ms, count(*) AS trade_count, sum(qty) AS total_qty, sum(CASE WHEN is_buyer_maker THEN 0E0 ELSE qty END) AS buy_qty, sum(price * qty) / sum(qty) AS average_price
    FROM f JOIN t ON f.symbol = t.symbol AND f.venue = t.venue AND t.rn >= f.rn AND t.rn < f.nxt WHERE f.nxt - f.rn >= 3 GROUP BY f.symbol, f.venue, f.rn, f.ts_ms)
  SELECT *, total_qty - buy_qty AS sell_qty, row_number() OVER (PARTITION BY symbol, venue ORDER BY total_qty DESC, ts_ms) AS rank FROM g QUALIFY rank <= 10""", "total_qty buy_qty sell_qty average_price")
def _(m: Market):
    return bars.trade_clusters(m.trades, gap_ms=15_000)


@query("a46_liquidation_inputs", f"SELECT symbol, count(*) AS bars, avg(buy_vol / greatest(buy_vol + sell_vol, 0.001)) AS average_ratio, arg_max(buy_vol / greatest(buy_vol + sell_vol, 0.001), bucket_ms) AS last_ratio FROM {newest('{taker_bars_5m}', 12)} n GROUP BY ALL",
       "average_ratio last_ratio")
def _(m: Market):
    return bars.liquidation_inputs(m.taker_bars_5m)
