"""Registered order-book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import book, tape
from tapewright.plans.registry import query
from tapewright.sources.views import NEWEST_SNAPSHOT, Market

BID, ASK = "CASE WHEN side = 'bid' THEN {} ELSE 0E0 END", "CASE WHEN side = 'ask' THEN {} ELSE 0E0 END"
BQ, AQ, BN, AN = BID.format("qty"), ASK.format("qty"), BID.format("price * qty"), ASK.format("price * qty")
#: Levels with the reference price in ticks.
NEAR = "(SELECT l.*, round(p.price * 100, 4) AS pt, p.price AS ref_price FROM {book_levels} l JOIN {book_prices} p ON l.symbol = p.symbol AND l.snapshot_id = p.snapshot_id)"
RANKED = """(SELECT *, row_number() OVER (PARTITION BY symbol, snapshot_id, side ORDER BY CASE WHEN side = 'bid' THEN -price_ticks ELSE price_ticks END) AS level_rank FROM {book_levels})"""
DENSE = """(SELECT symbol, snapshot_id, side, price_ticks, price, qty, CASE WHEN side = 'bid' THEN sum(qty) OVER down ELSE sum(qty) OVER up END AS window_qty,
  CASE WHEN side = 'bid' THEN sum(price * qty) OVER down ELSE sum(price * qty) OVER up END AS notional FROM {book_levels}
  WINDOW down AS (PARTITION BY symbol, snapshot_id, side ORDER BY price_ticks RANGE BETWEEN 20 PRECEDING AND CURRENT ROW),
         up AS (PARTITION BY symbol, snapshot_id, side ORDER BY price_ticks RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING))"""
KEYSTONE = f"""(WITH d AS (SELECT d.*, round(p.price * 100, 4) AS pt FROM {DENSE} d JOIN {{book_prices}} p ON d.symbol = p.symbol AND d.snapshot_id = p.snapshot_id WHERE side = 'bid'),
  b AS (SELECT symbol, snapshot_id, price_ticks AS bt, window_qty FROM (SELECT *, row_number() OVER (PARTITION BY symbol, snapshot_id ORDER BY window_qty DESC, price_ticks DESC) AS rn
    FROM d WHERE price_ticks - pt BETWEEN -30 AND -5) x WHERE rn = 1)
  SELECT p.symbol, p.snapshot_id, p.price, coalesce(bt * 0.01, p.price - 0.30) AS keystone, coalesce(window_qty, 0E0) AS window_qty
  FROM {{book_prices}} p LEFT JOIN b ON p.symbol = b.symbol AND p.snapshot_id = b.snapshot_id)"""


@query("c23_book_mid", """SELECT symbol, snapshot_id, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask,
  coalesce((max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2, max(price) FILTER (side = 'bid'), min(price) FILTER (side = 'ask')) AS price
  FROM {book_levels} GROUP BY ALL""", "best_bid best_ask price")  # fmt: skip
def _(m: Market):
    return book.mid_prices(m.book_levels)


@query("p2_top_levels", f"SELECT symbol, snapshot_id, side, level_rank, price_ticks, qty FROM {RANKED} r WHERE level_rank <= 20", "qty")
def _(m: Market):
    return book.top_levels(m.book_levels).select("symbol", "snapshot_id", "side", "level_rank", "price_ticks", "qty")


@query("p3_valid_levels", "SELECT symbol, snapshot_id, side, price, qty FROM {book_levels} WHERE price_ticks % 7 <> 0 AND price_ticks % 11 <> 0", "price qty")
def _(m: Market):
    bad = m.book_levels.withColumn("price", F.when(F.col("price_ticks") % 7 == 0, "oops").otherwise(F.col("price").cast("string")))
    bad = bad.withColumn("qty", F.when(F.col("price_ticks") % 11 == 0, -F.col("qty")).otherwise(F.col("qty")))
    return book.valid_levels(bad).select("symbol", "snapshot_id", "side", "price", "qty")


@query("p4_significant_levels", "SELECT symbol, snapshot_id, side, price, qty, price * qty AS notional FROM {book_levels} WHERE qty >= 100", "price qty notional")
def _(m: Market):
    return book.significant_levels(m.book_levels, 100).select("symbol", "snapshot_id", "side", "price", "qty", "notional")


@query("t5_first_significant_floors", """WITH f AS (SELECT symbol, snapshot_id, row_number() OVER (PARTITION BY symbol, snapshot_id ORDER BY price_ticks) AS rank, price AS floor
  FROM {book_levels} WHERE side = 'bid' AND qty >= 100)
  SELECT p.symbol, p.snapshot_id, coalesce(rank, 1) AS rank, coalesce(floor, p.price) AS floor
  FROM {book_prices} p LEFT JOIN (SELECT * FROM f WHERE rank <= 5) f ON p.symbol = f.symbol AND p.snapshot_id = f.snapshot_id""", "floor")  # fmt: skip
def _(m: Market):
    return book.first_significant_floors(m.book_levels, m.book_prices, 100)


SUMMARY = f"""(WITH s AS (SELECT symbol, snapshot_id, max(price) FILTER (side = 'bid' AND level_rank = 1) AS best_bid, max(price) FILTER (side = 'ask' AND level_rank = 1) AS best_ask,
    max(qty) FILTER (side = 'bid' AND level_rank = 1) AS bq, max(qty) FILTER (side = 'ask' AND level_rank = 1) AS aq, sum({BN}) AS book_bid_notional, sum({AN}) AS book_ask_notional,
    least(count(*) FILTER (side = 'bid'), count(*) FILTER (side = 'ask')) AS book_levels FROM {RANKED} r WHERE level_rank <= 20 GROUP BY ALL)
  SELECT symbol, snapshot_id, best_bid, best_ask, best_ask - best_bid AS spread, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 AS spread_bps,
    (book_bid_notional - book_ask_notional) / nullif(book_bid_notional + book_ask_notional, 0) AS obi, (best_ask * bq + best_bid * aq) / (bq + aq) AS microprice,
    ((best_ask * bq + best_bid * aq) / (bq + aq) / ((best_bid + best_ask) / 2) - 1) * 10000 AS micro_price_skew_bps, book_levels, book_bid_notional, book_ask_notional FROM s)"""


@query("c2_microprice", f"SELECT * FROM {SUMMARY} s", "best_bid best_ask spread spread_bps obi microprice micro_price_skew_bps book_bid_notional book_ask_notional")
def _(m: Market):
    return book.book_summary(m.book_levels)


@query("w1_rolling_density", f"SELECT * FROM {DENSE} d", "price qty window_qty notional")
def _(m: Market):
    return book.rolling_density(m.book_levels)


@query("t1_top_density_windows", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, snapshot_id, side ORDER BY window_qty DESC, price_ticks) AS rank FROM {DENSE} d) x WHERE rank <= 10",
       "price qty window_qty notional")
def _(m: Market):
    return book.top_density_windows(m.book_levels)


@query("w2_find_keystone", f"SELECT *, keystone - 0.05 AS tight_lo, keystone + 0.05 AS tight_hi, keystone - 0.10 AS wide_lo, keystone + 0.10 AS wide_hi FROM {KEYSTONE} k",
       "price keystone window_qty tight_lo tight_hi wide_lo wide_hi")
def _(m: Market):
    return book.find_keystone(m.book_levels, m.book_prices)


@query("w3_find_walls", f"""WITH c AS (SELECT *, sum(qty) OVER (PARTITION BY symbol, snapshot_id ORDER BY price_ticks RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS q FROM {NEAR} n WHERE side = 'ask')
  SELECT * FROM (SELECT symbol, snapshot_id, row_number() OVER (PARTITION BY symbol, snapshot_id ORDER BY q DESC, price_ticks) AS rank, price, q AS qty FROM c WHERE price_ticks - pt BETWEEN 5 AND 100) x WHERE rank <= 5""",
       "price qty")
def _(m: Market):
    return book.find_walls(m.book_levels, m.book_prices)


@query("a7_zone_depth", f"""WITH s AS (SELECT symbol, snapshot_id, sum({BQ}) AS b, sum({AQ}) AS a, sum({BN}) AS bn, sum({AN}) AS an FROM {NEAR} n WHERE price_ticks - pt BETWEEN -50 AND 50 GROUP BY ALL)
  SELECT p.symbol, p.snapshot_id, coalesce(b, 0E0) AS bid_qty, coalesce(a, 0E0) AS ask_qty, coalesce(bn, 0E0) AS bid_notional, coalesce(an, 0E0) AS ask_notional,
    coalesce(b, 0E0) - coalesce(a, 0E0) AS net_qty, coalesce(bn, 0E0) - coalesce(an, 0E0) AS net_notional FROM {{book_prices}} p LEFT JOIN s ON p.symbol = s.symbol AND p.snapshot_id = s.snapshot_id""",
       "bid_qty ask_qty bid_notional ask_notional net_qty net_notional")
def _(m: Market):
    return book.zone_depth(m.book_levels, m.book_prices)


@query("a8_zone_ratio_grid", f"""WITH z AS (SELECT symbol, snapshot_id, CAST(round_even((round(price * 100, 4) - 50) / 5, 0) AS BIGINT) + unnest(range(21)) AS zone FROM {{book_prices}}),
  s AS (SELECT symbol, snapshot_id, price_ticks // 5 AS zone, sum({BQ}) AS b, sum({AQ}) AS a FROM {{book_levels}} GROUP BY ALL)
  SELECT z.symbol, z.snapshot_id, z.zone, z.zone * 0.05 AS lo, coalesce(b, 0E0) AS bid_qty, coalesce(a, 0E0) AS ask_qty, coalesce(b, 0E0) - coalesce(a, 0E0) AS net,
    coalesce(b, 0E0) / nullif(coalesce(a, 0E0), 0) AS ratio, CASE WHEN coalesce(b, 0) > coalesce(a, 0) * 3 THEN 'BID' WHEN coalesce(a, 0) > coalesce(b, 0) * 3 THEN 'ASK' ELSE '' END AS flag
  FROM z LEFT JOIN s ON z.symbol = s.symbol AND z.snapshot_id = s.snapshot_id AND z.zone = s.zone""", "lo bid_qty ask_qty net ratio")  # fmt: skip
def _(m: Market):
    return book.zone_ratio_grid(m.book_levels, m.book_prices)


IMBALANCE = f"""(WITH z AS (SELECT symbol, snapshot_id, unnest(range(CAST(floor((round(price * 100, 4) - 75) / 10) AS BIGINT), CAST(floor((round(price * 100, 4) + 75) / 10) AS BIGINT) + 1)) AS band FROM {{book_prices}}),
  s AS (SELECT symbol, snapshot_id, price_ticks // 10 AS band, sum({BQ}) AS b, sum({AQ}) AS a FROM {{book_levels}} GROUP BY ALL)
  SELECT z.symbol, z.snapshot_id, z.band, coalesce(b, 0E0) AS bid_qty, coalesce(a, 0E0) AS ask_qty, coalesce((b - a) / nullif(b + a, 0), 0E0) AS imbalance
  FROM z LEFT JOIN s ON z.symbol = s.symbol AND z.snapshot_id = s.snapshot_id AND z.band = s.band)"""


@query("a21_range_imbalance", f"SELECT * FROM {IMBALANCE} i", "bid_qty ask_qty imbalance")
def _(m: Market):
    return book.range_imbalance(m.book_levels, m.book_prices)


ALIGNMENT = """(WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket_ms DESC) AS n FROM {taker_bars_5m})
  SELECT symbol, coalesce((sum(buy_vol) FILTER (n = 1) - sum(sell_vol) FILTER (n = 1)) / nullif(sum(buy_vol) FILTER (n = 1) + sum(sell_vol) FILTER (n = 1), 0), 0E0) AS flow_alignment,
    sum(buy_vol) FILTER (n = 1) * 100 / nullif(sum(buy_vol) FILTER (n = 1) + sum(sell_vol) FILTER (n = 1), 0) AS tbr_last_pct,
    sum(buy_vol) * 100 / nullif(sum(buy_vol) + sum(sell_vol), 0) AS tbr_3avg_pct FROM r WHERE n <= 3 GROUP BY ALL)"""


@query("w21_tbr_last_avg", f"SELECT * FROM {ALIGNMENT} a", "flow_alignment tbr_last_pct tbr_3avg_pct")
def _(m: Market):
    return book.flow_alignment(m.taker_bars_5m)


STATE = "CASE WHEN {0} > 1 THEN 'BUYERS_IN_CONTROL' WHEN {0} > 0.25 THEN 'BUYERS_FAVORED' WHEN {0} > 0 THEN 'BUYERS_SLIGHTLY_FAVORED' WHEN {0} > -0.25 THEN 'SELLERS_SLIGHTLY_FAVORED' WHEN {0} > -1 THEN 'SELLERS_FAVORED' ELSE 'SELLERS_IN_CONTROL' END"
DELTA = f"""(WITH s AS (SELECT symbol, snapshot_id, sum(bid_qty) AS b, sum(ask_qty) AS a, sum(imbalance) AS i, count(*) AS n_bands FROM {IMBALANCE} x GROUP BY ALL),
  w AS (SELECT s.*, coalesce((b - a) / nullif(b + a, 0), 0E0) AS wall_imbalance, coalesce(f.flow_alignment, 0E0) AS flow_alignment, tbr_last_pct, tbr_3avg_pct FROM s LEFT JOIN {ALIGNMENT} f ON s.symbol = f.symbol)
  SELECT symbol, snapshot_id, n_bands, wall_imbalance, flow_alignment, wall_imbalance + flow_alignment AS delta, i + flow_alignment AS delta_raw, tbr_last_pct, tbr_3avg_pct,
    {STATE.format("(wall_imbalance + flow_alignment)")} AS state FROM w)"""


@query("c4_c5_delta_variable", f"SELECT * FROM {DELTA} d", "wall_imbalance flow_alignment delta delta_raw tbr_last_pct tbr_3avg_pct")
def _(m: Market):
    return book.delta_variable(m.book_levels, m.book_prices, m.taker_bars_5m)


_slices = ", ".join(f"(sum({BQ}) FILTER ({c}) - sum({AQ}) FILTER ({c})) / nullif(sum(qty) FILTER ({c}), 0) AS obi_{n}" for n, c in ((5, "level_rank <= 5"), (10, "level_rank <= 10"), (20, "level_rank <= 20"), ("total", "true")))


@query("a23_depth_imbalance_slices", f"SELECT symbol, snapshot_id, {_slices} FROM {RANKED} r GROUP BY ALL", "obi_5 obi_10 obi_20 obi_total")
def _(m: Market):
    return book.depth_imbalance_slices(m.book_levels)


def _tier_sql(size: str, mega: float, large: float, medium: float) -> str:
    tiers = {"mega": f"{size} >= {mega}", "large": f"{size} >= {large} AND {size} < {mega}", "medium": f"{size} >= {medium} AND {size} < {large}", "small": f"{size} < {medium}"}
    cols = ", ".join(
        f"count(*) FILTER ({c}) AS {t}_count, coalesce(sum(qty) FILTER ({c}), 0E0) AS {t}_qty, coalesce(sum(price * qty) FILTER ({c}), 0E0) AS {t}_notional" for t, c in tiers.items()
    )
    pct = ", ".join(f"{t}_qty / total_qty * 100 AS {t}_pct" for t in tiers)
    return f"SELECT *, {pct} FROM (SELECT symbol, snapshot_id, sum(qty) AS total_qty, sum(price * qty) AS total_notional, {cols} FROM {{book_levels}} WHERE side = 'bid' GROUP BY ALL) t"


_TIER_DOUBLES = "total_qty total_notional " + " ".join(f"{t}_{c}" for t in book.TIER_NAMES for c in ("qty", "notional", "pct"))
SMALL_TIERS = book.Tiers(20_000.0, 8_000.0, 3_000.0)


@query("a13_bid_tiers_usd", _tier_sql("price * qty", 20_000, 8_000, 3_000), _TIER_DOUBLES)
def _(m: Market):
    return book.bid_tiers(m.book_levels, SMALL_TIERS)


@query("a14_bid_tiers_qty", _tier_sql("qty", 200, 80, 30), _TIER_DOUBLES)
def _(m: Market):
    return book.bid_tiers(m.book_levels, book.Tiers(200.0, 80.0, 30.0), by_notional=False)


@query("a15_tier_balance", f"""WITH s AS (SELECT symbol, snapshot_id, sum({BQ}) FILTER (price * qty >= 10000) AS b, sum({AQ}) FILTER (price * qty >= 10000) AS a, sum({BQ}) AS total_bids, sum({AQ}) AS total_asks FROM {{book_levels}} GROUP BY ALL),
  c AS (SELECT symbol, snapshot_id, coalesce(b, 0E0) AS mega_bids, coalesce(a, 0E0) AS mega_asks, total_bids, total_asks FROM s)
  SELECT symbol, snapshot_id, mega_bids, mega_asks, mega_bids - mega_asks AS delta, mega_bids / nullif(mega_asks, 0) AS ratio,
    CASE WHEN mega_asks = 0 AND mega_bids > 0 THEN 'INSTITUTIONAL-BID-HEAVY' WHEN mega_bids = 0 AND mega_asks > 0 THEN 'INSTITUTIONAL-ASK-HEAVY' WHEN mega_asks = 0 THEN 'BALANCED'
      WHEN mega_bids > mega_asks * 1.2 THEN 'INSTITUTIONAL-BID-HEAVY' WHEN mega_bids * 1.2 < mega_asks THEN 'INSTITUTIONAL-ASK-HEAVY' ELSE 'BALANCED' END AS verdict, total_bids, total_asks FROM c""",
       "mega_bids mega_asks delta ratio total_bids total_asks")
def _(m: Market):
    return book.tier_balance(m.book_levels, 10_000)


def keystones(m: Market):
    return book.find_keystone(m.book_levels, m.book_prices)


KNEAR = f"(SELECT l.*, k.keystone, round(k.keystone * 100, 4) AS kt, round(k.price * 100, 4) AS pt FROM {{book_levels}} l JOIN {KEYSTONE} k ON l.symbol = k.symbol AND l.snapshot_id = k.snapshot_id)"


@query("a16_mega_at_keystone", f"""WITH n AS (SELECT symbol, snapshot_id, count(*) AS c, sum(qty) AS q, sum(price * qty) AS s FROM {KNEAR} x WHERE side = 'bid' AND price * qty >= 5000 AND abs(price_ticks - kt) <= 10 GROUP BY ALL)
  SELECT k.symbol, k.snapshot_id, keystone, coalesce(c, 0) AS count, coalesce(q, 0E0) AS qty, coalesce(s, 0E0) AS notional FROM {KEYSTONE} k LEFT JOIN n ON k.symbol = n.symbol AND k.snapshot_id = n.snapshot_id""",
       "keystone qty notional")
def _(m: Market):
    return book.mega_at_keystone(m.book_levels, keystones(m), 5_000)


@query("w4_absorption_ladder", f"""SELECT * FROM (SELECT symbol, snapshot_id, row_number() OVER w AS rank, price, qty, sum(qty) OVER (PARTITION BY symbol, snapshot_id ORDER BY price_ticks ROWS UNBOUNDED PRECEDING) AS cum_qty
  FROM {NEAR} n WHERE side = 'bid' AND price_ticks < pt WINDOW w AS (PARTITION BY symbol, snapshot_id ORDER BY price_ticks)) x WHERE rank <= 15""", "price qty cum_qty")  # fmt: skip
def _(m: Market):
    return book.absorption_ladder(m.book_levels, m.book_prices)


@query("w5_ask_wall_ladder", f"""WITH z AS (SELECT symbol, snapshot_id, price, unnest(range(61)) AS zone FROM {{book_prices}}),
  s AS (SELECT symbol, snapshot_id, CAST(floor((price_ticks - pt) / 5) AS BIGINT) AS zone, count(*) AS c, sum(qty) AS q, sum(price * qty) AS n FROM {NEAR} x WHERE side = 'ask' AND price_ticks >= pt GROUP BY ALL)
  SELECT z.symbol, z.snapshot_id, z.zone, z.price + z.zone * 0.05 AS lo, coalesce(c, 0) AS n_levels, coalesce(q, 0E0) AS qty, coalesce(n, 0E0) AS notional,
    sum(coalesce(n, 0E0)) OVER (PARTITION BY z.symbol, z.snapshot_id ORDER BY z.zone ROWS UNBOUNDED PRECEDING) AS cum_notional
  FROM z LEFT JOIN s ON z.symbol = s.symbol AND z.snapshot_id = s.snapshot_id AND z.zone = s.zone""", "lo qty notional cum_notional")  # fmt: skip
def _(m: Market):
    return book.ask_wall_ladder(m.book_levels, m.book_prices)


@query("w6_keystone_bid_stack", f"""WITH r AS (SELECT *, price_ticks - kt AS off FROM {KNEAR} x WHERE side = 'bid' AND price_ticks - kt BETWEEN -30 AND 15)
  SELECT symbol, snapshot_id, price, qty, CASE WHEN off < 0 THEN 'below' WHEN off > 0 THEN 'above' ELSE 'at' END AS zone, abs(off) <= 5 AS is_tight,
    CASE WHEN abs(off) <= 5 THEN sum(CASE WHEN abs(off) <= 5 THEN qty END) OVER w END AS cum_qty, CASE WHEN abs(off) <= 5 THEN sum(CASE WHEN abs(off) <= 5 THEN price * qty END) OVER w END AS cum_notional
  FROM r WINDOW w AS (PARTITION BY symbol, snapshot_id ORDER BY price_ticks ROWS UNBOUNDED PRECEDING)""", "price qty cum_qty cum_notional")  # fmt: skip
def _(m: Market):
    return book.keystone_bid_stack(m.book_levels, keystones(m))


ANCHORS = "(SELECT symbol, snapshot_id, CAST(round_even(price / 0.05, 0) AS BIGINT) - 4 + unnest(range(9)) AS k FROM {book_prices})"


@query("c3_round_anchors", f"SELECT symbol, snapshot_id, k, k * 0.05 AS level, k * 0.05 - 0.02 AS lo, k * 0.05 + 0.02 AS hi FROM {ANCHORS} a", "level lo hi")
def _(m: Market):
    return book.round_anchors(m.book_prices)


def _anchor_depth(tol: int) -> str:
    return f"""(SELECT a.symbol, a.snapshot_id, k, k * 0.05 AS level, coalesce(sum(qty), 0E0) AS qty, coalesce(sum(price * qty), 0E0) AS notional FROM {ANCHORS} a
      LEFT JOIN {{book_levels}} l ON a.symbol = l.symbol AND a.snapshot_id = l.snapshot_id AND side = 'bid' AND price_ticks BETWEEN k * 5 - {tol} AND k * 5 + {tol} GROUP BY ALL)"""


@query("j4_round_anchor_depth", f"SELECT * FROM {_anchor_depth(2)} d", "level qty notional")
def _(m: Market):
    return book.round_anchor_depth(m.book_levels, book.round_anchors(m.book_prices))


@query("a25_level_absorption", f"SELECT symbol, snapshot_id, k, level, qty, qty = 0 AS no_bid, 100000 / nullif(qty, 0) AS absorbed_pct_1000, 500000 / nullif(qty, 0) AS absorbed_pct_5000, 1000000 / nullif(qty, 0) AS absorbed_pct_10000 FROM {_anchor_depth(1)} d",
       "level qty absorbed_pct_1000 absorbed_pct_5000 absorbed_pct_10000")
def _(m: Market):
    return book.level_absorption(m.book_levels, book.round_anchors(m.book_prices))


@query("a22_band_qty", f"SELECT symbol, snapshot_id, coalesce(sum(qty) FILTER (side = 'bid' AND price_ticks BETWEEN pt - 25 AND pt), 0E0) AS bid_qty, coalesce(sum(qty) FILTER (side = 'ask' AND price_ticks BETWEEN pt AND pt + 25), 0E0) AS ask_qty FROM {NEAR} n GROUP BY ALL",
       "bid_qty ask_qty")
def _(m: Market):
    p = book.price_ticks()
    near = book.with_price(m.book_levels, m.book_prices).groupBy("symbol", "snapshot_id")
    return near.agg(book.band_qty(m.book_levels, "bid", p - 25, p).alias("bid_qty"), book.band_qty(m.book_levels, "ask", p, p + 25).alias("ask_qty"))


FUEL = f"""(SELECT *, bid_pool / nullif(ask_pool, 0) AS ratio, CASE WHEN ask_pool = 0 OR bid_pool > ask_pool THEN 'BUYERS_HAVE_FUEL' ELSE 'SELLERS_DOMINATE' END AS verdict FROM (
  SELECT symbol, snapshot_id, coalesce(sum(qty) FILTER (side = 'bid' AND price_ticks BETWEEN pt - 50 AND pt), 0E0) AS bid_pool, coalesce(sum(qty) FILTER (side = 'ask' AND price_ticks BETWEEN pt AND pt + 50), 0E0) AS ask_pool FROM {NEAR} n GROUP BY ALL) f)"""


@query("a26_wall_fuel_ratio", f"SELECT * FROM {FUEL} f", "bid_pool ask_pool ratio")
def _(m: Market):
    return book.wall_fuel_ratio(m.book_levels, m.book_prices)


@query("a27_path_fuel_ratio", f"""WITH s AS (SELECT symbol, snapshot_id, coalesce(sum(qty) FILTER (side = 'ask' AND price_ticks <= pt + 50), 0E0) AS required_buy_vol, coalesce(sum(price * qty) FILTER (side = 'ask' AND price_ticks <= pt + 50), 0E0) AS required_buy_notional,
    coalesce(sum(qty) FILTER (side = 'bid' AND price_ticks >= pt - 50), 0E0) AS available_fuel, coalesce(sum(price * qty) FILTER (side = 'bid' AND price_ticks >= pt - 50), 0E0) AS available_notional FROM {NEAR} n GROUP BY ALL),
  r AS (SELECT *, coalesce(available_fuel / nullif(required_buy_vol, 0), 999E0) AS fuel_ratio FROM s)
  SELECT *, CASE WHEN fuel_ratio > 1.5 THEN 'BUYERS HAVE AMPLE FUEL' WHEN fuel_ratio >= 1 THEN 'BUYERS CAN REACH' WHEN fuel_ratio >= 0.5 THEN 'BUYERS STRUGGLE' ELSE 'BUYERS EXHAUSTED BEFORE TARGET' END AS verdict,
    CASE WHEN fuel_ratio > 1.5 THEN 'HIGH' WHEN fuel_ratio >= 1 THEN 'MEDIUM' WHEN fuel_ratio >= 0.5 THEN 'MEDIUM-LOW' ELSE 'HIGH' END AS confidence FROM r""",
       "required_buy_vol required_buy_notional available_fuel available_notional fuel_ratio")
def _(m: Market):
    return book.path_fuel_ratio(m.book_levels, m.book_prices)


ASCENT = f"""(WITH f AS (SELECT symbol, snapshot_id, bid_pool AS bid_fuel FROM {FUEL} x), z AS (SELECT symbol, snapshot_id, price, 1 + unnest(range(10)) AS n FROM {{book_prices}}),
  a AS (SELECT z.symbol, z.snapshot_id, z.n, any_value(z.price) + z.n * 0.10 AS level, coalesce(sum(l.qty), 0E0) AS asks_to_absorb FROM z
    LEFT JOIN {NEAR} l ON z.symbol = l.symbol AND z.snapshot_id = l.snapshot_id AND l.side = 'ask' AND l.price_ticks <= l.pt + z.n * 10 GROUP BY z.symbol, z.snapshot_id, z.n)
  SELECT a.*, bid_fuel - asks_to_absorb AS bid_fuel_remaining, CASE WHEN bid_fuel - asks_to_absorb > 0 THEN 'BUYERS_REACH' ELSE 'BUYERS_EXHAUSTED' END AS verdict
  FROM a JOIN f ON a.symbol = f.symbol AND a.snapshot_id = f.snapshot_id)"""


@query("w7_path_ascent", f"SELECT * FROM {ASCENT} a", "level asks_to_absorb bid_fuel_remaining")
def _(m: Market):
    return book.path_ascent(m.book_levels, m.book_prices)


@query("w7_fall_short_level", f"SELECT symbol, snapshot_id, arg_min(level, n) FILTER (bid_fuel_remaining < 0) AS fall_short_level FROM {ASCENT} a GROUP BY ALL", "fall_short_level")
def _(m: Market):
    return book.fall_short_level(book.path_ascent(m.book_levels, m.book_prices))


@query("w7_path_descent", f"""WITH f AS (SELECT symbol, snapshot_id, bid_pool AS bid_fuel, ask_pool AS ask_fuel FROM {FUEL} x), z AS (SELECT symbol, snapshot_id, price, 1 + unnest(range(10)) AS n FROM {{book_prices}}),
  a AS (SELECT z.symbol, z.snapshot_id, z.n, any_value(z.price) - z.n * 0.10 AS level, coalesce(sum(l.qty), 0E0) AS bids_to_absorb FROM z
    LEFT JOIN {NEAR} l ON z.symbol = l.symbol AND z.snapshot_id = l.snapshot_id AND l.side = 'bid' AND l.price_ticks >= l.pt - z.n * 10 GROUP BY z.symbol, z.snapshot_id, z.n)
  SELECT a.*, ask_fuel - bids_to_absorb AS ask_fuel_remaining, CASE WHEN ask_fuel - bids_to_absorb > 0 AND bids_to_absorb < bid_fuel * 0.6 THEN 'SHORT VALID' WHEN ask_fuel - bids_to_absorb > 0 THEN 'SHORT OK (tight)' ELSE 'SQUEEZE RISK' END AS verdict
  FROM a JOIN f ON a.symbol = f.symbol AND a.snapshot_id = f.snapshot_id""", "level bids_to_absorb ask_fuel_remaining")  # fmt: skip
def _(m: Market):
    return book.path_descent(m.book_levels, m.book_prices)


@query("a29_wall_concentration", f"""WITH s AS (SELECT symbol, snapshot_id, coalesce(sum(qty) FILTER (side = 'ask' AND price_ticks - pt BETWEEN 10 AND 50), 0E0) AS qty, count(*) FILTER (side = 'ask' AND price_ticks - pt BETWEEN 10 AND 50) AS levels,
    coalesce(sum(price * qty) FILTER (side = 'ask' AND price_ticks - pt BETWEEN 10 AND 50), 0E0) AS notional, coalesce(sum(qty) FILTER (side = 'ask' AND price_ticks <= pt + 50), 0E0) AS required FROM {NEAR} n GROUP BY ALL)
  SELECT *, qty * 100 / nullif(required, 0) AS pct_of_required, required > 0 AND qty > required * 0.5 AS heavy_wall FROM s""", "qty notional required pct_of_required")  # fmt: skip
def _(m: Market):
    return book.wall_concentration(m.book_levels, m.book_prices)


@query("a24_densest_clusters", """WITH f AS (SELECT DISTINCT symbol, snapshot_id, price_ticks AS ft, price AS floor FROM {book_levels} WHERE side = 'bid' AND qty >= 100),
  c AS (SELECT f.symbol, f.snapshot_id, floor AS lo, floor + 0.10 AS hi, coalesce(sum(qty), 0E0) AS qty FROM f LEFT JOIN {book_levels} l ON f.symbol = l.symbol AND f.snapshot_id = l.snapshot_id AND side = 'bid' AND price_ticks BETWEEN ft AND ft + 10 GROUP BY f.symbol, f.snapshot_id, ft, floor)
  SELECT *, row_number() OVER (PARTITION BY symbol, snapshot_id ORDER BY qty DESC, lo) AS rank FROM c""", "lo hi qty")  # fmt: skip
def _(m: Market):
    floors = m.book_levels.where("side = 'bid' and qty >= 100").select("symbol", "snapshot_id", F.col("price").alias("floor"))
    return book.densest_clusters(m.book_levels, floors)


@query("a28_keystone_wall_balance", f"""WITH s AS (SELECT symbol, snapshot_id, coalesce(sum(qty) FILTER (side = 'bid' AND abs(price_ticks - kt) <= 10), 0E0) AS keystone_qty, coalesce(sum(price * qty) FILTER (side = 'bid' AND abs(price_ticks - kt) <= 10), 0E0) AS keystone_notional,
    coalesce(sum(qty) FILTER (side = 'ask' AND price_ticks - pt BETWEEN 10 AND 50), 0E0) AS wall_qty, coalesce(sum(price * qty) FILTER (side = 'ask' AND price_ticks - pt BETWEEN 10 AND 50), 0E0) AS wall_notional FROM {KNEAR} n GROUP BY ALL)
  SELECT *, keystone_qty / greatest(wall_qty, 1e-9) AS qty_ratio, keystone_notional / greatest(wall_notional, 1e-9) AS notional_ratio FROM s""", "keystone_qty keystone_notional wall_qty wall_notional qty_ratio notional_ratio")  # fmt: skip
def _(m: Market):
    return book.keystone_wall_balance(m.book_levels, keystones(m))


COUNTS = """(WITH a AS (SELECT symbol, snapshot_id, qty, lag(qty) OVER (PARTITION BY symbol, snapshot_id ORDER BY price_ticks) AS prev FROM {book_levels} WHERE side = 'ask')
  SELECT symbol, snapshot_id, count(*) FILTER (prev > 0 AND qty >= prev * 1.15) AS walls_built, count(*) FILTER (prev > 0 AND qty <= prev / 1.15) AS walls_eroded FROM a GROUP BY ALL)"""


@query("a39_adjacent_wall_counts", f"SELECT * FROM {COUNTS} c")
def _(m: Market):
    return book.adjacent_wall_counts(m.book_levels)


@query("c9_wall_trap", f"""SELECT f.symbol, f.snapshot_id, ratio, walls_built, walls_eroded, CASE WHEN ratio > 1.5 AND walls_built <= 1 THEN 0.65E0 WHEN ratio > 1.2 AND walls_built <= 2 THEN 0.55E0 WHEN ratio > 1 THEN 0.45E0 ELSE 0.3E0 END AS probability_absorb,
  walls_built >= 3 OR ratio < 1 AS trap_down FROM {FUEL} f JOIN {COUNTS} c ON f.symbol = c.symbol AND f.snapshot_id = c.snapshot_id""", "ratio probability_absorb")  # fmt: skip
def _(m: Market):
    return book.wall_trap(book.wall_fuel_ratio(m.book_levels, m.book_prices), book.adjacent_wall_counts(m.book_levels))


WALLS = "(SELECT symbol, snapshot_id AS cycle, price_ticks, qty FROM {book_levels} WHERE side = 'ask' AND qty >= 60 AND NOT " + NEWEST_SNAPSHOT + ")"


def walls(m: Market):
    return m.newest(m.book_levels.where("side = 'ask' and qty >= 60"), older=True).select("symbol", F.col("snapshot_id").alias("cycle"), "price_ticks", "qty")


PRIOR = f"(SELECT symbol, price_ticks, arg_max(qty, cycle) AS qty, max(cycle) AS last_cycle FROM {WALLS} w GROUP BY ALL)"


@query("u3_accumulate_prior_walls", f"SELECT * FROM {PRIOR} p", "qty")
def _(m: Market):
    return book.accumulate_prior_walls(walls(m))


@query("j5_wall_delta", f"""WITH n AS (SELECT p.symbol, p.price_ticks AS wall, p.qty AS prior, coalesce(sum(l.qty) FILTER (l.price_ticks = p.price_ticks), 0E0) AS current_exact, coalesce(sum(l.qty), 0E0) AS current_window FROM {PRIOR} p
    LEFT JOIN (SELECT * FROM {{book_levels}} WHERE side = 'ask' AND {NEWEST_SNAPSHOT}) l ON p.symbol = l.symbol AND l.price_ticks BETWEEN p.price_ticks - 5 AND p.price_ticks + 5 GROUP BY p.symbol, p.price_ticks, p.qty)
  SELECT *, current_window - prior AS delta_window, CASE WHEN current_window > prior * 1.15 THEN 'BUILT UP' WHEN current_window < prior / 1.15 THEN 'ERODED' ELSE 'STABLE' END AS direction FROM n""",
       "prior current_exact current_window delta_window")
def _(m: Market):
    return book.wall_delta(book.accumulate_prior_walls(walls(m)), m.newest(m.book_levels), window=0.10)


@query("j6_wall_set_diff", """WITH w AS (SELECT symbol, snapshot_id, price_ticks FROM {book_levels} WHERE side = 'ask' AND qty >= 60), c AS (SELECT symbol, snapshot_id, lag(snapshot_id) OVER (PARTITION BY symbol ORDER BY snapshot_id) AS prev_id FROM (SELECT DISTINCT symbol, snapshot_id FROM w) d),
  n AS (SELECT c.symbol, c.snapshot_id, price_ticks FROM c JOIN w ON c.symbol = w.symbol AND c.snapshot_id = w.snapshot_id WHERE prev_id IS NOT NULL), o AS (SELECT c.symbol, c.snapshot_id, price_ticks FROM c JOIN w ON c.symbol = w.symbol AND c.prev_id = w.snapshot_id)
  SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.price_ticks, o.price_ticks) AS price_ticks, CASE WHEN o.symbol IS NULL THEN 'wall_formed' ELSE 'wall_absorbed' END AS event
  FROM n FULL JOIN o ON n.symbol = o.symbol AND n.snapshot_id = o.snapshot_id AND n.price_ticks = o.price_ticks WHERE n.symbol IS NULL OR o.symbol IS NULL""")  # fmt: skip
def _(m: Market):
    return book.wall_set_diff(m.book_levels.where("side = 'ask' and qty >= 60").select("symbol", "snapshot_id", "price_ticks"))


@query("c22_ladder_l2", f"""SELECT symbol, snapshot_id, string_agg(CASE WHEN side = 'bid' THEN price_ticks || ':' || CAST(qty AS BIGINT) END, ',' ORDER BY level_rank) AS bids,
  string_agg(CASE WHEN side = 'ask' THEN price_ticks || ':' || CAST(qty AS BIGINT) END, ',' ORDER BY level_rank) AS asks FROM {RANKED} r WHERE level_rank <= 5 GROUP BY ALL""")  # fmt: skip
def _(m: Market):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.rint(x["price"] * 100).cast("long").cast("string"), F.lit(":"), x["qty"].cast("long").cast("string"))), ",")
    return book.ladder_l2(m.book_levels).select("symbol", "snapshot_id", F.when(F.size("bids") > 0, text("bids")).alias("bids"), F.when(F.size("asks") > 0, text("asks")).alias("asks"))


@query("c11_wall_band", """WITH p AS (SELECT *, CASE WHEN snapshot_id % 5 = 0 THEN NULL ELSE snapshot_id * 0.15 END AS atr_pct FROM {book_prices}),
  b AS (SELECT *, CASE WHEN atr_pct >= 2 THEN 300E0 WHEN atr_pct > 0.5 THEN 30 + (atr_pct - 0.5) / 1.5 * 270 ELSE 30E0 END AS band_bps FROM p)
  SELECT symbol, snapshot_id, price, atr_pct, band_bps, CASE WHEN atr_pct IS NULL OR atr_pct <= 0 THEN 'default_floor' WHEN atr_pct >= 2 THEN 'atr_ceiling' WHEN atr_pct <= 0.5 THEN 'atr_floor' ELSE 'atr_linear' END AS scaling_source,
    price * (1 - band_bps / 10000) AS bid_floor, price AS entry, price * (1 + band_bps / 10000) AS ask_target FROM b""", "price atr_pct band_bps bid_floor entry ask_target")  # fmt: skip
def _(m: Market):
    return book.wall_band(m.book_prices.withColumn("atr_pct", F.when(F.col("snapshot_id") % 5 != 0, F.col("snapshot_id") * 0.15)))


@query("c10_keystone_scorecard", f"""WITH i AS (SELECT f.symbol, f.snapshot_id, f.ratio AS bid_ask_qty_ratio, a.tbr_last_pct / 100 AS taker_buy_trend, (f.snapshot_id - 10) * 0.02E0 AS oi_change_trend, 0.7E0 + f.snapshot_id * 0.01E0 AS top_long_drift, a.tbr_3avg_pct / 100 AS net_buy_trend
    FROM {FUEL} f JOIN {ALIGNMENT} a ON f.symbol = a.symbol),
  s AS (SELECT *, CASE WHEN bid_ask_qty_ratio > 0.5 THEN 2E0 WHEN bid_ask_qty_ratio > 0.3 THEN 1E0 ELSE 0E0 END + CASE WHEN taker_buy_trend > 0.55 THEN 2E0 WHEN taker_buy_trend > 0.5 THEN 1E0 ELSE 0E0 END
    + CASE WHEN oi_change_trend > 0 THEN 2E0 WHEN oi_change_trend > -0.1E0 THEN 1E0 ELSE 0E0 END + CASE WHEN top_long_drift < 0.75E0 THEN 2E0 WHEN top_long_drift < 0.8E0 THEN 1E0 ELSE 0E0 END + CASE WHEN net_buy_trend > 0.55 THEN 2E0 WHEN net_buy_trend > 0.5 THEN 1E0 ELSE 0E0 END AS raw_score FROM i)
  SELECT * EXCLUDE raw_score, round(raw_score, 2) AS score, raw_score, round(raw_score * 10, 1) AS holds_probability, round(100 - raw_score * 10, 1) AS breaks_probability FROM s""",
       "bid_ask_qty_ratio taker_buy_trend oi_change_trend top_long_drift net_buy_trend score raw_score holds_probability breaks_probability")
def _(m: Market):
    fuel = book.wall_fuel_ratio(m.book_levels, m.book_prices).select("symbol", "snapshot_id", F.col("ratio").alias("bid_ask_qty_ratio"))
    flow = book.flow_alignment(m.taker_bars_5m).select("symbol", (F.col("tbr_last_pct") / 100).alias("taker_buy_trend"), (F.col("tbr_3avg_pct") / 100).alias("net_buy_trend"))
    inputs = fuel.join(flow, "symbol").withColumn("oi_change_trend", (F.col("snapshot_id") - 10) * 0.02).withColumn("top_long_drift", F.col("snapshot_id") * 0.01 + 0.7)
    return book.keystone_scorecard(inputs)


_B, _N = "NOT is_buyer_maker", "price * qty"


@query("a10_keystone_trade_intensity", f"""WITH n AS (SELECT t.*, k.keystone, abs(price_ticks - round(k.keystone * 100, 4)) AS off FROM {{trades}} t JOIN (SELECT * FROM {KEYSTONE} x WHERE {NEWEST_SNAPSHOT}) k ON t.symbol = k.symbol)
  SELECT symbol, keystone, count(*) FILTER (off <= 5 AND {_B}) AS tight_buy_count, coalesce(sum(qty) FILTER (off <= 5 AND {_B}), 0E0) AS tight_buy_qty, coalesce(sum({_N}) FILTER (off <= 5 AND {_B}), 0E0) AS tight_buy_notional,
    count(*) FILTER (off <= 5 AND is_buyer_maker) AS tight_sell_count, coalesce(sum(qty) FILTER (off <= 5 AND is_buyer_maker), 0E0) AS tight_sell_qty, coalesce(sum({_N}) FILTER (off <= 5 AND is_buyer_maker), 0E0) AS tight_sell_notional,
    count(*) FILTER ({_B} AND qty >= 5) AS wide_buy_count, coalesce(sum({_N}) FILTER ({_B} AND qty >= 5), 0E0) AS wide_buy_notional FROM n WHERE off <= 10 GROUP BY ALL""",
       "keystone tight_buy_qty tight_buy_notional tight_sell_qty tight_sell_notional wide_buy_notional")
def _(m: Market):
    return book.keystone_trade_intensity(m.trades, m.newest(keystones(m)))


@query("a9_zone_buy_sell", f"""SELECT symbol, venue, CAST(round_even(price / 0.05, 0) AS BIGINT) AS zone, sum(CASE WHEN {_B} THEN qty ELSE 0E0 END) AS buy, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0E0 END) AS sell,
  count(*) FILTER ({_B}) AS buy_n, count(*) FILTER (is_buyer_maker) AS sell_n, sum(CASE WHEN {_B} THEN qty ELSE -qty END) AS net, CAST(round_even(price / 0.05, 0) AS BIGINT) * 0.05 AS price
  FROM {{trades}} t WHERE price_ticks BETWEEN 9950 AND 10050 GROUP BY symbol, venue, CAST(round_even(t.price / 0.05, 0) AS BIGINT)""", "buy sell net price")  # fmt: skip
def _(m: Market):
    return book.zone_buy_sell(m.trades, 99.5, 100.5)


HISTORY = f"(SELECT symbol, snapshot_id AS cycle_ts, CASE WHEN snapshot_id % 7 = 3 THEN NULL ELSE keystone END AS keystone_price FROM {KEYSTONE} k)"


@query("w9_keystone_cycle_migration", f"""WITH m AS (SELECT symbol, cycle_ts, keystone_price AS keystone, keystone_price - lag(keystone_price) OVER (PARTITION BY symbol ORDER BY cycle_ts) AS d FROM {HISTORY} h WHERE keystone_price IS NOT NULL)
  SELECT symbol, cycle_ts, keystone, CASE WHEN d > 0.0749 THEN 'UP' WHEN d < -0.0749 THEN 'DOWN' WHEN d IS NOT NULL THEN 'FLAT' END AS migration FROM m""", "keystone")  # fmt: skip
def _(m: Market):
    history = keystones(m).select("symbol", F.col("snapshot_id").alias("cycle_ts"), F.when(F.col("snapshot_id") % 7 != 3, F.col("keystone")).alias("keystone_price"))
    return tape.keystone_cycle_migration(history, width=0.0749)
