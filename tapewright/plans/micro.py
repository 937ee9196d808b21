"""Registered microstructure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions.columns import bucket_start
from tapewright.operators import micro, rules
from tapewright.plans.registry import query
from tapewright.plans.rules import SPANS
from tapewright.sources.views import Market

EVENTS = """(WITH q AS (SELECT *, lag(bid_ticks) OVER w AS pb, lag(ask_ticks) OVER w AS pa, lag(bid_qty) OVER w AS pbq, lag(ask_qty) OVER w AS paq FROM {quotes} WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts_ms, update_id))
  SELECT *, CASE WHEN bid_ticks >= pb THEN bid_qty ELSE 0E0 END - CASE WHEN bid_ticks <= pb THEN pbq ELSE 0E0 END - CASE WHEN ask_ticks <= pa THEN ask_qty ELSE 0E0 END + CASE WHEN ask_ticks >= pa THEN paq ELSE 0E0 END AS contribution,
    bid_ticks <> pb OR ask_ticks <> pa AS price_changed, (bid_ticks + ask_ticks) / 2E0 AS mid, (pb + pa) / 2E0 AS pmid FROM q WHERE pb IS NOT NULL AND (bid_ticks <> pb OR ask_ticks <> pa OR bid_qty <> pbq OR ask_qty <> paq))"""


def events(m: Market):
    return micro.book_events(m.quotes)


@query("p5_valid_quotes", "SELECT symbol, venue, update_id, bid_ticks, ask_ticks FROM {quotes} WHERE update_id % 10 <> 3")
def _(m: Market):
    crossed = m.quotes.withColumn("ask_ticks", F.when(F.col("update_id") % 10 == 3, F.col("bid_ticks")).otherwise(F.col("ask_ticks")))
    return micro.split_valid_quotes(crossed)[0].select("symbol", "venue", "update_id", "bid_ticks", "ask_ticks")


TICKS = [("S0", "spot", 0.01), ("S0", "futures", 0.1), ("S1", "spot", 0.01), ("S2", "futures", 0.05)]


@query("p7_tick_lookup", "SELECT symbol, venue, count(*) AS quotes, max(t) AS tick_size FROM {quotes} JOIN (VALUES ('S0', 'spot', 0.01E0), ('S0', 'futures', 0.1E0), ('S1', 'spot', 0.01E0), ('S2', 'futures', 0.05E0)) v(s, n, t) ON symbol = s AND venue = n GROUP BY ALL", "tick_size")
def _(m: Market):
    table = m.spark.createDataFrame(TICKS, "symbol string, venue string, tick_size double")
    return micro.with_tick(m.quotes, table)[0].groupBy("symbol", "venue").agg(F.count("*").alias("quotes"), F.max("tick_size").alias("tick_size"))


@query("p7_unknown_instruments", "SELECT DISTINCT symbol, venue FROM {quotes} WHERE (symbol, venue) NOT IN (('S0', 'spot'), ('S0', 'futures'), ('S1', 'spot'), ('S2', 'futures'))")
def _(m: Market):
    return micro.with_tick(m.quotes, m.spark.createDataFrame(TICKS, "symbol string, venue string, tick_size double"))[1]


@query("w25_c24_book_events", f"SELECT symbol, venue, update_id, ts_ms, bid_ticks, ask_ticks, contribution, price_changed FROM {EVENTS} e", "contribution")
def _(m: Market):
    return events(m).select("symbol", "venue", "update_id", "ts_ms", "bid_ticks", "ask_ticks", "contribution", "price_changed")


INTERVALS = f"""(WITH s AS (SELECT symbol, venue, ts_ms // 10000 * 10000 AS start_ms, count(*) AS n, sum(contribution) AS ofi, sum(CASE WHEN price_changed THEN 0E0 ELSE contribution END) AS queue_ofi, avg((bid_qty + ask_qty) / 2) AS average_depth,
    arg_min(pmid, update_id) AS mid_start, arg_max(mid, update_id) AS mid_end, min(update_id) AS first_update_id, max(update_id) AS last_update_id FROM {EVENTS} e GROUP BY ALL),
  d AS (SELECT symbol, venue, unnest(range(min(start_ms), max(start_ms) + 1, 10000)) AS start_ms FROM s GROUP BY symbol, venue)
  SELECT d.symbol, d.venue, d.start_ms, d.start_ms + 10000 AS end_ms, coalesce(n, 0) AS event_count, coalesce(ofi, 0E0) AS ofi, coalesce(queue_ofi, 0E0) AS queue_ofi, average_depth, mid_start, mid_end, first_update_id, last_update_id,
    CASE WHEN n IS NULL THEN 'insufficient' ELSE 'exact_feed' END AS quality FROM d LEFT JOIN s ON d.symbol = s.symbol AND d.venue = s.venue AND d.start_ms = s.start_ms)"""
SPARSE = """(SELECT * FROM {quotes} WHERE ts_ms // 10000 % 7 <> 3)"""


def intervals(m: Market):
    return micro.ofi_intervals(events(m))


@query("a33_a34_ofi_intervals", f"SELECT * FROM {INTERVALS} i", "ofi queue_ofi average_depth mid_start mid_end")
def _(m: Market):
    return intervals(m)


@query("a33_ofi_intervals_with_holes", f"SELECT symbol, venue, start_ms, event_count, ofi, quality FROM {INTERVALS} i".replace("{quotes}", SPARSE), "ofi")
def _(m: Market):
    sparse = m.quotes.where("ts_ms div 10000 % 7 <> 3")
    return micro.ofi_intervals(micro.book_events(sparse)).select("symbol", "venue", "start_ms", "event_count", "ofi", "quality")


OBSERVED = f"(SELECT symbol, venue, start_ms, ofi AS x, mid_end - mid_start AS y, average_depth FROM {INTERVALS} i WHERE quality = 'exact_feed' AND mid_start IS NOT NULL AND mid_end IS NOT NULL)"


@query("j11_price_impact_observations", f"SELECT * FROM {OBSERVED} o", "x y average_depth")
def _(m: Market):
    return micro.price_impact_observations(intervals(m))


FEATURES = f"""(SELECT e.symbol, e.venue, e.ts_ms, e.update_id, i.ofi AS ofi_10s, i.average_depth AS ad_10s, (ask_ticks * bid_qty + bid_ticks * ask_qty) / (bid_qty + ask_qty) - mid AS dmu, (ask_ticks - bid_ticks) / mid * 10000 AS spread_bps,
  (bid_qty - ask_qty) / (bid_qty + ask_qty) AS obi_top, ((ask_ticks * bid_qty + bid_ticks * ask_qty) / (bid_qty + ask_qty) / mid - 1) * 10000 AS skew_bps
  FROM {EVENTS} e LEFT JOIN {INTERVALS} i ON e.symbol = i.symbol AND e.venue = i.venue AND e.ts_ms // 10000 * 10000 = i.start_ms + 10000 AND i.quality = 'exact_feed')"""


def features(m: Market):
    return micro.feature_vectors(events(m), intervals(m))


@query("j10_c19_feature_vectors", f"SELECT * FROM {FEATURES} f", "ofi_10s ad_10s dmu spread_bps obi_top skew_bps")
def _(m: Market):
    return features(m)


LABELS = f"""(WITH mi AS (SELECT symbol, venue, ts_ms AS t, arg_min(mid, update_id) AS mid FROM {EVENTS} e GROUP BY ALL),
  p AS (SELECT symbol, venue, update_id, ts_ms, unnest([1000, 5000, 30000, 60000])::INTEGER AS horizon_ms FROM {EVENTS} e),
  f AS (SELECT p.*, mi.mid AS fwd FROM (SELECT *, ts_ms + horizon_ms AS target FROM p) p ASOF LEFT JOIN mi ON p.symbol = mi.symbol AND p.venue = mi.venue AND p.target <= mi.t),
  b AS (SELECT f.*, mi.mid AS base FROM f ASOF LEFT JOIN mi ON f.symbol = mi.symbol AND f.venue = mi.venue AND f.ts_ms <= mi.t)
  SELECT symbol, venue, ts_ms, update_id, horizon_ms, fwd - base AS y_ticks, CASE WHEN fwd IS NULL OR base IS NULL THEN 'end_of_window' END AS excluded FROM b)"""


def labels(m: Market):
    e = events(m)
    return micro.forward_labels(e, e)


@query("j8_forward_asof_join", f"SELECT * FROM {LABELS} l", "y_ticks")
def _(m: Market):
    return labels(m)


DEGRADED = f"""(WITH l AS (SELECT *, ts_ms + horizon_ms AS target FROM {LABELS} x), e AS (SELECT symbol, max(target) AS stop FROM l GROUP BY ALL), s AS (SELECT g.symbol, lo, coalesce(hi, stop + 1) AS hi, reason FROM {SPANS} g JOIN e ON g.symbol = e.symbol),
  h AS (SELECT l.symbol, l.venue, l.update_id, l.ts_ms, l.horizon_ms, arg_min(s.reason, s.lo) AS reason FROM l JOIN s ON l.symbol = s.symbol AND s.lo < l.target AND s.hi > l.ts_ms GROUP BY ALL)
  SELECT l.symbol, l.venue, l.ts_ms, l.update_id, l.horizon_ms, CASE WHEN h.reason IS NULL THEN y_ticks END AS y_ticks, coalesce(h.reason, l.excluded) AS excluded FROM l LEFT JOIN h ON l.symbol = h.symbol AND l.venue = h.venue AND l.update_id = h.update_id AND l.ts_ms = h.ts_ms AND l.horizon_ms = h.horizon_ms)"""


def usable_labels(m: Market, spans=None):
    """Labels without those that overlap a degraded span; all spans unless some are given."""
    return micro.exclude_degraded(labels(m), rules.status_spans(m.capture_status) if spans is None else spans)


@query("j9_degraded_span_exclusion", f"SELECT * FROM {DEGRADED} d", "y_ticks")
def _(m: Market):
    return usable_labels(m)


CANDIDATES = f"""(WITH s AS (SELECT *, sum(contribution) OVER w AS flow, sum(CASE WHEN bid_ticks = pb AND bid_qty > pbq THEN 1 ELSE 0 END) OVER w AS refills, count(*) OVER w AS n, arg_max(mid, update_id) OVER w AS last_mid FROM {EVENTS} e
    WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts_ms RANGE BETWEEN CURRENT ROW AND 30000 FOLLOWING))
  SELECT symbol, venue, ts_ms, update_id, bid_ticks, flow, CAST(refills AS BIGINT) AS refills, last_mid - pmid AS response_ticks FROM s WHERE n >= 2 AND flow < 0 AND refills >= 2 AND pmid - last_mid <= 5)"""


@query("w33_absorption_candidates", f"SELECT * FROM {CANDIDATES} c", "flow response_ticks")
def _(m: Market):
    return micro.absorption_candidates(events(m))


@query("w33_detect_absorption", f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts_ms, update_id) AS rn FROM {CANDIDATES} x),
  j AS (SELECT *, min(rn) OVER (PARTITION BY symbol, venue ORDER BY ts_ms RANGE BETWEEN 60000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM c),
  f AS (SELECT * FROM j WHERE rn = 1 UNION ALL SELECT j.* FROM f JOIN j ON f.symbol = j.symbol AND f.venue = j.venue AND f.nxt = j.rn)
  SELECT symbol, venue, ts_ms, update_id, bid_ticks, flow, refills, response_ticks FROM f""", "flow response_ticks")
def _(m: Market):
    return micro.detect_absorption(events(m))


@query("w34_detect_walls", f"""WITH e AS (SELECT *, max(ts_ms) OVER (PARTITION BY symbol, venue) AS last_ms, abs(bid_ticks - mid) / mid * 10000 AS dist FROM {EVENTS} x),
  w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts_ms, update_id) AS rn FROM e WHERE bid_qty >= 40 AND dist <= 50 AND last_ms - ts_ms >= 20000) y WHERE rn = 1)
  SELECT w.symbol, w.venue, w.ts_ms AS t0, w.bid_ticks AS wall_ticks, w.bid_qty AS size, w.dist AS distance_bps, max(e.ts_ms) - w.ts_ms AS persistence_ms, sum(CASE WHEN e.bid_ticks = w.bid_ticks AND e.bid_qty > e.pbq THEN e.bid_qty - e.pbq ELSE 0E0 END) AS adds,
    sum(CASE WHEN e.bid_ticks = w.bid_ticks AND e.bid_qty < e.pbq THEN e.pbq - e.bid_qty ELSE 0E0 END) AS cancels, sum(CASE WHEN e.bid_ticks = w.bid_ticks THEN e.contribution ELSE 0E0 END) AS flow, arg_max(e.mid, e.ts_ms) - any_value(w.pmid) AS response_ticks
  FROM w JOIN e ON w.symbol = e.symbol AND w.venue = e.venue AND (e.ts_ms > w.ts_ms OR (e.ts_ms = w.ts_ms AND e.update_id >= w.update_id)) AND e.ts_ms - w.ts_ms <= 60000 GROUP BY w.symbol, w.venue, w.ts_ms, w.bid_ticks, w.bid_qty, w.dist HAVING max(e.ts_ms) - w.ts_ms >= 20000""",
       "size distance_bps adds cancels flow response_ticks")
def _(m: Market):
    return micro.detect_walls(events(m))


SESSIONS = """(WITH g AS (SELECT *, lag(final_update_id) OVER w AS previous_final_id, coalesce(first_update_id > lag(final_update_id) OVER w + 1, false) AS is_gap FROM {depth_deltas} WINDOW w AS (PARTITION BY symbol, venue ORDER BY final_update_id))
  SELECT *, CAST(sum(is_gap::INT) OVER (PARTITION BY symbol, venue ORDER BY final_update_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"""


@query("x5_sequence_gap_report", f"SELECT symbol, venue, final_update_id, previous_final_id, is_gap, session FROM {SESSIONS} s")
def _(m: Market):
    return micro.sequence_gaps(m.depth_deltas).select("symbol", "venue", "final_update_id", "previous_final_id", "is_gap", "session")


@query("x5_bootstrap_bridge", """SELECT d.symbol, d.venue, s.sid AS snapshot_update_id, min(final_update_id) AS bridge_final_id, arg_min(first_update_id, final_update_id) AS bridge_first_id FROM {depth_deltas} d
  JOIN (SELECT symbol, venue, max(final_update_id) // 2 AS sid FROM {depth_deltas} GROUP BY ALL) s ON d.symbol = s.symbol AND d.venue = s.venue WHERE final_update_id > sid AND first_update_id <= sid + 1 GROUP BY ALL""")  # fmt: skip
def _(m: Market):
    snaps = m.depth_deltas.groupBy("symbol", "venue").agg(F.floor(F.max("final_update_id") / 2).alias("snapshot_update_id"))
    return micro.bootstrap_bridge(m.depth_deltas, snaps)


@query("x4_book_replay", f"""WITH d AS (SELECT * FROM {SESSIONS} s), p AS (SELECT DISTINCT symbol, venue, session, side, price_ticks FROM d),
  g AS (SELECT d.symbol, d.venue, d.session, d.final_update_id, d.ts_ms, p.side, p.price_ticks FROM d JOIN p ON d.symbol = p.symbol AND d.venue = p.venue AND d.session = p.session),
  l AS (SELECT g.*, c.qty FROM g ASOF LEFT JOIN (SELECT symbol, venue, session, side, price_ticks, final_update_id, qty FROM d) c ON g.symbol = c.symbol AND g.venue = c.venue AND g.session = c.session AND g.side = c.side AND g.price_ticks = c.price_ticks AND g.final_update_id >= c.final_update_id)
  SELECT symbol, venue, session, final_update_id, any_value(ts_ms) AS ts_ms, max(price_ticks) FILTER (side = 'bid' AND qty > 0) AS bid_ticks, arg_max(qty, price_ticks) FILTER (side = 'bid' AND qty > 0) AS bid_qty,
    min(price_ticks) FILTER (side = 'ask' AND qty > 0) AS ask_ticks, arg_min(qty, price_ticks) FILTER (side = 'ask' AND qty > 0) AS ask_qty FROM l GROUP BY symbol, venue, session, final_update_id""", "bid_qty ask_qty")  # fmt: skip
def _(m: Market):
    return micro.replay_book(m.depth_deltas, chunk_ms=60_000)


@query("c1_bucket_start", "SELECT symbol, venue, trade_id, ts_ms, (ts_ms + 19800000) // 3600000 * 3600000 - 19800000 AS bar_1h, (ts_ms + 19800000) // 14400000 * 14400000 - 19800000 AS bar_4h, ts_ms // 900000 * 900000 AS bar_15m FROM {trades}")
def _(m: Market):
    return m.trades.select(
        "symbol", "venue", "trade_id", "ts_ms", bucket_start("ts_ms", 3_600_000, 19_800_000).alias("bar_1h"), bucket_start("ts_ms", 14_400_000, 19_800_000).alias("bar_4h"), bucket_start("ts_ms", 900_000, 19_800_000).alias("bar_15m")
    )
