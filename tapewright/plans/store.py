"""Registered queries of sources, stores, sets and notes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapewright.operators import book, recall
from tapewright.plans import bars as pb
from tapewright.plans import tape as ptape
from tapewright.plans.book import RANKED
from tapewright.plans.registry import folder, query
from tapewright.sources import records, store
from tapewright.sources.views import NEWEST_SNAPSHOT, Market


def raw_trades(m: Market):
    """Trades of both spellings, some of them broken, made from the tape."""
    t = m.trades
    one = F.col("trade_id") % 2 == 0
    price = F.when(F.col("trade_id") % 17 == 0, "oops").otherwise(F.col("price").cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    return t.select(
        "symbol", "venue", F.when(one, price).alias("p"), F.when(~one, price).alias("price"), F.when(one, F.col("qty").cast("string")).alias("q"), F.when(~one, F.col("qty").cast("string")).alias("qty"),
        F.when(one, F.col("is_buyer_maker")).alias("m"), F.when(~one, F.col("is_buyer_maker")).alias("isBuyerMaker"), null("boolean").alias("is_buyer_maker"), F.when(one, F.col("ts_ms")).alias("T"), F.when(~one, F.col("ts_ms")).alias("time"),
        F.when(one, F.col("trade_id")).alias("a"), F.when(~one, F.col("trade_id")).alias("id"), null("string").alias("quoteQty"),
    )


@query("s3_normalize_trades", "SELECT venue, trade_id, ts_ms, price, qty, price * qty AS quote_qty, is_buyer_maker, CASE WHEN is_buyer_maker THEN 'sell' ELSE 'buy' END AS side FROM {trades} WHERE trade_id % 17 <> 0", "price qty quote_qty")
def _(m: Market):
    return records.normalize_trades(raw_trades(m), F.col("venue"))[0]


@query("s3_rejected_trades", "SELECT venue, count(*) AS rejected FROM {trades} WHERE trade_id % 17 = 0 GROUP BY ALL")
def _(m: Market):
    return records.normalize_trades(raw_trades(m), F.col("venue"))[1].groupBy("venue").agg(F.count("*").alias("rejected"))


@query("s4_normalize_bars", "SELECT symbol, bucket_ms, sum_open_interest, sum_open_interest_value FROM {oi_history_5m}", "sum_open_interest sum_open_interest_value")
def _(m: Market):
    camel = m.oi_history_5m.select("symbol", F.col("bucket_ms").alias("bucketMs"), F.col("sum_open_interest").cast("string").alias("sumOpenInterest"), F.col("sum_open_interest_value").cast("string").alias("sumOpenInterestValue"))
    return records.normalize_bars(camel, ["sum_open_interest", "sum_open_interest_value"])


@query("s5_normalize_identity", "SELECT symbol, venue, count(*) AS n FROM {trades} GROUP BY ALL")
def _(m: Market):
    messy = m.trades.select(F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), F.when(F.col("venue") == "futures", "Perps ").otherwise("SPOT").alias("venue"))
    return records.normalize_identity(messy).groupBy("symbol", "venue").agg(F.count("*").alias("n"))


#: Trades of a row of a raw snapshot, about; a larger snapshot comes in several rows.
SNAPSHOT_TRADES = 5_000


def snapshots(m: Market, most: int = SNAPSHOT_TRADES):
    """Nested raw snapshots of five minutes; a trade is also in the snapshot after its own.

    A snapshot of more than ``most`` trades is dealt by trade to rows of the same
    symbol and time, so no row holds all trades of a busy symbol.
    """
    own = F.floor(F.col("ts_ms") / 300_000)
    t = m.trades.select("symbol", "venue", F.explode(F.array(own, own + 1)).alias("s"), F.struct(F.col("trade_id").alias("id"), F.col("ts_ms").alias("ts"), "price", "qty", "is_buyer_maker").alias("t"))
    sizes = t.groupBy("symbol", "s").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = t.join(sizes, ["symbol", "s"]).withColumn("part", F.pmod(F.xxhash64("t.id"), F.col("parts")))
    sides = dealt.groupBy("symbol", "s", "part").pivot("venue", ["spot", "futures"]).agg(F.collect_list("t"))
    return sides.select("symbol", (F.col("s") * 300_000).alias("observed_at_ms"), F.struct(F.col("spot").alias("trades_normalized")).alias("spot"), F.struct(F.col("futures").alias("trades_normalized")).alias("futures"))


@query("s1_s2_trades_from_snapshots", f"SELECT symbol, (ts_ms // 300000 + k) * 300000 AS observed_at_ms, venue, trade_id, ts_ms, price, qty, is_buyer_maker FROM {{trades}} t, (SELECT unnest([0, 1]) AS k) x", "price qty")
def _(m: Market):
    path = f"{folder(m)}/snapshots-{uuid.uuid4().hex}"
    snapshots(m).write.json(path)
    return records.trades_from_snapshots(records.read_snapshots(m.spark, path))


@query("s6_slim_snapshots", f"SELECT symbol, (ts_ms // 300000 + k) * 300000 AS observed_at_ms, count(*) FILTER (venue = 'spot') AS spot_trades, count(*) FILTER (venue = 'futures') AS futures_trades FROM {{trades}} t, (SELECT unnest([0, 1]) AS k) x GROUP BY ALL")
def _(m: Market):
    slim = records.slim_snapshots(snapshots(m))
    return slim.groupBy("symbol", "observed_at_ms").agg(*[F.sum(F.size(f"{v}.trades_normalized")).alias(f"{v}_trades") for v in ("spot", "futures")])


@query("s7_read_quote_tape", "SELECT ts_ms, bid_ticks / 100E0 AS bid, bid_qty, ask_ticks / 100E0 AS ask, ask_qty FROM {quotes}", "bid bid_qty ask ask_qty")
def _(m: Market):
    text = lambda c: (F.col(c) / 100).cast("decimal(18,2)").cast("string")
    rows = m.quotes.select(F.col("ts_ms").alias("ts"), text("bid_ticks").alias("bid"), F.col("bid_qty").cast("string").alias("bidQty"), text("ask_ticks").alias("ask"), F.col("ask_qty").cast("string").alias("askQty"))
    path = f"{folder(m)}/tapewright-tape-{uuid.uuid4().hex}"
    rows.write.json(path)
    tape = records.read_quote_tape(m.spark, path)
    number = lambda c, name: F.col(c).cast("double").alias(name)
    return tape.select("ts_ms", number("bid_price", "bid"), number("bid_qty", "bid_qty"), number("ask_price", "ask"), number("ask_qty", "ask_qty"))


@query("s8_read_tape_range", "SELECT * FROM {quotes} WHERE symbol = 'S1' AND venue = 'spot' AND ts_ms >= 1704067210000 AND ts_ms < 1704067300000 ORDER BY ts_ms, update_id LIMIT 50", "bid_qty ask_qty")
def _(m: Market):
    return store.read_tape_range(m.quotes, "S1", "spot", 1704067210000, 1704067300000, 50)


@query("s9_append_idempotent", "SELECT symbol, venue, update_id, ts_ms FROM {quotes} WHERE update_id % 2 <> 0")
def _(m: Market):
    q = m.quotes.select("symbol", "venue", "update_id", "ts_ms")
    new = q.where("update_id % 3 = 0 or update_id % 2 <> 0")  # a third of the stored rows come again
    key = ["symbol", "venue", "update_id"]
    return store.fresh_rows(new.union(new), store.reachable(q.where("update_id % 2 = 0"), new, key), key)


@query("s10_t3_latest_per_key", "SELECT symbol, venue, ts_ms, update_id, bid_ticks, ask_ticks FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts_ms DESC, update_id DESC) AS rn FROM {quotes}) x WHERE rn = 1")
def _(m: Market):
    return store.latest_per_key(m.quotes.select("symbol", "venue", "ts_ms", "update_id", "bid_ticks", "ask_ticks"), ["symbol", "venue"], ["ts_ms", "update_id"])


@query("s11_snapshot_dedupe", "SELECT DISTINCT symbol, venue, ts_ms - ts_ms % 5000 AS observed_at_ms FROM {trades}")
def _(m: Market):
    return m.trades.select("symbol", "venue", (F.col("ts_ms") - F.col("ts_ms") % 5000).alias("observed_at_ms")).dropDuplicates(["symbol", "venue", "observed_at_ms"])


@query("s12_retention_filter", """SELECT symbol, venue, update_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts_ms DESC, update_id) AS rk FROM {quotes}) x
  WHERE (1704067500000 - ts_ms <= 120000 OR rk <= 20) AND rk <= 60""")  # fmt: skip
def _(m: Market):
    return store.retention_filter(m.quotes.select("symbol", "venue", "update_id", "ts_ms"), ["symbol", "venue"], "ts_ms", F.lit(1704067500000), 120_000, 20, 60)


@query("s13_json_safe", "SELECT symbol, bucket_ms, CASE WHEN sum_open_interest::BIGINT % 3 = 0 THEN NULL ELSE sum_open_interest END AS value FROM {oi_history_5m}", "value")
def _(m: Market):
    oi = F.col("sum_open_interest")
    dirty = m.oi_history_5m.select("symbol", "bucket_ms", F.when(oi.cast("long") % 3 == 0, F.when(oi.cast("long") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(oi).alias("value"))
    return records.json_safe(dirty)


@query("s14_bound_arrays", "SELECT symbol, snapshot_id, least(count(*), 25) AS kept, count(*) AS count, count(*) > 25 AS truncated FROM {book_levels} GROUP BY ALL")
def _(m: Market):
    rows = m.book_levels.groupBy("symbol", "snapshot_id").agg(F.collect_list("price_ticks").alias("a")).withColumn("b", records.bound_array(F.col("a"), 25))
    return rows.select("symbol", "snapshot_id", F.size("b.items").cast("long").alias("kept"), F.col("b.count").cast("long").alias("count"), F.col("b.truncated").alias("truncated"))


@query("p8_evidence_headlines", "SELECT symbol, max(price) AS mark_price, max(qty) AS open_interest FROM {trades} GROUP BY ALL", "mark_price open_interest")
def _(m: Market):
    doc = m.trades.groupBy("symbol").agg(F.max("price").alias("p"), F.max("qty").alias("q")).select("symbol", F.struct(F.lit(None).cast("double").alias("mark_price"), F.col("p").alias("markPrice")).alias("futures"), F.col("q").alias("openInterest"))
    return records.headline(doc, {"mark_price": ["futures.mark_price", "futures.markPrice"], "open_interest": ["open_interest", "openInterest"]}, ["symbol"])


@query("p13_ticker_change", f"SELECT symbol, bucket_ms, CASE WHEN bucket_ms % 900000 <> 0 THEN round(close - open, 2) END AS change_pct_24h FROM {pb.FUT} k", "change_pct_24h")
def _(m: Market):
    rows = pb.futures(m).select("symbol", "bucket_ms", F.when(F.col("bucket_ms") % 900_000 == 0, "n/a").otherwise(F.round(F.col("close") - F.col("open"), 2).cast("string")).alias("priceChangePercent"))
    return records.ticker_change(rows).drop("priceChangePercent")


@query("t4_recent_history", "SELECT symbol, bucket_ms, sum_open_interest, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket_ms DESC) AS rank FROM {oi_history_5m}) x WHERE rank <= 12", "sum_open_interest")
def _(m: Market):
    return store.recent_history(m.oi_history_5m.select("symbol", "bucket_ms", "sum_open_interest"), ["symbol"], "bucket_ms", 12)


@query("t7_watermark_max", "SELECT symbol, venue, max(ts_ms) AS watermark_ms FROM {quotes} GROUP BY ALL")
def _(m: Market):
    return store.watermark_max(m.quotes, ["symbol", "venue"], "ts_ms")


@query("u2_merge_tapes", "SELECT symbol, venue, update_id, ts_ms, CASE WHEN update_id % 3 <> 0 THEN bid_qty ELSE bid_qty + 1 END AS bid_qty, CASE WHEN update_id % 3 <> 0 THEN 'durable' ELSE 'live' END AS source FROM {quotes}", "bid_qty")
def _(m: Market):
    q = m.quotes.select("symbol", "venue", "update_id", "ts_ms", "bid_qty")
    return store.merge_tapes(q.where("update_id % 3 <> 0"), q.where("update_id % 3 = 0 or update_id % 2 = 0").withColumn("bid_qty", F.col("bid_qty") + 1), ["symbol", "venue", "update_id", "ts_ms"])


@query("u5_tombstone_filter", "SELECT id, max(created_seq) AS created_seq, arg_max(kind, created_seq) AS kind FROM (SELECT note_id % 700 AS id, * FROM {notes}) n GROUP BY id HAVING NOT arg_max(forgotten, created_seq)")
def _(m: Market):
    rows = m.notes.select((F.col("note_id") % 700).alias("id"), "created_seq", "kind", "forgotten")
    return store.tombstone_filter(rows, "id", "created_seq").drop("forgotten")


@query("u6_rebuild_projection", """WITH e AS (SELECT DISTINCT user_id % 50 AS subject, event_id, event_type, value FROM events)
  SELECT subject, count(*) AS event_count, max(event_id) AS seq, arg_max(event_type, event_id) AS state, arg_max(value, event_id) AS value FROM e GROUP BY ALL""", "value")  # fmt: skip
def _(m: Market):
    e = m.events.select((F.col("user_id") % 50).alias("subject"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("state"), "value")
    return store.rebuild_projection(e.union(e), ["subject"], "id", ["seq"]).drop("id")


@query("u7_shuffle_stability_check", f"SELECT count(*) AS rows_checked, 0 AS unstable_rows FROM {RANKED} r WHERE level_rank <= 20")
def _(m: Market):
    build = lambda t: book.top_levels(t, 20).select("symbol", "snapshot_id", "side", "price_ticks", "qty")
    unstable = store.shuffle_stability_check(build, m.book_levels).agg(F.count("*").alias("unstable_rows"))
    return build(m.book_levels).agg(F.count("*").alias("rows_checked")).join(F.broadcast(unstable))  # one row each


@query("j14_overlay_fresh_book", """WITH c AS (SELECT symbol, snapshot_id, count(*) FILTER (side = 'bid') AS b, count(*) FILTER (side = 'ask') AS a FROM {book_levels} GROUP BY ALL), d AS (SELECT symbol, max(snapshot_id) AS s FROM c WHERE snapshot_id > 15 AND symbol <> 'S0' AND a > 0 AND b > 0 GROUP BY ALL),
  r AS (SELECT symbol, max(snapshot_id) AS s FROM c WHERE snapshot_id <= 5 GROUP BY ALL) SELECT r.symbol, coalesce(d.s, r.s) AS ts_ms, b AS bids, a AS asks, CASE WHEN d.s IS NULL THEN 'rest' ELSE 'stream' END AS book_source FROM r LEFT JOIN d ON r.symbol = d.symbol JOIN c ON c.symbol = r.symbol AND c.snapshot_id = coalesce(d.s, r.s)""")  # fmt: skip
def _(m: Market):
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty")))
    books = m.book_levels.groupBy("symbol", F.col("snapshot_id").alias("ts_ms")).agg(side("bid").alias("bids"), side("ask").alias("asks"))
    rest = store.latest_per_key(books.where("ts_ms <= 5"), ["symbol"], ["ts_ms"])
    out = store.overlay_fresh_book(rest, books.where("ts_ms > 15 and symbol <> 'S0'"))
    return out.select("symbol", "ts_ms", F.size("bids").cast("long").alias("bids"), F.size("asks").cast("long").alias("asks"), "book_source")


@query("j15_merge_derivatives", """WITH o AS (SELECT symbol, count(*) AS n FROM {oi_history_5m} GROUP BY ALL), t AS (SELECT symbol, count(*) AS n FROM {taker_bars_5m} GROUP BY ALL)
  SELECT s.symbol, coalesce(o.n, 0) AS oi_bars, coalesce(t.n, 0) AS taker_bars FROM (SELECT DISTINCT symbol FROM {quotes}) s LEFT JOIN o ON s.symbol = o.symbol LEFT JOIN t ON s.symbol = t.symbol""")  # fmt: skip
def _(m: Market):
    evidence = m.quotes.select("symbol").distinct()
    out = store.merge_derivatives(evidence, oi=m.oi_history_5m, taker=m.taker_bars_5m)
    return out.select("symbol", F.col("oi_bars").cast("long").alias("oi_bars"), F.col("taker_bars").cast("long").alias("taker_bars"))


DECISIONS = "(SELECT event_id AS id, 1704067200000 + event_id * 250 AS ts_ms, CASE event_id % 3 WHEN 0 THEN 'tape' WHEN 1 THEN 'density' ELSE 'oi' END AS substrate, event_id % 4 <> 0 AS allowed FROM events)"


def decisions(m: Market):
    e = F.col("event_id")
    return m.events.select(e.alias("id"), (e * 250 + 1704067200000).alias("ts_ms"), F.when(e % 3 == 0, "tape").when(e % 3 == 1, "density").otherwise("oi").alias("substrate"), (e % 4 != 0).alias("allowed"))


@query("a45_decision_audit", f"SELECT * FROM {DECISIONS} d WHERE substrate = 'tape' AND NOT allowed ORDER BY ts_ms DESC LIMIT 40")
def _(m: Market):
    return store.decision_audit(decisions(m), 40, substrate="tape", allowed=False)


@query("a45_denial_rates", f"SELECT substrate, count(*) AS decisions, sum((NOT allowed)::INT) / count(*) AS denial_rate FROM {DECISIONS} d GROUP BY ALL", "denial_rate")
def _(m: Market):
    return store.denial_rates(decisions(m), ["substrate"])


QUERY = "the erent onth license version inthe"
_words = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]{{2,}}'))"


@query("t6_keyword_recall", f"""WITH s AS (SELECT session_id, note_id, created_seq, len(list_intersect({_words.format("content")}, {_words.format("'" + QUERY + "'")})) + importance / 10 AS score FROM {{notes}})
  SELECT session_id, rank, note_id, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, created_seq DESC) AS rank FROM s) x WHERE rank <= 16""", "score")  # fmt: skip
def _(m: Market):
    return recall.keyword_recall(m.notes, QUERY)


@query("a44_count_by_kind", "SELECT kind, count(*) AS notes FROM {notes} WHERE NOT forgotten GROUP BY ALL")
def _(m: Market):
    return recall.count_by_kind(m.notes)


_stop = ", ".join(f"'{w}'" for w in recall.STOP_WORDS)


@query("c25_text_fingerprint", f"""WITH w AS (SELECT note_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z]+')), lambda x: len(x) > 2 AND NOT list_contains([{_stop}], x)))[1:6] AS kept FROM {{notes}})
  SELECT note_id, CASE WHEN len(kept) > 0 THEN sha256(array_to_string(kept, ' '))[1:8] ELSE '-' END AS fingerprint FROM w""")  # fmt: skip
def _(m: Market):
    return m.notes.select("note_id", recall.text_fingerprint(F.col("content")).alias("fingerprint"))


@query("s15_ledger_rows", f"SELECT 'tape' AS substrate, symbol, venue, t AS calculated_at, delta AS value FROM {ptape.CVD} c UNION ALL SELECT 'oi', symbol, NULL, bucket_ms // 1000, sum_open_interest FROM {{oi_history_5m}}", "value")
def _(m: Market):
    from tapewright.operators import tape

    cvd = tape.bucketed_cvd(m.trades).select(F.lit("tape").alias("substrate"), "symbol", "venue", F.col("t").alias("calculated_at"), F.col("delta").alias("value"))
    oi = m.oi_history_5m.select(F.lit("oi").alias("substrate"), "symbol", F.lit(None).cast("string").alias("venue"), F.floor(F.col("bucket_ms") / 1000).alias("calculated_at"), F.col("sum_open_interest").alias("value"))
    return cvd.unionByName(oi)


@query("f1_f2_pluggable_flow_and_tiers", """SELECT b.symbol, t.share, b.total_qty, b.mega_count FROM (SELECT symbol, snapshot_id, sum(qty) AS total_qty, count(*) FILTER (price * qty >= 9000) AS mega_count FROM {book_levels} WHERE side = 'bid' AND """ + NEWEST_SNAPSHOT + """ GROUP BY ALL) b
  JOIN (SELECT symbol, sum(CASE WHEN is_buyer_maker THEN 0E0 ELSE price * qty END) / sum(price * qty) AS share FROM {trades} GROUP BY ALL) t ON b.symbol = t.symbol""", "share total_qty")  # fmt: skip
def _(m: Market):
    """A report with the caller's own flow function and tier limits."""
    from tapewright.operators import tape

    def report(flow, tiers):
        return book.bid_tiers(m.newest(m.book_levels), tiers).select("symbol", "total_qty", "mega_count").join(flow(m.trades), "symbol")

    return report(lambda t: tape.initiated_flow(t, ("symbol",)).select("symbol", F.col("buy_share").alias("share")), book.Tiers(9_000.0, 5_000.0, 1_000.0))
