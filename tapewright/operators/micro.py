"""Microstructure operators: best-quote events, order-flow imbalance, forward labels, detectors, book replay.

Quotes: ``symbol, venue, update_id, ts_ms, bid_ticks, ask_ticks, bid_qty,
ask_qty``. Keys are symbol and venue.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.chains import spaced, with_chains
from tapewright.functions.columns import bucket_start, ratio, sum_if
from tapewright.functions.ranges import RANGE, joined_by_key, with_highest_before, with_next_known, with_previous, with_reach, with_running_sum

KEYS = ("symbol", "venue")
#: Width of the time ranges into which a key's rows are dealt.
RANGE_MS = 3_600_000


def valid() -> Column:
    """Positive, uncrossed prices and queues that aren't negative."""
    return F.coalesce(
        (F.col("bid_ticks") > 0) & (F.col("ask_ticks") > F.col("bid_ticks")) & (F.col("bid_qty") >= 0) & (F.col("ask_qty") >= 0), F.lit(False)
    )


def split_valid_quotes(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable quotes, and the rejected rows."""
    return quotes.where(valid()), quotes.where(~valid())


def with_tick(rows: DataFrame, ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the tick size of their instrument, and the instruments that the tick table doesn't know."""
    return joined_by_key(rows, ticks, KEYS), rows.select(*KEYS).distinct().join(ticks, list(KEYS), "left_anti")


def book_events(quotes: DataFrame, range_ms: int = RANGE_MS) -> DataFrame:
    """Changes of the best quote with what they contribute to order flow; unchanged quotes are dropped.

    Order: ts_ms, then update_id. The first quote of a key has no event.
    """
    names = ("bid_ticks", "ask_ticks", "bid_qty", "ask_qty")
    both = with_previous(quotes.select(*KEYS, "update_id", "ts_ms", *names), KEYS, ("ts_ms", "update_id"), names, range_ms)
    changed = both.where("prev_bid_ticks is not null and (bid_ticks <> prev_bid_ticks or ask_ticks <> prev_ask_ticks or bid_qty <> prev_bid_qty or ask_qty <> prev_ask_qty)")
    c, p = F.col, lambda n: F.col(f"prev_{n}")
    e = (
        F.when(c("bid_ticks") >= p("bid_ticks"), c("bid_qty")).otherwise(0.0) - F.when(c("bid_ticks") <= p("bid_ticks"), p("bid_qty")).otherwise(0.0)
        - F.when(c("ask_ticks") <= p("ask_ticks"), c("ask_qty")).otherwise(0.0) + F.when(c("ask_ticks") >= p("ask_ticks"), p("ask_qty")).otherwise(0.0)
    )
    moved = (c("bid_ticks") != p("bid_ticks")) | (c("ask_ticks") != p("ask_ticks"))
    return changed.withColumn("contribution", e).withColumn("price_changed", moved)


def mid_ticks(prefix: str = "") -> Column:
    return (F.col(f"{prefix}bid_ticks") + F.col(f"{prefix}ask_ticks")) / 2


def ofi_intervals(events: DataFrame, interval_ms: int = 10_000) -> DataFrame:
    """Flow, mean depth and boundary mids of each half-open interval between a key's first and last event.

    Intervals without events are there too, as ``insufficient``. ``queue_ofi``
    sums only the events that moved no price.
    """
    at = F.struct("ts_ms", "update_id")
    start = bucket_start("ts_ms", interval_ms).alias("start_ms")
    sums = events.groupBy(*KEYS, start).agg(
        F.count("*").alias("event_count"), F.sum("contribution").alias("ofi"), sum_if(~F.col("price_changed"), "contribution").alias("queue_ofi"),
        F.avg((F.col("bid_qty") + F.col("ask_qty")) / 2).alias("average_depth"),
        F.min_by(mid_ticks("prev_"), at).alias("mid_start"), F.max_by(mid_ticks(), at).alias("mid_end"),
        F.min_by("update_id", at).alias("first_update_id"), F.max_by("update_id", at).alias("last_update_id"),
    )
    ends = sums.groupBy(*KEYS).agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    dense = ends.select(*KEYS, F.explode(F.sequence("lo", "hi", F.lit(interval_ms))).alias("start_ms"))
    return dense.join(sums, [*KEYS, "start_ms"], "left").select(
        *KEYS, "start_ms", (F.col("start_ms") + interval_ms).alias("end_ms"), F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("ofi", F.lit(0.0)).alias("ofi"), F.coalesce("queue_ofi", F.lit(0.0)).alias("queue_ofi"), "average_depth", "mid_start", "mid_end",
        "first_update_id", "last_update_id", F.when(F.col("event_count").isNull(), "insufficient").otherwise("exact_feed").alias("quality"),
    )


def price_impact_observations(intervals: DataFrame, flow: str = "ofi") -> DataFrame:
    """Flow and mid change in ticks of the intervals that can be observed."""
    usable = (F.col("quality") == "exact_feed") & F.col("mid_start").isNotNull() & F.col("mid_end").isNotNull()
    return intervals.where(usable).select(*KEYS, "start_ms", F.col(flow).alias("x"), (F.col("mid_end") - F.col("mid_start")).alias("y"), "average_depth")


def feature_vectors(events: DataFrame, intervals: DataFrame, interval_ms: int = 10_000) -> DataFrame:
    """Events with the features of their quote and of the interval before them; what is unknown is null.

    The interval that holds an event ends after it, so its flow isn't known yet.
    """
    bid, ask, bq, aq = (F.col(c) for c in ("bid_ticks", "ask_ticks", "bid_qty", "ask_qty"))
    mid, queue = (bid + ask) / 2, bq + aq
    micro = ratio(ask * bq + bid * aq, queue)
    known = intervals.where("quality = 'exact_feed'").select(*KEYS, (F.col("start_ms") + interval_ms).alias("bucket_ms"), F.col("ofi").alias("ofi_10s"), F.col("average_depth").alias("ad_10s"))
    return events.withColumn("bucket_ms", bucket_start("ts_ms", interval_ms)).join(known, [*KEYS, "bucket_ms"], "left").select(
        *KEYS, "ts_ms", "update_id", "ofi_10s", "ad_10s", (micro - mid).alias("dmu"), ((ask - bid) / mid * 10_000).alias("spread_bps"),
        ratio(bq - aq, queue).alias("obi_top"), ((micro / mid - 1) * 10_000).alias("skew_bps"),
    )


def forward_labels(vectors: DataFrame, events: DataFrame, horizons_ms: Sequence[int] = (1_000, 5_000, 30_000, 60_000)) -> DataFrame:
    """Mid change in ticks from the first mid at or after each vector to the first at or after its horizon.

    Probes and mids are put in one order and the next mid is read by a window,
    so no pair of rows is formed. No label where a probe lies past the last mid.
    """
    at = F.explode(F.array(F.lit(0), *[F.lit(h) for h in horizons_ms]))
    probes = vectors.select(*KEYS, "update_id", F.col("ts_ms").alias("base_ms"), at.alias("horizon_ms")).withColumn("t", F.col("base_ms") + F.col("horizon_ms"))
    mids = events.groupBy(*KEYS, F.col("ts_ms").alias("t")).agg(F.min_by(mid_ticks(), "update_id").alias("mid"))
    both = probes.select(*KEYS, "t", F.lit(0).alias("kind"), "update_id", "base_ms", "horizon_ms", F.lit(None).cast("double").alias("mid")).unionByName(
        mids.select(*KEYS, "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("update_id"), F.lit(None).cast("long").alias("base_ms"), F.lit(None).cast("int").alias("horizon_ms"), "mid")
    )
    found = with_next_known(both, KEYS, (F.col("t").desc(), F.col("kind").desc()), "t", "mid", "next_mid", RANGE_MS).where("kind = 0")
    base = F.max(F.when(F.col("horizon_ms") == 0, F.col("next_mid"))).over(Window.partitionBy(*KEYS, "update_id", "base_ms"))
    labelled_rows = found.withColumn("base_mid", base).where("horizon_ms > 0")
    return labelled_rows.select(
        *KEYS, F.col("base_ms").alias("ts_ms"), "update_id", "horizon_ms", (F.col("next_mid") - F.col("base_mid")).alias("y_ticks"),
        F.when(F.col("next_mid").isNull() | F.col("base_mid").isNull(), "end_of_window").alias("excluded"),
    )


def exclude_degraded(labels: DataFrame, spans: DataFrame, range_ms: int = RANGE_MS) -> DataFrame:
    """Labels whose stretch from vector to target overlaps a degraded span (``symbol, lo, hi, reason``) lose their value.

    Of spans in order, a label meets the first that ends after its vector, if that begins before its target. Only a span that
    ends later than all before it can be this one, so the next end is read by a window and no label is paired with spans.
    An open span (hi null) reaches to the symbol's last label.
    """
    last = labels.groupBy("symbol").agg(F.max(F.col("ts_ms") + F.col("horizon_ms")).alias("end"))
    closed = spans.join(last, "symbol").select("symbol", "lo", F.coalesce("hi", F.col("end") + 1).alias("hi"), "reason").where("hi > lo")
    ends = with_highest_before(closed, ("symbol",), ("lo", "hi", "reason"), "hi", "high", range_ms).where("high is null or hi > high")
    probes = labels.select("symbol", F.col("ts_ms").alias("t"), F.lit(0).alias("kind"), F.struct(*labels.columns).alias("label"))
    both = probes.unionByName(ends.select("symbol", F.col("hi").alias("t"), F.lit(1).alias("kind"), F.struct("lo", "reason").alias("span")), allowMissingColumns=True)
    # Backwards, and a span that ends as the vector stands comes after it.
    found = with_next_known(both, ("symbol",), (F.col("t").desc(), F.col("kind")), "t", "span", "next", range_ms).where("kind = 0").select("label.*", "next")
    reason = F.when(F.col("next.lo") < F.col("ts_ms") + F.col("horizon_ms"), F.col("next.reason"))
    return found.withColumn("reason", reason).select(
        *KEYS, "ts_ms", "update_id", "horizon_ms", F.when(F.col("reason").isNull(), F.col("y_ticks")).alias("y_ticks"), F.coalesce("reason", "excluded").alias("excluded")
    )


def absorption_candidates(events: DataFrame, window_ms: int = 30_000, refills: int = 2, max_adverse: float = 5.0) -> DataFrame:
    """Events from which, within the window, flow is negative, the bid is refilled and the mid falls by little."""
    ahead = Window.partitionBy(*KEYS, RANGE).orderBy("ts_ms").rangeBetween(0, window_ms)
    refill = (F.col("bid_ticks") == F.col("prev_bid_ticks")) & (F.col("bid_qty") > F.col("prev_bid_qty"))
    # The window is by time; events of the same instant before this one belong to it only if they come later in order.
    rows = with_reach(events, "ts_ms", window_ms, max(RANGE_MS, window_ms)).withColumn("mid", mid_ticks()).withColumn("base_mid", mid_ticks("prev_"))
    scored = rows.select(
        *KEYS, "_guest", "ts_ms", "update_id", "bid_ticks", "base_mid", F.sum("contribution").over(ahead).alias("flow"), F.sum(F.when(refill, 1).otherwise(0)).over(ahead).alias("refills"),
        F.count("*").over(ahead).alias("n"), F.max(F.struct("ts_ms", "update_id", "mid")).over(ahead)["mid"].alias("last_mid"),
    )
    response = F.col("last_mid") - F.col("base_mid")
    return scored.where(~F.col("_guest") & (F.col("n") >= 2) & (F.col("flow") < 0) & (F.col("refills") >= refills) & (-response <= max_adverse)).select(
        *KEYS, "ts_ms", "update_id", "bid_ticks", "flow", "refills", response.alias("response_ticks")
    )


def thinned(rows: DataFrame, spacing_ms: int, keys: Sequence[str] = KEYS, range_ms: int = RANGE_MS) -> DataFrame:
    """The first row of a key, and each next row at least ``spacing_ms`` after the last one kept.

    Which rows stay depends on all kept before: they are chains over ranges of ``range_ms`` (``functions/chains.py``).
    """
    return with_chains(rows, keys, ("ts_ms", "update_id"), spaced(spacing_ms), range_ms).where("picked").select(*rows.columns)


def detect_absorption(events: DataFrame, window_ms: int = 30_000, refills: int = 2, max_adverse: float = 5.0) -> DataFrame:
    """Absorption candidates, the first of every two windows."""
    return thinned(absorption_candidates(events, window_ms, refills, max_adverse), 2 * window_ms)


def detect_walls(events: DataFrame, min_qty: float = 40.0, max_bps: float = 50.0, persist_ms: int = 20_000) -> DataFrame:
    """The first large bid near the mid of each key that persists, with what happens at its price meanwhile."""
    mid = mid_ticks()
    dist = F.abs(F.col("bid_ticks") - mid) / mid * 10_000
    last = events.groupBy(*KEYS).agg(F.max("ts_ms").alias("last_ms"))
    # Watched for three persistence times, as far as there are events.
    near = joined_by_key(events.where((F.col("bid_qty") >= min_qty) & (dist <= max_bps)), last, KEYS).where(F.col("last_ms") - F.col("ts_ms") >= persist_ms)
    order = F.struct("ts_ms", "update_id", "bid_ticks", "bid_qty", dist.alias("distance_bps"), mid_ticks("prev_").alias("base_mid"))
    walls = near.groupBy(*KEYS).agg(F.min(order).alias("w")).select(
        *KEYS, F.col("w.ts_ms").alias("t0"), F.col("w.update_id").alias("id0"), F.col("w.bid_ticks").alias("wall_ticks"), F.col("w.bid_qty").alias("size"), F.col("w.distance_bps").alias("distance_bps"), F.col("w.base_mid").alias("base_mid")
    )
    # One wall a key.
    seen = joined_by_key(events, walls, KEYS).where((F.struct("ts_ms", "update_id") >= F.struct("t0", "id0")) & (F.col("ts_ms") - F.col("t0") <= persist_ms * 3))
    dq, at = F.col("bid_qty") - F.col("prev_bid_qty"), F.col("bid_ticks") == F.col("wall_ticks")
    life = seen.groupBy(*KEYS, "t0", "wall_ticks", "size", "distance_bps", "base_mid").agg(
        (F.max("ts_ms") - F.col("t0")).alias("persistence_ms"), sum_if(at & (dq > 0), dq).alias("adds"), sum_if(at & (dq < 0), -dq).alias("cancels"),
        sum_if(at, "contribution").alias("flow"), F.min(F.struct((-F.col("ts_ms")).alias("n"), "update_id", mid_ticks().alias("m")))["m"].alias("end_mid"),
    )
    return life.where(F.col("persistence_ms") >= persist_ms).withColumn("response_ticks", F.col("end_mid") - F.col("base_mid")).drop("base_mid", "end_mid")


def sequence_gaps(deltas: DataFrame, range_ids: int = 100_000) -> DataFrame:
    """Each frame with its gap flag and the session it belongs to: a gap opens a new one.

    Spot: the first id must not skip past the last final id. Futures: it must not lie before it.
    """
    before = F.col("previous_final_id")
    gap = F.when(F.col("venue") == "futures", F.col("first_update_id") < before).otherwise(F.col("first_update_id") > before + 1)
    known = with_previous(deltas, KEYS, ("final_update_id",), ("final_update_id",), range_ids).withColumnRenamed("prev_final_update_id", "previous_final_id")
    flagged = known.withColumn("is_gap", F.coalesce(gap, F.lit(False)))
    return with_running_sum(flagged, KEYS, ("final_update_id",), F.col("is_gap").cast("long"), "session", range_ids)


def bootstrap_bridge(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The first delta of each key that reaches past its snapshot's id (``symbol, venue, snapshot_update_id``) and starts at or before the next."""
    sid = F.col("snapshot_update_id")
    fits = deltas.join(snapshots, list(KEYS)).where((F.col("final_update_id") > sid) & (F.col("first_update_id") <= sid + 1))
    return fits.groupBy(*KEYS, "snapshot_update_id").agg(F.min("final_update_id").alias("bridge_final_id"), F.min_by("first_update_id", "final_update_id").alias("bridge_first_id"))


REPLAYED = "symbol string, venue string, session long, final_update_id long, ts_ms long, bid_ticks long, bid_qty double, ask_ticks long, ask_qty double"


def replay_book(deltas: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """Best quotes after every delta (one level each), by replay of absolute quantities; a gap clears the book.

    A session's time is cut into chunks that are replayed side by side. The
    book at a chunk's start is the last quantity of every price before it, which
    is an aggregation: per chunk first, then carried forward a price at a time.
    """
    session = [*KEYS, "session"]
    rows = sequence_gaps(deltas).withColumn("chunk", F.floor(F.col("ts_ms") / chunk_ms))
    level = [*session, "side", "price_ticks"]
    closing = rows.groupBy(*level, "chunk").agg(F.max_by("qty", "final_update_id").alias("qty"))
    until = F.lead("chunk").over(Window.partitionBy(*level).orderBy("chunk"))
    span = rows.groupBy(*session).agg(F.max("chunk").alias("last_chunk"))
    carried = closing.withColumn("until", until).join(span, session).where("qty > 0")
    opening = carried.withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.greatest(F.coalesce("until", "last_chunk"), F.col("chunk") + 1)))).where("chunk <= last_chunk")
    seeds = opening.select(*session, "chunk", F.lit(None).cast("long").alias("final_update_id"), F.lit(None).cast("long").alias("ts_ms"), "side", "price_ticks", "qty")
    everything = rows.select(*session, "chunk", "final_update_id", "ts_ms", "side", "price_ticks", "qty").unionByName(seeds)

    place = [*session, "chunk"]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Chunks come one after the other, in order; a batch may begin or end within one.
        # Quantities by price, and a heap of the prices of each side that may still have one, best first.
        at, book, heaps = None, {}, {}

        def best(side: str, sign: int) -> tuple[int | None, float | None]:
            heap, levels = heaps[side], book[side]
            while heap and sign * heap[0] not in levels:
                heapq.heappop(heap)
            return (sign * heap[0], levels[sign * heap[0]]) if heap else (None, None)

        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in (*place, "final_update_id", "ts_ms", "side", "price_ticks", "qty")]
            for symbol, venue, number, chunk, fid, ts, side, price, qty in zip(*columns, strict=True):
                if at != (symbol, venue, number, chunk):
                    at, book, heaps = (symbol, venue, number, chunk), {"bid": {}, "ask": {}}, {"bid": [], "ask": []}
                levels = book[side]
                if qty > 0:
                    if price not in levels:
                        heapq.heappush(heaps[side], -price if side == "bid" else price)
                    levels[price] = qty
                else:
                    levels.pop(price, None)
                if fid == fid and fid is not None:
                    out.append((symbol, venue, number, int(fid), int(ts), *best("bid", -1), *best("ask", 1)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])
            yield frame.astype({"bid_ticks": "Int64", "ask_ticks": "Int64", "bid_qty": "float64", "ask_qty": "float64"})

    # Sessions are many and short, so a partition's chunks go through one call; a task holds a batch of rows and one book.
    ordered = everything.repartition(*place).sortWithinPartitions(*place, F.col("final_update_id").asc_nulls_first(), "price_ticks")
    return ordered.mapInPandas(replay, REPLAYED)
