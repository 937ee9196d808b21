"""Structured Streaming twins of the stateful operators.

Windowed sums and latest views are plain streaming aggregations. Horizon folds,
book replay and alerts keep state of their own per key and need the RocksDB
state store: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.functions.columns import bucket_start, is_buy, sum_if
from tapewright.functions.ranges import joined_by_key, with_highest_before
from tapewright.streaming.replay import drain  # noqa: F401  the runs' reader, used with the twins

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_event_time(rows: DataFrame, ts_ms: str = "ts_ms", late: str = "10 minutes") -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_millis(F.col(ts_ms))).withWatermark("event_time", late)


def bucketed_flow(trades: DataFrame, window_s: int = 60) -> DataFrame:
    """Buy, sell and delta of tumbling windows. In append mode each window comes once, when the watermark has passed its end, and leaves the state; later rows of it are dropped."""
    w = F.window("event_time", f"{window_s} seconds")
    sums = with_event_time(trades).groupBy("symbol", "venue", w).agg(sum_if(is_buy(), "qty").alias("buy"), sum_if(~is_buy(), "qty").alias("sell"), F.count("*").alias("trades"))
    return sums.select("symbol", "venue", F.unix_millis("window.start").alias("start_ms"), "buy", "sell", (F.col("buy") - F.col("sell")).alias("delta"), "trades")


def ofi(events: DataFrame, interval_ms: int = 10_000) -> DataFrame:
    """Flow of half-open intervals over best-quote events; the key holds the gap session, so an interval cut by a gap is two."""
    keys = [c for c in ("symbol", "venue", "session") if c in events.columns]
    start = bucket_start("ts_ms", interval_ms)
    return events.groupBy(*keys, start.alias("start_ms")).agg(F.count("*").alias("event_count"), F.sum("contribution").alias("ofi"))


def latest_projection(events: DataFrame, keys: Sequence[str], order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """The newest state of each subject and how many events there were; late arrivals don't rewind it."""
    newest = F.max(F.struct(*order, *state)).alias("r")
    return events.groupBy(*keys).agg(F.count("*").alias("event_count"), newest).select(*keys, "event_count", *[F.col(f"r.{c}").alias(c) for c in (*order, *state)])


def deduplicated(rows: DataFrame, key: Sequence[str], ts_ms: str = "ts_ms", within: str = "600 seconds") -> DataFrame:
    """One row a key within the watermark: idempotent appends and snapshot dedupe of streams."""
    return with_event_time(rows, ts_ms, within).dropDuplicatesWithinWatermark(list(key)).drop("event_time")


FOLD = "symbol string, horizon_ms long, segment_ms long, venue string, trades long, buy_notional double, sell_notional double, duplicates long, late long"


class HorizonFold(StatefulProcessor):
    """Trailing segments of a symbol: ids at or under the venue's greatest are duplicates, rows before the newest segment are late.

    Both are counted and left out. A trigger's rows are taken in order of arrival; a task holds one trigger's ``contenders`` of a
    symbol, so the source bounds its triggers (``replay.arriving``), and the state holds a row a segment. The first state
    comes as ``folded`` rows, in any order and number of pieces.
    """

    def __init__(self, horizon_ms: int, segment_ms: int):
        self.horizon_ms, self.segment_ms = horizon_ms, segment_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getMapState("high", "venue string", "id long")
        self.segments = handle.getMapState("segments", "segment long, venue string", "trades long, buy double, sell double")
        self.counts = handle.getValueState("counts", "newest long, duplicates long, late long")

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:  # noqa: N802
        newest, duplicates, late = self.counts.get() if self.counts.exists() else (-1, 0, 0)
        high = {k[0]: v[0] for k, v in self.high.iterator()}
        for r in initial.itertuples(index=False):
            if r.venue is None:
                newest, duplicates, late = max(newest, int(r.newest)), duplicates + int(r.duplicates), late + int(r.late)
            elif pd.isna(r.segment):
                high[r.venue] = max(high.get(r.venue, -1), int(r.high))
            else:
                self.segments.updateValue((int(r.segment), r.venue), (int(r.trades), float(r.buy), float(r.sell)))
        self.counts.update((int(newest), duplicates, late))
        for venue, tid in high.items():
            self.high.updateValue((venue,), (int(tid),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self.fold(key, pd.concat(list(rows)))

    def fold(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        newest, duplicates, late = self.counts.get() if self.counts.exists() else (-1, 0, 0)
        high = {k[0]: v[0] for k, v in self.high.iterator()}
        batch = batch.sort_values(["arrival", "trade_id", "ts_ms"], kind="stable")
        venues, ids = batch["venue"].to_numpy(), batch["trade_id"].to_numpy(np.int64)
        fresh = np.zeros(len(batch), bool)
        for venue in pd.unique(venues):
            at = np.flatnonzero(venues == venue)
            so_far = np.maximum.accumulate(np.r_[high.get(venue, -1), ids[at]])
            fresh[at], high[venue] = ids[at] > so_far[:-1], so_far[-1]
        duplicates += int((~fresh).sum()) + int(batch["shed"].sum())
        batch = batch[fresh]
        segments = batch["ts_ms"].to_numpy(np.int64) // self.segment_ms * self.segment_ms
        front = np.maximum.accumulate(np.r_[newest, segments])
        kept = segments >= front[:-1]
        late += int((~kept).sum())
        batch, segments, newest = batch[kept], segments[kept], front[-1]
        held = {tuple(k): list(v) for k, v in self.segments.iterator()}
        notional, maker = (batch["price"] * batch["qty"]).astype(float), batch["is_buyer_maker"].astype(bool)
        sums = pd.DataFrame({"segment": segments, "venue": batch["venue"].to_numpy(), "n": 1, "buy": notional.where(~maker, 0.0).to_numpy(), "sell": notional.where(maker, 0.0).to_numpy()})
        for segment, venue, n, buy, sell in sums.groupby(["segment", "venue"], as_index=False).sum().itertuples(index=False):
            cell = held.setdefault((segment, venue), [0, 0.0, 0.0])
            held[segment, venue] = [cell[0] + n, cell[1] + buy, cell[2] + sell]
        if len(batch):
            held = {k: v for k, v in held.items() if k[0] >= int(batch["ts_ms"].iloc[-1]) - self.horizon_ms}
        self.counts.update((int(newest), duplicates, late))
        for venue, tid in high.items():
            self.high.updateValue((venue,), (int(tid),))
        self.segments.clear()
        for (segment, venue), (n, buy, sell) in held.items():
            self.segments.updateValue((int(segment), venue), (int(n), float(buy), float(sell)))
        out = [(key[0], self.horizon_ms, seg, venue, n, b, s, duplicates, late) for (seg, venue), (n, b, s) in sorted(held.items())]
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLD.split(", ")])

    def close(self) -> None:
        pass


SPAN = ("symbol", "venue", "trade_id", "ts_ms", "price", "qty", "is_buyer_maker", "arrival")


def contenders(trades: DataFrame) -> DataFrame:
    """The trades without those that an earlier one of the same batch of rows shows to be duplicates; ``shed`` counts these beside a trade of their symbol."""
    own = [*SPAN, "shed"]

    def shed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["arrival", "trade_id", "ts_ms"], kind="stable")
            high = b.groupby(["symbol", "venue"], sort=False)["trade_id"].cummax()
            before = high.groupby([b["symbol"], b["venue"]], sort=False).shift()
            fresh = (before.isna() | (b["trade_id"] > before)).to_numpy()
            kept = b[fresh]
            left_out = b["symbol"].value_counts() - kept["symbol"].value_counts()
            first = ~kept["symbol"].duplicated()
            yield kept.assign(shed=kept["symbol"].map(left_out).where(first, 0).astype("int64"))[own]

    names = {f.name: f for f in trades.schema.fields}
    return trades.select(*SPAN).mapInPandas(shed, T.StructType([*[names[c] for c in SPAN], T.StructField("shed", T.LongType())]))


def horizon_fold(trades: DataFrame, horizon_ms: int, segment_ms: int, warm_start: DataFrame | None = None) -> DataFrame:
    """The ring of each symbol after every batch; ``arrival`` orders the trades. ``warm_start`` rows (a table) make the
    first state; the fold's own dedupe absorbs what the stream repeats of them."""
    first = None if warm_start is None else folded(warm_start, horizon_ms, segment_ms).groupBy("symbol")
    return contenders(trades).groupBy("symbol").transformWithStateInPandas(HorizonFold(horizon_ms, segment_ms), FOLD, "Update", "None", first)


ARRIVED = ("arrival", "trade_id", "ts_ms")


def fresh_trades(trades: DataFrame, segment_ms: int) -> DataFrame:
    """Trades with an id over all earlier ones of the venue; ``front``: the newest segment before each."""
    fresh = with_highest_before(trades, ("symbol", "venue"), ARRIVED, "trade_id", "high", segment_ms).where("high is null or trade_id > high")
    return with_highest_before(fresh.withColumn("segment_ms", bucket_start("ts_ms", segment_ms)), ("symbol",), ARRIVED, "segment_ms", "front", segment_ms)


def horizon_fold_batch(trades: DataFrame, horizon_ms: int, segment_ms: int) -> DataFrame:
    """The fold of a whole table at once: ids over all earlier ones of the venue, no earlier segment than the newest so far, trailing the last."""
    kept = fresh_trades(trades, segment_ms).where("front is null or segment_ms >= front")
    last = kept.groupBy("symbol").agg(F.max_by("ts_ms", F.struct(*ARRIVED)).alias("last_ts"))
    n = F.col("price") * F.col("qty")
    return joined_by_key(kept, last, ["symbol"]).where(F.col("segment_ms") >= F.col("last_ts") - horizon_ms).groupBy("symbol", "segment_ms", "venue").agg(
        F.count("*").alias("trades"), sum_if(is_buy(), n).alias("buy_notional"), sum_if(~is_buy(), n).alias("sell_notional")
    )


def folded(trades: DataFrame, horizon_ms: int, segment_ms: int) -> DataFrame:
    """What the fold holds after a table, as rows: one a segment and venue, one a venue with its greatest id, one a symbol with its counts."""
    ring = horizon_fold_batch(trades, horizon_ms, segment_ms)
    high = trades.groupBy("symbol", "venue").agg(F.max("trade_id").alias("high"))
    fresh = fresh_trades(trades, segment_ms).groupBy("symbol").agg(F.max("segment_ms").alias("newest"), F.count("*").alias("fresh"), F.count_if(F.col("segment_ms") < F.col("front")).alias("late"))
    counts = trades.groupBy("symbol").agg(F.count("*").alias("n")).join(fresh, "symbol").select("symbol", "newest", (F.col("n") - F.col("fresh")).alias("duplicates"), "late")
    ring = ring.withColumnsRenamed({"segment_ms": "segment", "buy_notional": "buy", "sell_notional": "sell"})
    rows = ring.unionByName(high, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)
    return rows.select("symbol", "venue", "segment", "trades", "buy", "sell", "high", "newest", "duplicates", "late")


BOOK = "symbol string, venue string, final_update_id long, ts_ms long, session long, bid_ticks long, bid_qty double, ask_ticks long, ask_qty double"


def packed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of a key in an Arrow batch as one row with ``columns`` as arrays, formed where the rows lie.

    Spark makes a Python object of each row that it hands to a stateful operator, so few rows of arrays cost less. They carry no
    event time: for operators without timers and watermarks.
    """
    own, names = list(keys), [f"{c}_list" for c in columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.Table.from_batches([b]).group_by(own, use_threads=False).aggregate([(c, "list") for c in columns])
            yield from lists.select([*own, *names]).rename_columns([*own, *columns]).to_batches()

    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*[fields[k] for k in own], *[T.StructField(c, T.ArrayType(fields[c].dataType)) for c in columns]])
    return rows.select(*own, *columns).mapInArrow(pack, schema)


def unpacked(rows: Iterator[pd.DataFrame], columns: Sequence[str]) -> pd.DataFrame:
    """A key's rows from its ``packed`` ones."""
    parts = list(rows)
    return pd.DataFrame({c: np.concatenate([cell for part in parts for cell in part[c]]) for c in columns})


DELTA = ("first_update_id", "final_update_id", "ts_ms", "side", "price_ticks", "qty")


class BookReplay(StatefulProcessor):
    """A local book of a symbol and venue from ``packed`` depth deltas; stale frames are dropped, a gap clears it and opens a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price long", "qty double")
        self.place = handle.getValueState("place", "last_id long, session long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, session = self.place.get() if self.place.exists() else (None, 0)
        batch = unpacked(rows, DELTA).sort_values(["final_update_id", "side", "price_ticks"], kind="stable")
        final = batch["final_update_id"].to_numpy(np.int64)
        fresh = np.r_[True, final[1:] > final[:-1]] & (True if last is None else final > last)
        batch, final = batch[fresh], final[fresh]
        first = batch["first_update_id"].to_numpy(np.int64)
        before = np.r_[final[:1] if last is None else last, final[:-1]][: len(final)]
        gap = first < before if key[1] == "futures" else first > before + 1
        if last is None:
            gap[:1] = False
        sessions = session + np.cumsum(gap)
        was: dict[str, dict[int, float]] = {"bid": {}, "ask": {}}
        for (side, price), (qty,) in self.levels.iterator():
            was[side][price] = qty
        book, best = self._walk(was, gap, batch)
        if len(final):
            self.place.update((int(final[-1]), int(sessions[-1])))
        # Only what has changed is written.
        for side, prices in book.items():
            for price, qty in prices.items():
                if was[side].get(price) != qty:
                    self.levels.updateValue((side, price), (qty,))
            for price in was[side].keys() - prices.keys():
                self.levels.removeKey((side, price))
        quotes = {"bid_ticks": pd.array(best[0], "Int64"), "bid_qty": np.array(best[1], float), "ask_ticks": pd.array(best[2], "Int64"), "ask_qty": np.array(best[3], float)}
        yield pd.DataFrame({"symbol": key[0], "venue": key[1], "final_update_id": final, "ts_ms": batch["ts_ms"].to_numpy(np.int64), "session": sessions, **quotes})

    @staticmethod
    def _walk(was: dict[str, dict[int, float]], gap: np.ndarray, batch: pd.DataFrame) -> tuple[dict[str, dict[int, float]], tuple[list, ...]]:
        """The book after all deltas, and the best prices and quantities of both sides after each."""
        book = {side: dict(prices) for side, prices in was.items()}
        # Prices of each side, best first and negative for bids, that may still have a quantity.
        heaps = {"bid": sorted(-p for p in book["bid"]), "ask": sorted(book["ask"])}
        best: tuple[list, ...] = ([], [], [], [])
        top = {"bid": max(book["bid"], default=None), "ask": min(book["ask"], default=None)}
        columns = (gap, batch["side"], batch["price_ticks"].to_numpy(np.int64), batch["qty"].to_numpy(float))
        for cleared, side, price, qty in zip(*[c.tolist() for c in columns]):
            if cleared:
                book, heaps, top = {"bid": {}, "ask": {}}, {"bid": [], "ask": []}, {"bid": None, "ask": None}
            levels, heap, sign = book[side], heaps[side], -1 if side == "bid" else 1
            if qty > 0:
                if price not in levels:
                    heapq.heappush(heap, sign * price)
                    if top[side] is None or sign * price < sign * top[side]:
                        top[side] = price
                levels[price] = qty
            elif levels.pop(price, None) is not None and price == top[side]:
                while heap and sign * heap[0] not in levels:
                    heapq.heappop(heap)
                top[side] = sign * heap[0] if heap else None
            bid, ask = top["bid"], top["ask"]
            best[0].append(bid)
            best[1].append(book["bid"].get(bid))
            best[2].append(ask)
            best[3].append(book["ask"].get(ask))
        return book, best

    def close(self) -> None:
        pass


def book_reconstruct(deltas: DataFrame) -> DataFrame:
    """Best quotes after every accepted delta of one level each; a trigger's deltas follow those of the triggers before it."""
    return packed(deltas, ("symbol", "venue"), DELTA).groupBy("symbol", "venue").transformWithStateInPandas(BookReplay(), BOOK, "Append", "None")


INTERVAL = (
    "symbol string, venue string, session long, start_ms long, end_ms long, event_count long, ofi double, average_depth double, "
    "mid_start double, mid_end double, first_update_id long, last_update_id long"
)
QUOTE = ("bid_ticks", "bid_qty", "ask_ticks", "ask_qty")
EVENT = ("session", "final_update_id", "ts_ms", *QUOTE)


class OfiIntervals(StatefulProcessor):
    """Order-flow imbalance of half-open intervals over the ``packed`` best quotes of a replayed book.

    An interval is complete when an event of a later one comes. A gap opens a new session: the interval it cut is
    dropped and no event joins quotes of two sessions. The state is one quote and one open interval.
    """

    def __init__(self, interval_ms: int):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quote = handle.getValueState("quote", "session long, final_update_id long, ts_ms long, bid_ticks double, bid_qty double, ask_ticks double, ask_qty double")
        self.open = handle.getValueState("open", "session long, start_ms long, event_count long, ofi double, depth double, mid_start double, mid_end double, first_update_id long, last_update_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = list(EVENT)
        batch = unpacked(rows, EVENT).sort_values(["session", "final_update_id"], kind="stable")
        # A frame's last row holds all its levels.
        batch = batch.drop_duplicates(["session", "final_update_id"], keep="last").astype({c: "float64" for c in QUOTE})
        carried = pd.DataFrame([tuple(self.quote.get())], columns=names) if self.quote.exists() else batch.iloc[:0]
        quotes = pd.concat([carried, batch], ignore_index=True) if len(carried) else batch.reset_index(drop=True)
        last = quotes.iloc[-1]
        self.quote.update((int(last["session"]), int(last["final_update_id"]), int(last["ts_ms"]), *[float(last[c]) for c in QUOTE]))
        yield self._closed(key, self._events(quotes))

    def _events(self, quotes: pd.DataFrame) -> pd.DataFrame:
        """Changes between quotes that have both sides, and what they contribute."""
        was = quotes.shift(1)
        same = quotes["session"] == was["session"]
        full = quotes[list(QUOTE)].notna().all(axis=1) & was[list(QUOTE)].notna().all(axis=1)
        events = quotes[same & full & (quotes[list(QUOTE)] != was[list(QUOTE)]).any(axis=1)]
        was = was.loc[events.index]
        bid = events["bid_qty"].where(events["bid_ticks"] >= was["bid_ticks"], 0.0) - was["bid_qty"].where(events["bid_ticks"] <= was["bid_ticks"], 0.0)
        ask = was["ask_qty"].where(events["ask_ticks"] >= was["ask_ticks"], 0.0) - events["ask_qty"].where(events["ask_ticks"] <= was["ask_ticks"], 0.0)
        mid, mid_was = (events["bid_ticks"] + events["ask_ticks"]) / 2, (was["bid_ticks"] + was["ask_ticks"]) / 2
        return events.assign(ofi=bid + ask, depth=(events["bid_qty"] + events["ask_qty"]) / 2, mid=mid, mid_was=mid_was)

    def _closed(self, key, events: pd.DataFrame) -> pd.DataFrame:
        columns = ["session", "start_ms", "event_count", "ofi", "depth", "mid_start", "mid_end", "first_update_id", "last_update_id"]
        start = events["ts_ms"] // self.interval_ms * self.interval_ms
        held = pd.DataFrame([tuple(self.open.get())], columns=columns) if self.open.exists() else None
        # An event that is older than the open interval counts there.
        events = events.assign(start_ms=start)
        if held is not None:
            own = events["session"] == held.at[0, "session"]
            events.loc[own, "start_ms"] = events.loc[own, "start_ms"].clip(lower=held.at[0, "start_ms"])
        events["start_ms"] = events.groupby("session")["start_ms"].cummax()
        found = events.groupby(["session", "start_ms"], as_index=False).agg(
            event_count=("ofi", "size"), ofi=("ofi", "sum"), depth=("depth", "sum"), mid_start=("mid_was", "first"), mid_end=("mid", "last"), first_update_id=("final_update_id", "first"), last_update_id=("final_update_id", "last")
        )
        if held is not None:
            both = pd.concat([held, found], ignore_index=True)
            found = both.groupby(["session", "start_ms"], as_index=False).agg(
                event_count=("event_count", "sum"), ofi=("ofi", "sum"), depth=("depth", "sum"), mid_start=("mid_start", "first"), mid_end=("mid_end", "last"), first_update_id=("first_update_id", "first"), last_update_id=("last_update_id", "last")
            )
        # The last interval of a session is open, or cut by the gap that ended the session.
        cut = found["start_ms"] == found.groupby("session")["start_ms"].transform("max")
        current = int(self.quote.get()[0])
        rest = found[cut & (found["session"] == current)]
        if len(rest):
            r = rest.iloc[0]
            self.open.update((int(r["session"]), int(r["start_ms"]), int(r["event_count"]), *[float(r[c]) for c in ("ofi", "depth", "mid_start", "mid_end")], int(r["first_update_id"]), int(r["last_update_id"])))
        elif self.open.exists():
            self.open.clear()
        done = found[~cut]
        out = done.assign(symbol=key[0], venue=key[1], end_ms=done["start_ms"] + self.interval_ms, average_depth=done["depth"] / done["event_count"])
        return out[[c.split()[0] for c in INTERVAL.split(", ")]]

    def close(self) -> None:
        pass


def ofi_from_depth(deltas: DataFrame, interval_ms: int = 10_000) -> DataFrame:
    """Depth deltas in, complete order-flow intervals out, in one streaming plan: the replayed book feeds the intervals."""
    return packed(book_reconstruct(deltas), ("symbol", "venue"), EVENT).groupBy("symbol", "venue").transformWithStateInPandas(OfiIntervals(interval_ms), INTERVAL, "Append", "None")


ALERT = "symbol string, venue string, ts_ms long, trigger string, state string, previous_state string"


class Alerts(StatefulProcessor):
    """Alerts of a key: first data, silence, recovery after it, a new period, a state flip (rate-limited by a cooldown).

    Silence is told by an event-time timer that runs out ``stale_ms`` after the last row, or by the next row where that
    comes first; either way once, at the time it became due. The state is one row a key.
    """

    def __init__(self, period_ms: int, stale_ms: int, cooldown_ms: int):
        self.period_ms, self.stale_ms, self.cooldown_ms = period_ms, stale_ms, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts long, state string, flip_ts long, silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        ts0, state0, flip, silent = self.seen.get() if self.seen.exists() else (None, None, None, False)
        if ts0 is not None and not silent:
            self.handle.deleteTimer(self._due(ts0))
        out = []
        for ts, state in pd.concat(list(rows)).sort_values(["ts_ms", "state"])[["ts_ms", "state"]].itertuples(index=False):
            ts = int(ts)
            if ts0 is None:
                out.append((*key, ts, "first_data", state, None))
            else:
                if ts <= ts0:
                    continue  # the same or an older high water fires nothing
                if ts - ts0 > self.stale_ms:
                    if not silent:
                        out.append((*key, ts0 + self.stale_ms, "staleness", state0, state0))
                    out.append((*key, ts, "recovery", state, state0))
                if ts // self.period_ms != ts0 // self.period_ms:
                    out.append((*key, ts, "rollover", state, state0))
                if state != state0 and (flip is None or ts - flip >= self.cooldown_ms):
                    out.append((*key, ts, "state_flip", state, state0))
                    flip = ts
            ts0, state0, silent = ts, state, False
        self.seen.update((ts0, state0, flip, silent))
        if not silent:
            self.handle.registerTimer(self._due(ts0))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts0, state0, flip, silent = self.seen.get()
        due = not silent and expiredTimerInfo.getExpiryTimeInMs() == self._due(ts0)
        if due:
            self.seen.update((ts0, state0, flip, True))
        yield self._frame([(*key, ts0 + self.stale_ms, "staleness", state0, state0)] if due else [])

    def _due(self, ts: int) -> int:
        """A row at ``ts + stale_ms`` is in time."""
        return int(ts) + self.stale_ms + 1

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ALERT.split(", ")])

    def close(self) -> None:
        pass


def alert_stream(states: DataFrame, period_ms: int = 900_000, stale_ms: int = 120_000, cooldown_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """Alert rows of ``symbol, venue, ts_ms, state``; a repeated high water doesn't fire again. Keys fall silent by the
    watermark, ``late`` behind the newest row of all keys."""
    rows = with_event_time(states, "ts_ms", late)
    return rows.groupBy("symbol", "venue").transformWithStateInPandas(Alerts(period_ms, stale_ms, cooldown_ms), ALERT, "Append", "EventTime")


def alert_dedupe(alerts: DataFrame, within: str = "10 minutes") -> DataFrame:
    """One alert a key, high water and trigger within the watermark."""
    return deduplicated(alerts, ["symbol", "venue", "ts_ms", "trigger"], "ts_ms", within)
