"""Trade-tape operators: flow, CVD, turnover, trailing windows, large prints.

Trades are rows of ``symbol, venue, trade_id, ts_ms, price, qty,
is_buyer_maker``. Every operator works per ``keys`` (symbol and venue unless
said otherwise) over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import bucket_start, count_if, is_buy, labelled, nearest_bucket, ratio, sum_if
from tapewright.functions.ranges import exact_median, joined_by_key, with_running_sum

#: Width of the time ranges into which a key's rows are dealt.
RANGE_MS = 3_600_000
KEYS = ("symbol", "venue")
MINUTE = 60_000


def with_trade_side(trades: DataFrame) -> DataFrame:
    """Add ``side`` (the taker's) and ``notional``."""
    return trades.withColumn("side", F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")).withColumn("notional", F.col("price") * F.col("qty"))


def dedupe_trades(trades: DataFrame, order: Sequence[str] = ("ts_ms", "price", "qty", "is_buyer_maker")) -> DataFrame:
    """First row of each (symbol, venue, trade_id) by ``order``; rows without an id all stay."""
    first = Window.partitionBy("symbol", "venue", "trade_id").orderBy(*order)
    known = trades.where("trade_id is not null").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return known.unionByName(trades.where("trade_id is null"))


def duplicate_counts(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, distinct ids and duplicates a key; rows without an id count as distinct."""
    return trades.groupBy(*keys).agg(
        F.count("*").alias("raw_count"),
        (F.count_distinct("trade_id") + F.count_if(F.col("trade_id").isNull())).alias("unique_count"),
        (F.count("trade_id") - F.count_distinct("trade_id")).alias("duplicate_count"),
    )


def _buy_sell(prefix: str = "") -> list[Column]:
    notional = F.col("price") * F.col("qty")
    return [
        sum_if(is_buy(), "qty").alias(f"{prefix}buy_vol"),
        sum_if(~is_buy(), "qty").alias(f"{prefix}sell_vol"),
        sum_if(is_buy(), notional).alias(f"{prefix}buy_notional_usd"),
        sum_if(~is_buy(), notional).alias(f"{prefix}sell_notional_usd"),
    ]


def flow_summary(trades: DataFrame, keys: Sequence[str] = KEYS, large_factor: float = 5.0, approx: bool = False) -> DataFrame:
    """Volumes, CVD, buy share, VWAP with deviation, last price, and large trades: those of at least ``large_factor`` medians.

    The exact median counts a key's quantities by ranges of value; ``approx``
    takes a sketch instead. The last price is that of the newest row, ties going to
    the greater trade_id. A key's first ten large trades come oldest first.
    """
    median = F.percentile_approx("qty", 0.5, 10_000) if approx else F.lit(None).cast("double")
    newest = F.struct("ts_ms", "trade_id", "price")
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), *_buy_sell(),
        F.sum(F.col("price") * F.col("qty")).alias("pv"), F.sum(F.col("price") * F.col("price") * F.col("qty")).alias("pv2"),
        median.alias("median_qty"), F.max(newest)["price"].alias("last_price"), F.max("ts_ms").alias("last_ts"),
    )
    if not approx:
        base = base.drop("median_qty").join(exact_median(trades, keys, "qty", "median_qty"), list(keys), "left")
    total = F.col("buy_vol") + F.col("sell_vol")
    vwap = ratio("pv", total)
    threshold = base.select(*keys, (F.col("median_qty") * large_factor).alias("threshold")).where("threshold > 0")
    large = (
        joined_by_key(trades, threshold, keys)
        .where("qty >= threshold")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("large_trade_count"),
            F.sum(F.col("price") * F.col("qty")).alias("large_notional_usd"),
        )
    )
    return base.join(large, list(keys), "left").select(
        *keys, "trade_count", "buy_vol", "sell_vol", "buy_notional_usd", "sell_notional_usd",
        (F.col("buy_vol") - F.col("sell_vol")).alias("cvd"), (F.col("buy_notional_usd") - F.col("sell_notional_usd")).alias("cvd_usd"),
        F.coalesce(ratio("buy_vol", total), F.lit(0.5)).alias("buy_share"), ratio("buy_vol", "sell_vol").alias("buy_sell_ratio"),
        F.coalesce(vwap, F.lit(0.0)).alias("vwap"),
        F.sqrt(F.greatest(F.lit(0.0), ratio("pv2", total) - vwap * vwap)).alias("vwap_stddev"),
        "median_qty", "last_price", "last_ts", F.coalesce("large_trade_count", F.lit(0)).alias("large_trade_count"),
        F.coalesce("large_notional_usd", F.lit(0.0)).alias("large_notional_usd"),
    )


def large_trades(trades: DataFrame, keys: Sequence[str] = KEYS, large_factor: float = 5.0, keep: int = 10) -> DataFrame:
    """The first ``keep`` trades of a key, oldest first, of at least ``large_factor`` medians."""
    threshold = exact_median(trades, keys, "qty").select(*keys, (F.col("median") * large_factor).alias("threshold")).where("threshold > 0")
    order = Window.partitionBy(*keys).orderBy("ts_ms", "trade_id", "price", "qty")
    return (
        with_trade_side(joined_by_key(trades, threshold, keys).where("qty >= threshold"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= keep)
        .select(*keys, "rank", "trade_id", "ts_ms", "price", "qty", "notional", "side")
    )


def bucketed_cvd(trades: DataFrame, window_s: int = 60, keys: Sequence[str] = KEYS) -> DataFrame:
    """Volumes and delta a time bucket; ``t`` is its start in seconds."""
    t = (F.floor(F.col("ts_ms") / (window_s * 1000)) * window_s).cast("long")
    return trades.groupBy(*keys, t.alias("t")).agg(*_buy_sell(), F.count("*").alias("trades")).select(
        *keys, "t", (F.col("buy_vol") - F.col("sell_vol")).alias("delta"),
        (F.col("buy_notional_usd") - F.col("sell_notional_usd")).alias("delta_usd"),
        F.col("buy_vol").alias("buy"), F.col("sell_vol").alias("sell"),
        F.col("buy_notional_usd").alias("buy_usd"), F.col("sell_notional_usd").alias("sell_usd"), "trades",
    )


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r; null below two pairs or where either side doesn't vary."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((F.count("*") > 1) & (spread > 0), F.covar_pop(x, y) / spread)


def cvd_series_corr(buckets: DataFrame) -> DataFrame:
    """Per symbol: how spot and futures deltas of the same buckets move together."""
    spot = buckets.where("venue = 'spot'").select("symbol", "t", F.col("delta").alias("spot_delta"))
    futures = buckets.where("venue = 'futures'").select("symbol", "t", F.col("delta").alias("futures_delta"))
    return spot.join(futures, ["symbol", "t"]).groupBy("symbol").agg(
        F.count("*").alias("aligned_buckets"), guarded_corr("spot_delta", "futures_delta").alias("spot_vs_futures_corr")
    )


def common_buckets(buckets: DataFrame) -> DataFrame:
    """The (symbol, t) pairs that both venues have."""
    return buckets.where("venue = 'spot'").select("symbol", "t").intersect(buckets.where("venue = 'futures'").select("symbol", "t"))


def turnover_share(trades: DataFrame) -> DataFrame:
    """Spot's share of the notional of both venues; null where a venue is missing or nothing traded."""
    notional = F.col("price") * F.col("qty")
    legs = trades.groupBy("symbol").agg(
        F.sum(F.when(F.col("venue") == "spot", notional)).alias("spot_notional"),
        F.sum(F.when(F.col("venue") == "futures", notional)).alias("futures_notional"),
    )
    both = F.col("spot_notional") + F.col("futures_notional")
    return legs.withColumn("spot_share", F.when(both > 0, F.col("spot_notional") / both))


def with_now(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``now_ms``: the newest trade of the key."""
    newest = trades.groupBy(*keys).agg(F.max("ts_ms").alias("now_ms"))
    return joined_by_key(trades, newest, keys)


def price_bucketed_flow(trades: DataFrame, bucket_size: float = 0.05, window_s: int = 300, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flow by nearest price bucket in the trailing window up to the newest trade."""
    recent = with_now(trades, keys).where(F.col("ts_ms") >= F.col("now_ms") - window_s * 1000)
    by = recent.groupBy(*keys, nearest_bucket("price", bucket_size).alias("bucket_id"))
    return by.agg(sum_if(is_buy(), "qty").alias("buy"), sum_if(~is_buy(), "qty").alias("sell"), F.count("*").alias("trades")).select(
        *keys, "bucket_id", F.round(F.col("bucket_id") * bucket_size, 10).alias("price"), "buy", "sell",
        (F.col("buy") - F.col("sell")).alias("net"), "trades",
    )


def initiated_flow(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Aggressor split by quantity and notional; the buy share is of notional."""
    split = trades.groupBy(*keys).agg(*_buy_sell(), count_if(is_buy()).alias("buy_count"), count_if(~is_buy()).alias("sell_count"))
    return split.withColumn("buy_share", ratio("buy_notional_usd", F.col("buy_notional_usd") + F.col("sell_notional_usd")))


def window_coverage(trades: DataFrame, asked_ms: int = 240 * MINUTE, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, span and whether the retained tape is shorter than the window asked for."""
    span = F.max("ts_ms") - F.min("ts_ms")
    return (
        trades.groupBy(*keys)
        .agg(
            F.count("*").alias("raw_trades"), F.count_distinct("trade_id").alias("unique_trades"),
            F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), span.alias("span_ms"),
        )
        .withColumn("duplicate_trades", F.col("raw_trades") - F.col("unique_trades"))
        .withColumn("retention_degraded", F.col("span_ms") < asked_ms)
    )


def net_buy_share(trades: DataFrame, windows_min: Sequence[int] = (5, 15, 240), keys: Sequence[str] = KEYS) -> DataFrame:
    """Taker buy share of the quantity in each trailing window."""
    return _in_windows(trades, windows_min, keys).groupBy(*keys, "window_min").agg(
        F.count("*").alias("trades"), ratio(sum_if(is_buy(), "qty"), F.sum("qty")).alias("buy_share")
    )


def _in_windows(trades: DataFrame, windows_min: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """One row a trade and trailing window that holds it; the windows nest, so a trade is in a suffix of them."""
    age = F.col("now_ms") - F.col("ts_ms")
    held = F.filter(F.array(*[F.lit(int(w)) for w in sorted(windows_min)]), lambda w: age <= w * MINUTE)
    return with_now(trades, keys).select(*trades.columns, "now_ms", F.explode(held).alias("window_min"))


def bucketed_buy_share(trades: DataFrame, bucket_ms: int = MINUTE, keys: Sequence[str] = KEYS) -> DataFrame:
    return trades.groupBy(*keys, bucket_start("ts_ms", bucket_ms).alias("bucket_ms")).agg(
        ratio(sum_if(is_buy(), "qty"), F.sum("qty")).alias("buy_share"), F.count("*").alias("trades")
    )


def buy_rates(trades: DataFrame, stale_ms: int = 2 * MINUTE, keys: Sequence[str] = KEYS, now_ms: Column | None = None) -> DataFrame:
    """Bought quantity of the last whole-minute bucket and of the best one; the last is 0 if older than ``stale_ms``."""
    minute = trades.groupBy(*keys, bucket_start("ts_ms", MINUTE).alias("m")).agg(
        sum_if(is_buy(), "qty").alias("buy"), F.max("ts_ms").alias("newest")
    )
    last = minute.groupBy(*keys).agg(
        F.max_by("buy", "m").alias("last_buy"), F.max("buy").alias("peak_rate"), F.max("m").alias("m"), F.max("newest").alias("newest")
    )
    now = F.col("newest") if now_ms is None else now_ms
    return last.select(*keys, F.when(now - F.col("m") > stale_ms, 0.0).otherwise(F.col("last_buy")).alias("current_rate"), "peak_rate")


def tiered_large_flow(
    trades: DataFrame, windows_min: Sequence[int] = (5, 15, 240),
    tiers: Sequence[tuple[str, float]] = (("large", 50.0), ("huge", 200.0), ("whale", 500.0)), keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Notional and count by tier and side over trailing windows of whole minutes; the dollar sums are rounded once.

    Trades are first summed by minute, so the windows are formed from a row a
    minute and not from the tape.
    """
    notional = F.col("price") * F.col("qty")
    sums = [sum_if(is_buy(), notional).alias("b"), sum_if(~is_buy(), notional).alias("s")]
    for name, least in tiers:
        for side, taken in (("buy", is_buy()), ("sell", ~is_buy())):
            hit = taken & (F.col("qty") >= least)
            sums += [sum_if(hit, notional).alias(f"{name}_{side}_usd"), count_if(hit).alias(f"{name}_{side}_n")]
    minutes = trades.groupBy(*keys, bucket_start("ts_ms", MINUTE).alias("m")).agg(*sums, F.max("ts_ms").alias("newest"))
    now = minutes.groupBy(*keys).agg(F.max("newest").alias("now_ms"))
    age = F.col("now_ms") - F.col("m")
    held = F.filter(F.array(*[F.lit(int(w)) for w in windows_min]), lambda w: age <= w * MINUTE)
    each = minutes.join(now, list(keys)).withColumn("window_min", F.explode(held))
    names = [f"{n}_{s}_{x}" for n, _ in tiers for s in ("buy", "sell") for x in ("usd", "n")]
    return each.groupBy(*keys, "window_min").agg(
        *[F.round(F.round(F.sum(n), 4), 0).alias(n) if n.endswith("usd") else F.sum(n).cast("long").alias(n) for n in names],
        F.round(F.sum("s") / F.greatest(F.sum("b"), F.lit(1.0)), 3).alias("sell_to_buy_ratio"),
    )


def seller_aggression(
    trades: DataFrame, windows_min: Sequence[int] = (5, 15, 240), min_print_qty: float = 45.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Large prints' sell/buy ratio and class in each trailing window.

    Without large buys the ratio is null: HIGH if there are large sells, else no class.
    """
    big = F.col("qty") >= min_print_qty
    counted = _in_windows(trades, windows_min, keys).groupBy(*keys, "window_min").agg(
        F.count("*").alias("trades_in_window"), count_if(big & is_buy()).alias("big_buys"), count_if(big & ~is_buy()).alias("big_sells"),
        sum_if(big & is_buy(), "qty").alias("taker_buy_qty"), sum_if(big & ~is_buy(), "qty").alias("taker_sell_qty"),
    )
    return counted.withColumn("sell_ratio", ratio("taker_sell_qty", "taker_buy_qty")).withColumn(
        "classification",
        labelled(
            (F.col("sell_ratio").isNull() & (F.col("taker_sell_qty") > 0), "HIGH"), (F.col("sell_ratio") > 1.5, "HIGH"),
            (F.col("sell_ratio") > 0.8, "MEDIUM"), (F.col("sell_ratio").isNotNull(), "LOW"),
        ),
    )


def large_prints(trades: DataFrame, min_qty: float = 50.0, keep: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest ``keep`` prints a key of at least ``min_qty``."""
    newest = Window.partitionBy(*keys).orderBy(F.col("ts_ms").desc(), F.col("trade_id").desc(), F.col("price").desc())
    return (
        with_trade_side(trades.where(F.col("qty") >= min_qty))
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= keep)
        .select(*keys, "rank", "trade_id", "ts_ms", "price", "qty", "notional", "side")
    )


def new_large_prints(prints: DataFrame, recorded: DataFrame) -> DataFrame:
    """Prints whose (symbol, venue, trade_id) hasn't been recorded."""
    return prints.join(recorded.select("symbol", "venue", "trade_id").distinct(), ["symbol", "venue", "trade_id"], "left_anti")


def flow_persistence(trades: DataFrame, keys: Sequence[str] = KEYS, moved_by: float = 0.05, least: int = 20) -> DataFrame:
    """Notional buy share of the newer half of a key's trades against the older half; the older half has the odd one."""
    # Numbered from the oldest, by ranges of time, so that no task holds a whole key.
    order = ("ts_ms", "trade_id", F.col("price").desc(), F.col("qty").desc(), F.col("is_buyer_maker").desc())
    numbered = with_running_sum(trades.select(*keys, "ts_ms", "trade_id", "price", "qty", "is_buyer_maker"), keys, order, F.lit(1), "rn", RANGE_MS)
    sizes = trades.groupBy(*keys).agg(F.count("*").alias("n"))
    halves = joined_by_key(numbered, sizes, keys).withColumn("v", F.col("price") * F.col("qty"))
    recent = F.col("rn") > F.col("n") - F.floor(F.col("n") / 2)

    def share(half: Column) -> Column:
        return ratio(sum_if(half & is_buy(), "v"), sum_if(half, "v"))

    def cvd(half: Column) -> Column:
        return sum_if(half & is_buy(), "v") - sum_if(half & ~is_buy(), "v")

    out = halves.groupBy(*keys).agg(
        F.count("*").alias("trades"), share(recent).alias("recent_share"), share(~recent).alias("older_share"),
        cvd(recent).alias("recent_cvd_notional"), cvd(~recent).alias("older_cvd_notional"),
    )
    moved = F.col("recent_share") - F.col("older_share")
    return out.withColumn(
        "trend",
        labelled((F.col("trades") < least, "insufficient-data"), (moved > moved_by, "accelerating-buy"), (moved < -moved_by, "accelerating-sell"), default="balanced"),
    )


def cvd_surge(buckets: DataFrame, factor: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The latest bucket's absolute delta against the mean of all earlier ones."""
    last = buckets.groupBy(*keys).agg(F.max("t").alias("last_t"))
    joined = buckets.join(last, list(keys))
    now, prior = F.col("t") == F.col("last_t"), F.col("t") < F.col("last_t")
    return joined.groupBy(*keys).agg(
        F.max(F.when(now, F.abs("delta"))).alias("latest_abs"), F.avg(F.when(prior, F.abs("delta"))).alias("prior_mean"), count_if(prior).alias("prior_buckets")
    ).withColumn("surge", F.coalesce((F.col("prior_mean") > 0) & (F.col("latest_abs") > factor * F.col("prior_mean")), F.lit(False)))


def hourly_keystone_migration(trades: DataFrame, bucket_size: float = 0.05, width: float = 0.20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each hour's price bucket with most taker buying, and its move from the hour before that had one.

    Ties go to the lowest bucket. Hours without buys have no keystone and are passed over.
    """
    hour = bucket_start("ts_ms", 3_600_000)
    flow = trades.groupBy(*keys, hour.alias("hour_ms"), nearest_bucket("price", bucket_size).alias("b")).agg(
        sum_if(is_buy(), "qty").alias("buy"), sum_if(~is_buy(), "qty").alias("sell"), count_if(is_buy()).alias("buys")
    )
    best = F.max(F.when(F.col("buys") > 0, F.struct("buy", (-F.col("b")).alias("nb"))))["nb"]
    hours = flow.groupBy(*keys, "hour_ms").agg((-best).alias("keystone_id"), F.sum("buy").alias("buy_vol"), F.sum("sell").alias("sell_vol"))
    before = Window.partitionBy(*keys).orderBy("hour_ms").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("keystone_id") - F.last("keystone_id", ignorenulls=True).over(before)
    steps = width / bucket_size + 1e-9
    return hours.select(
        *keys, "hour_ms", (F.col("keystone_id") * bucket_size).alias("keystone"), "buy_vol", "sell_vol",
        labelled((moved > steps, "UP"), (moved < -steps, "DOWN"), (moved.isNotNull(), "FLAT")).alias("migration"),
    )


def migration_verdict(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Net number of upward moves and the verdict on them; for hourly and for cycle migration rows."""
    up, down = count_if(F.col("migration") == "UP"), count_if(F.col("migration") == "DOWN")
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), (up - down).alias("net_buckets")).withColumn(
        "verdict", labelled((F.col("net_buckets") > 0, "MIGRATING_UP"), (F.col("net_buckets") < 0, "MIGRATING_DOWN"), default="FLAT")
    )


def keystone_cycle_migration(history: DataFrame, width: float = 0.20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Moves between consecutive recorded keystones (``cycle_ts, keystone_price``); null prices are left out."""
    order = Window.partitionBy(*keys).orderBy("cycle_ts")
    moved = F.col("keystone_price") - F.lag("keystone_price").over(order)
    return history.where("keystone_price is not null").select(
        *keys, "cycle_ts", F.col("keystone_price").alias("keystone"),
        labelled((moved > width, "UP"), (moved < -width, "DOWN"), (moved.isNotNull(), "FLAT")).alias("migration"),
    )


def volume_profile(trades: DataFrame, bucket_size: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Volumes and counts by nearest price bucket."""
    return trades.groupBy(*keys, nearest_bucket("price", bucket_size).alias("bucket_id")).agg(
        sum_if(is_buy(), "qty").alias("buy"), sum_if(~is_buy(), "qty").alias("sell"), F.count("*").alias("n"),
        count_if(is_buy()).alias("buy_n"), count_if(~is_buy()).alias("sell_n"),
    ).withColumn("price", F.round(F.col("bucket_id") * bucket_size, 10))


def volume_profile_summary(profile: DataFrame, keys: Sequence[str] = KEYS, value_area: float = 0.70) -> DataFrame:
    """Point of control, value area, price range and counts of high and low volume buckets.

    Ties go to the lowest bucket. The high-volume threshold is the volume at
    place max(1, n // 10), at most n - 1, of the ascending volumes from 0.
    """
    vol = F.col("buy") + F.col("sell")
    falling = Window.partitionBy(*keys).orderBy(F.col("vol").desc(), "bucket_id")
    rising = Window.partitionBy(*keys).orderBy("vol", "bucket_id")
    whole = Window.partitionBy(*keys)
    ranked = profile.withColumn("vol", vol).select(
        *keys, "price", "vol", "bucket_id",
        F.sum("vol").over(whole).alias("total"), F.count("*").over(whole).alias("n"), F.row_number().over(rising).alias("up"),
        (F.sum("vol").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("vol")).alias("before"), F.row_number().over(falling).alias("down"),
    )
    place = F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.col("n") - 1)
    in_area = F.col("before") < F.col("total") * value_area
    marked = ranked.withColumn("threshold", F.max(F.when(F.col("up") == place + 1, F.col("vol"))).over(whole))
    return marked.groupBy(*keys).agg(
        F.max("total").alias("total_volume"), F.max(F.when(F.col("down") == 1, F.col("price"))).alias("poc"),
        F.max(F.when(in_area, F.col("price"))).alias("vah"), F.min(F.when(in_area, F.col("price"))).alias("val"),
        F.min("price").alias("low"), F.max("price").alias("high"),
        count_if(F.col("vol") >= F.col("threshold")).alias("hvn_count"),
        count_if(F.col("vol") < F.col("total") / F.col("n") * 0.3).alias("lvn_count"), F.max("n").alias("bucket_count"),
    ).where("total_volume > 0")


def side_split(profile: DataFrame, top_n: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Top buckets by bought and by sold quantity, ties to the lowest bucket."""

    def top(side: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(side).desc(), "bucket_id")
        return profile.select(
            *keys, F.lit(side).alias("side"), F.row_number().over(order).alias("rank"), "price", F.col(side).alias("qty"),
            (F.col("price") * F.col(side)).alias("notional"), F.col(f"{side}_n").alias("trades"),
        ).where(F.col("rank") <= top_n)

    return top("buy").unionByName(top("sell"))


def fold_venue_totals(trades: DataFrame, horizon_ms: Sequence[int] = (15 * MINUTE, 60 * MINUTE, 240 * MINUTE)) -> DataFrame:
    """Trailing totals a symbol, venue and horizon over deduplicated trades."""
    held = F.filter(F.array(*[F.lit(int(h)) for h in horizon_ms]), lambda h: F.col("now_ms") - F.col("ts_ms") <= h)
    each = with_now(dedupe_trades(trades)).withColumn("horizon_ms", F.explode(held))
    return each.groupBy("symbol", "venue", "horizon_ms").agg(F.count("*").alias("trades"), *_buy_sell()).select(
        "symbol", "venue", F.col("horizon_ms").cast("long").alias("horizon_ms"), "trades", "buy_vol", "sell_vol",
        (F.col("buy_vol") - F.col("sell_vol")).alias("cvd"), ratio("buy_vol", F.col("buy_vol") + F.col("sell_vol")).alias("buy_share"),
    )


def fold_candles(trades: DataFrame, segment_ms: int = 15 * MINUTE, offset_ms: int = 19_800_000, order: Column | None = None) -> DataFrame:
    """OHLC, volume and notional a segment, aligned to UTC+05:30, over deduplicated trades; ``order``: by what the first and the last trade are told (else time, then id)."""
    order = F.struct("ts_ms", "trade_id") if order is None else order
    return dedupe_trades(trades).groupBy("symbol", "venue", bucket_start("ts_ms", segment_ms, offset_ms).alias("bucket_ms")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.count("*").alias("trades"),
    )
