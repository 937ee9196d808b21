"""Candle and derivative-bar operators.

Klines: ``symbol, venue, bucket_ms, open, high, low, close, volume``. Taker
bars: ``symbol, bucket_ms, buy_vol, sell_vol``. Open interest: ``symbol,
bucket_ms, sum_open_interest, sum_open_interest_value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.chains import bursts, with_chains
from tapewright.functions.columns import is_buy, labelled, ratio, sum_if
from tapewright.operators.tape import guarded_corr

BAR_MS = 300_000


def by_time(order: str):
    return Window.partitionBy("symbol").orderBy(order)


def last_per_bucket(rows: DataFrame, cols: Sequence[str], ts: str = "bucket_ms") -> DataFrame:
    """One row a symbol and five-minute bucket: the newest, ties to the greatest values."""
    bucket = F.col(ts) - F.pmod(F.col(ts), F.lit(BAR_MS))
    newest = F.max(F.struct(F.col(ts).alias("_ts"), *cols)).alias("r")
    return rows.groupBy("symbol", bucket.alias("bucket_ms")).agg(newest).select("symbol", "bucket_ms", *[F.col(f"r.{c}").alias(c) for c in cols])


# The bar classes' scores.
PROACT_SCORE = {
    "AGGRESSIVE_LONG": 2, "ABSORPTION": 1, "DISTRIBUTION": -1, "SHORT_BUILD": -2, "SHORT_COVER": 0, "LONG_UNWIND": -1,
    "NEUTRAL_LONG_BUILD": 1, "NEUTRAL_SHORT_BUILD": -1, "TWO_SIDED_FLAT": 0, "NEUTRAL_MIXED": 0,
}


def classify_bar(oi_pct: Column, px_pct: Column, tbr: Column, flat: float = 0.05) -> Column:
    """Ten classes by the directions of open interest and price and the taker buy ratio."""
    oi_up, oi_down, px_up, px_down = oi_pct > flat, oi_pct < -flat, px_pct > flat, px_pct < -flat
    bull, bear = tbr >= 0.55, tbr <= 0.45
    return labelled(
        (oi_up & px_up & bull, "AGGRESSIVE_LONG"), (oi_up & px_up & bear, "DISTRIBUTION"), (oi_up & px_up, "NEUTRAL_LONG_BUILD"),
        (oi_up & px_down & bull, "ABSORPTION"), (oi_up & px_down & bear, "SHORT_BUILD"), (oi_up & px_down, "NEUTRAL_SHORT_BUILD"),
        (oi_down & px_up, "SHORT_COVER"), (oi_down & px_down, "LONG_UNWIND"), (~oi_up & ~oi_down & ~px_up & ~px_down, "TWO_SIDED_FLAT"),
        default="NEUTRAL_MIXED",
    )


def change_pct(now: Column | str, before: Column) -> Column:
    """Percentage change, 0 without an earlier value or from zero."""
    now = F.col(now) if isinstance(now, str) else now
    return F.coalesce(ratio((now - before) * 100, before), F.lit(0.0))


def align_oi_rows(oi: DataFrame, taker: DataFrame, klines: DataFrame) -> DataFrame:
    """Buckets that all three series have, with changes against the aligned bucket before, class and score."""
    o = last_per_bucket(oi, ["sum_open_interest", "sum_open_interest_value"])
    t = last_per_bucket(taker, ["buy_vol", "sell_vol"])
    k = last_per_bucket(klines, ["open", "high", "low", "close"])
    order = by_time("bucket_ms")
    rows = o.join(t, ["symbol", "bucket_ms"]).join(k, ["symbol", "bucket_ms"]).select(
        "symbol", "bucket_ms", F.col("sum_open_interest").alias("oi"), F.col("sum_open_interest_value").alias("oi_value"),
        change_pct("sum_open_interest", F.lag("sum_open_interest").over(order)).alias("oi_delta_pct"),
        F.col("open").alias("px_open"), F.col("close").alias("px_close"), F.col("high").alias("px_high"), F.col("low").alias("px_low"),
        change_pct("close", F.lag("close").over(order)).alias("px_delta_pct"),
        F.coalesce(ratio("buy_vol", F.col("buy_vol") + F.col("sell_vol")), F.lit(0.5)).alias("tbr"), "buy_vol", "sell_vol", (F.col("buy_vol") - F.col("sell_vol")).alias("net_vol"),
    )
    classed = rows.withColumn("class", classify_bar(F.col("oi_delta_pct"), F.col("px_delta_pct"), F.col("tbr")))
    score = F.create_map(*[F.lit(x) for kv in PROACT_SCORE.items() for x in kv])
    return classed.withColumn("proactiveness", F.element_at(score, F.col("class")))


def proactiveness(rows: DataFrame) -> DataFrame:
    """At every aligned bar: the score of the last three, with label and confidence."""
    last3 = by_time("bucket_ms").rowsBetween(-2, 0)
    score = F.sum("proactiveness").over(last3)
    s = F.col("score")
    return rows.select("symbol", "bucket_ms", score.cast("long").alias("score"), F.count("*").over(last3).alias("window_bars")).select(
        "*", labelled((s >= 7, "PROACTIVE"), (s >= 4, "WARMING"), (s >= 1, "PASSIVE"), default="ABSENT").alias("label"),
        labelled((s >= 7, "HIGH"), (s >= 1, "MEDIUM"), default="HIGH").alias("confidence"),
    )


def liquidation_signal(oi: Column, px: Column) -> Column:
    flat = F.abs(oi) < 0.2
    return labelled(
        ((oi < -0.3) & (px < -0.3), "LONG_LIQUIDATION_LIKELY"), ((oi < -0.3) & (px > 0.3), "SHORT_LIQUIDATION_LIKELY"),
        (flat & (px < -0.3), "ORGANIC_SELLING"), (flat & (px > 0.3), "ORGANIC_BUYING"),
        ((oi > 0.3) & (px < -0.3), "SHORT_ADDING_INTO_WEAKNESS"), ((oi > 0.3) & (px > 0.3), "LONG_ADDING_INTO_STRENGTH"), default="MIXED_RANGE_BOUND",
    )


def oi_price_divergence(oi: DataFrame, klines: DataFrame) -> DataFrame:
    """Per symbol: summed bar-to-bar changes of open interest, and of price in those bars' candles, with the signal."""
    o = last_per_bucket(oi, ["sum_open_interest"])
    before = F.lag("sum_open_interest").over(by_time("bucket_ms"))
    moved = o.select("symbol", "bucket_ms", before.alias("prev"), change_pct("sum_open_interest", before).alias("oi_change")).where("prev is not null")
    k = last_per_bucket(klines, ["open", "close"])
    sums = moved.join(k, ["symbol", "bucket_ms"], "left").groupBy("symbol").agg(
        F.count("*").alias("bars"), F.sum("oi_change").alias("oi_change_pct"), F.sum(F.coalesce(ratio((F.col("close") - F.col("open")) * 100, "open"), F.lit(0.0))).alias("price_change_pct")
    )
    return sums.withColumn("signal", liquidation_signal(F.col("oi_change_pct"), F.col("price_change_pct")))


def vol_direction_split(klines: DataFrame, keys: Sequence[str] = ("symbol", "venue")) -> DataFrame:
    """Volume on rising and on falling candles."""
    s = klines.groupBy(*keys).agg(sum_if(F.col("close") > F.col("open"), "volume").alias("up_vol"), sum_if(F.col("close") < F.col("open"), "volume").alias("down_vol"))
    return s.withColumn("up_pct", F.coalesce(ratio(F.col("up_vol") * 100, F.col("up_vol") + F.col("down_vol")), F.lit(0.0)))


def newest_bars(rows: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last ``n`` bars of each key; ``age`` is 1 for the newest."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("bucket_ms").desc()))).where(F.col("age") <= n)


def stage_window_inputs(klines: DataFrame, oi: DataFrame, bars: int = 48) -> DataFrame:
    """Price change from the first open to the last close, open-interest change and up-volume share of the last bars."""
    k = newest_bars(klines, bars).groupBy("symbol").agg(
        F.min_by("open", "bucket_ms").alias("first_open"), F.max_by("close", "bucket_ms").alias("last_close"),
        sum_if(F.col("close") > F.col("open"), "volume").alias("up"), sum_if(F.col("close") < F.col("open"), "volume").alias("down"),
    )
    o = newest_bars(oi, bars).groupBy("symbol").agg(F.min_by("sum_open_interest", "bucket_ms").alias("first_oi"), F.max_by("sum_open_interest", "bucket_ms").alias("last_oi"))
    return k.join(o, "symbol", "left").select(
        "symbol", change_pct("last_close", F.col("first_open")).alias("px_chg_4h"), change_pct("last_oi", F.col("first_oi")).alias("oi_chg_4h"),
        F.coalesce(ratio(F.col("up") * 100, F.col("up") + F.col("down")), F.lit(0.0)).alias("up_pct_4h"),
    )


def _ordered(value: str) -> Column:
    """A key's values in time order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("bucket_ms", F.col(value).alias("v")))), lambda x: x["v"])


def ema(klines: DataFrame, periods: Sequence[int] = (9, 21, 50, 200), keys: Sequence[str] = ("symbol", "venue")) -> DataFrame:
    """Closing EMAs seeded by the mean of the first values; null where a key has too few bars.

    The recursion needs a key's closes in order: one array a key, of as many
    numbers as it has bars (a year of five-minute bars is under a megabyte).
    """
    series = klines.groupBy(*keys).agg(_ordered("close").alias("c"), F.max_by("high", "bucket_ms").alias("high"), F.max_by("low", "bucket_ms").alias("low"), F.max_by("close", "bucket_ms").alias("close"))

    def of(p: int) -> Column:
        k = 2 / (p + 1)
        seed = F.aggregate(F.slice("c", 1, p), F.lit(0.0), lambda a, x: a + x) / p
        return F.when(F.size("c") >= p, F.aggregate(F.slice("c", p + 1, F.greatest(F.size("c"), F.lit(1))), seed, lambda a, x: x * k + a * (1 - k)))

    return series.select(*keys, "high", "low", "close", *[of(p).alias(f"ema{p}") for p in periods])


def ema_position(emas: DataFrame, periods: Sequence[int] = (9, 21, 50, 200)) -> DataFrame:
    """Whether the last close stands above or below each EMA, and whether its candle was rejected there."""
    out = []
    for p in periods:
        e = F.col(f"ema{p}")
        out.append(F.when(e.isNotNull(), F.when(F.col("close") > e, "ABOVE").otherwise("BELOW")).alias(f"ema{p}_position"))
        out.append(labelled(((F.col("high") > e) & (F.col("close") < e), "upper_wick_reject"), ((F.col("low") < e) & (F.col("close") > e), "lower_wick_reject")).alias(f"ema{p}_wick"))
    return emas.select(*[c for c in emas.columns if c not in ("high", "low", "close") and not c.startswith("ema")], *out)


def atr_pct(klines: DataFrame, period: int = 14, keys: Sequence[str] = ("symbol", "venue")) -> DataFrame:
    """Mean true range of the last bars in percent of the last close; null below ``period`` + 1 bars."""
    order = Window.partitionBy(*keys).orderBy("bucket_ms")
    prev = F.lag("close").over(order)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))  # nulls are passed over
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = newest_bars(klines.withColumn("tr", tr).withColumn("n", n), period, keys)
    return rows.groupBy(*keys).agg(
        F.when((F.max("n") > period) & (F.max_by("close", "bucket_ms") > 0), F.sum("tr") / period / F.max_by("close", "bucket_ms") * 100).alias("atr_pct")
    )


def trend(series: DataFrame, value: str, n: int = 3, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last value, least-squares slope a bar and drift over the last ``n`` non-null values of each key, as far as there are two."""
    rows = newest_bars(series.where(F.col(value).isNotNull()), n, keys)
    many = F.count("*") > 1
    v, x = F.col(value), -F.col("age")
    return rows.groupBy(*keys).agg(
        F.max_by(value, "bucket_ms").alias("last"), F.when(many, F.covar_pop(x, v) / F.var_pop(x)).alias("slope_per_bar"),
        F.when(many, F.max_by(value, "bucket_ms") - F.min_by(value, "bucket_ms")).alias("drift"), F.count("*").alias("n_used"),
    )


def taker_share(taker: DataFrame) -> DataFrame:
    return taker.withColumn("share", F.coalesce(ratio("buy_vol", F.col("buy_vol") + F.col("sell_vol")), F.lit(0.5)))


def oi_changes(oi: DataFrame) -> DataFrame:
    """Bar-to-bar percentage changes of open interest."""
    before = F.lag("sum_open_interest").over(by_time("bucket_ms"))
    return oi.select("symbol", "bucket_ms", F.when(before.isNotNull(), change_pct("sum_open_interest", before)).alias("oi_pct"))


def zscore(series: DataFrame, value: str, n: int = 30, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last value against the last ``n``; null below three values or without variance."""
    s = newest_bars(series.where(F.col(value).isNotNull()), n, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.max_by(value, "bucket_ms").alias("last"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    return s.withColumn("zscore", F.when((F.col("n") >= 3) & (F.col("std") > 1e-12), (F.col("last") - F.col("mean")) / F.col("std")))


def oi_inflow_outflow(oi: DataFrame, windows: Sequence[int] = (12, 24, 48, 72, 144)) -> DataFrame:
    """Change of the last bar's open interest against so many bars before it; a row for each window that is covered."""
    rows = newest_bars(oi, max(windows) + 1)
    now = rows.where("age = 1").select("symbol", F.col("sum_open_interest").alias("now"))
    then = rows.where((F.col("age") - 1).isin(*windows)).select("symbol", (F.col("age") - 1).alias("bars"), F.col("sum_open_interest").alias("then"))
    return then.join(now, "symbol").select("symbol", F.col("bars").cast("long").alias("bars"), (F.col("now") - F.col("then")).alias("change"), ratio((F.col("now") - F.col("then")) * 100, "then").alias("change_pct"))


def oi_implied_value(oi: DataFrame, last_n: int = 8) -> DataFrame:
    """Open-interest value a contract over the last bars, and its change."""
    per = newest_bars(oi, last_n).withColumn("per", ratio("sum_open_interest_value", "sum_open_interest"))
    first, last = F.min_by("per", "bucket_ms"), F.max_by("per", "bucket_ms")
    return per.groupBy("symbol").agg(F.count("*").alias("bars"), first.alias("first_per_contract"), last.alias("last_per_contract"), F.when(F.count("*") > 1, ratio((last - first) * 100, first)).alias("change_pct"))


def oi_weighted_contracts(latest: DataFrame) -> DataFrame:
    """Long and short contracts by cohort from ``oi`` and the long shares ``top_long_pct, global_long_pct``."""
    made = [(F.col("oi") * (F.col(f"{c}_long_pct") if side == "long" else 1 - F.col(f"{c}_long_pct"))).alias(f"{c}_{side}_contracts") for c in ("top", "global") for side in ("long", "short")]
    return latest.select("symbol", "oi", *made)


def macro_returns(klines: DataFrame, benchmark: str) -> DataFrame:
    """Each symbol's compounded return, its correlation and beta to the benchmark on common bars, the residual and its label."""
    r = klines.where("open <> 0").select("symbol", "bucket_ms", ((F.col("close") - F.col("open")) / F.col("open")).alias("r"))
    bench = r.where(F.col("symbol") == benchmark).select("bucket_ms", F.col("r").alias("b"))
    whole = r.groupBy("symbol").agg(((F.exp(F.sum(F.log1p("r"))) - 1) * 100).alias("return_pct"))
    pair = r.join(bench, "bucket_ms").groupBy("symbol").agg(
        F.count("*").alias("bars"), guarded_corr("r", "b").alias("corr"),
        F.when((F.count("*") > 1) & (F.var_pop("b") > 0), F.covar_pop("r", "b") / F.var_pop("b")).alias("beta"),
    )
    bench_return = whole.where(F.col("symbol") == benchmark).select(F.col("return_pct").alias("bench_pct"))
    expected = F.col("beta") * F.col("bench_pct")
    residual = F.col("return_pct") - expected
    return whole.join(pair, "symbol", "left").join(F.broadcast(bench_return)).select(  # the benchmark is one row
        "symbol", "bars", "return_pct", "corr", "beta", expected.alias("expected_pct"), residual.alias("residual_pct"),
        labelled((residual > 1, "OUTPERFORMING"), (residual < -1, "UNDERPERFORMING"), (residual.isNotNull(), "TRACKING")).alias("label"),
    )


def relative_strength(klines: DataFrame) -> DataFrame:
    """Symbols ranked by their change from the first open to the last close."""
    s = klines.groupBy("symbol").agg(F.min_by("open", "bucket_ms").alias("o"), F.max_by("close", "bucket_ms").alias("last_price"), F.sum("volume").alias("volume"))
    out = s.select("symbol", change_pct("last_price", F.col("o")).alias("change_pct"), "last_price", "volume")
    # One row a symbol: a window over all of them is small.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("change_pct").desc(), "symbol")))


def wall_break(rates: DataFrame, minutes: int = 15) -> DataFrame:
    """Whether buying at the current or best rate clears ``total_wall`` in time; rows: symbol, total_wall, current_rate, peak_rate."""
    need = F.col("total_wall") / max(minutes, 1)
    safe, tiny = F.greatest(need, F.lit(1e-9)), F.lit(1e-9)
    return rates.select(
        "*", need.alias("required_rate"), (F.col("current_rate") / safe).alias("current_adequacy"), (F.col("peak_rate") / safe).alias("peak_adequacy"),
        (F.col("total_wall") / F.greatest("peak_rate", tiny)).alias("minutes_at_peak"),
        labelled((F.col("current_rate") >= need, "BUYERS_CAN_BREAK"), (F.col("peak_rate") >= need, "FIREPOWER_AVAILABLE"), default="CANNOT_BREAK_VIA_BUY_FLOW").alias("verdict"),
    )


def trade_clusters(trades: DataFrame, cutoff_ms: int | None = None, gap_ms: int = 1500, min_qty: float = 30.0, least: int = 3, keep: int = 10, range_ms: int = 3_600_000) -> DataFrame:
    """The heaviest bursts of a key: prints of ``min_qty`` within ``gap_ms`` of the burst's first print, which may be smaller.

    A burst ends at the first print that is late or small. Which print starts one depends on the bursts before, so they are
    chains over ranges of ``range_ms`` (``functions/chains.py``); no window holds a whole key.
    """
    recent = trades if cutoff_ms is None else trades.where(F.col("ts_ms") >= cutoff_ms)
    rows = recent.select("symbol", "venue", "ts_ms", "trade_id", "price", "qty", "is_buyer_maker")
    chained = with_chains(rows, ("symbol", "venue"), ("ts_ms", "trade_id", "price", "qty"), bursts(gap_ms, min_qty), range_ms, ("ts_ms", "qty"))
    total, bought = F.sum("qty"), sum_if(is_buy(), F.col("qty"))
    found = chained.groupBy("symbol", "venue", "chain").agg(
        F.min("ts_ms").alias("ts_ms"), F.count("*").alias("trade_count"), total.alias("total_qty"), bought.alias("buy_qty"),
        (total - bought).alias("sell_qty"), (F.sum(F.col("price") * F.col("qty")) / total).alias("average_price"),
    )
    heavy = Window.partitionBy("symbol", "venue").orderBy(F.col("total_qty").desc(), "ts_ms")
    ranked = found.where(F.col("trade_count") >= least).drop("chain").withColumn("rank", F.row_number().over(heavy))
    return ranked.where(F.col("rank") <= keep)


def liquidation_inputs(taker: DataFrame, bars: int = 12) -> DataFrame:
    """Mean and newest taker buy ratio of the last bars."""
    rows = newest_bars(taker, bars).withColumn("r", F.col("buy_vol") / F.greatest(F.col("buy_vol") + F.col("sell_vol"), F.lit(0.001)))
    return rows.groupBy("symbol").agg(F.count("*").alias("bars"), F.avg("r").alias("average_ratio"), F.max_by("r", "bucket_ms").alias("last_ratio"))
