"""Rule verdicts and change-only signals as columns over tables of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import labelled, ratio, reasons, total
from tapewright.functions.ranges import with_previous, with_running_sum


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of all rules that hold; null conditions give none."""
    return total([F.when(c, n).otherwise(0) for c, n in rules]).cast("long")


def tbr_oi_combo(rows: DataFrame) -> DataFrame:
    """Where demand comes from, by ``tbr_trend`` and ``oi_trend`` texts."""
    buying, selling = F.col("tbr_trend").contains("BUY PRESSURE BUILDING"), F.col("tbr_trend").contains("SELL PRESSURE BUILDING")
    oi = lambda s: F.col("oi_trend").contains(f"OI {s}")
    return rows.withColumn(
        "combo",
        labelled(
            (buying & oi("RISING"), "NEW LONGS OPENING (real buyer demand)"), (buying & oi("FLAT"), "SHORT COVERING (paper support, not real demand)"),
            (buying & oi("FALLING"), "SHORT COVERS + LIQUIDATIONS"), (selling & oi("RISING"), "NEW SHORTS OPENING (real paper selling)"),
            (selling & oi("FLAT"), "LONG UNWINDING (longs closing)"), (selling & oi("FALLING"), "LIQUIDATION CASCADE"), default="MIXED / NO CLEAR SIGNAL",
        ),
    )


def infer_stage(rows: DataFrame) -> DataFrame:
    """Market stage by scored rules from ``px_chg_4h, oi_chg_4h, up_pct_4h, up_steps, down_steps``."""
    px, oi, up = F.col("px_chg_4h"), F.col("oi_chg_4h"), F.col("up_pct_4h")
    rising, falling = F.col("up_steps") > F.col("down_steps"), F.col("down_steps") > F.col("up_steps")
    markup, flat_oi, markdown = (px > 1.0) & (oi > 0.5), (px < -0.5) & (F.abs(oi) < 0.5), (px < -1.0) & (oi > 0.5)
    clusters = F.coalesce(F.col("distribution_clusters") > F.col("absorption_clusters") * 2, F.lit(False))
    tight, balanced, sellers = F.abs(px) < 1.0, (up > 50) & (up < 70), up < 50
    score = points((tight, 1), (balanced, 1), (markup, 2), (rising, 1), (flat_oi, 2), (falling, 2), (sellers, 1), (clusters, 2), (markdown, 2))
    why = reasons(
        (tight, "tight range"), (balanced, "balanced volume"), (markup, "price and OI rising"), (rising, "keystone up"), (flat_oi, "price down, OI flat"),
        (falling, "keystone down"), (sellers, "more volume on down bars"), (clusters, "distribution clusters"), (markdown, "price down, OI up"),
    )
    s = F.col("score")
    return rows.withColumn("score", score).withColumn("reasons", why).withColumn(
        "stage",
        labelled(
            ((s >= 4) & falling & flat_oi, "DISTRIBUTION (late stage — high conviction)"), ((s >= 3) & falling, "DISTRIBUTION (early/mid stage)"),
            ((s >= 3) & markup, "MARKUP"), ((s >= 3) & markdown, "MARKDOWN"), ((s <= 2) & tight, "ACCUMULATION"), default="TRANSITION / UNCLEAR",
        ),
    ).withColumn(
        "confidence",
        labelled(
            (F.col("stage").startswith("DISTRIBUTION (late"), "HIGH"), (F.col("stage").isin("DISTRIBUTION (early/mid stage)", "MARKUP", "MARKDOWN"), "MEDIUM"),
            (F.col("stage") == "ACCUMULATION", "LOW-MEDIUM"), default="LOW",
        ),
    )


def auction_verdict(rows: DataFrame) -> DataFrame:
    """Who wins the auction: score of spot skew, depth, taker share, persistence and the futures taker ratio.

    Columns: ``spot_skew_bps, spot_obi, spot_share, spot_trend, futures_share, taker_ratio``.
    """
    skew, obi, share, fut, taker = (F.col(c) for c in ("spot_skew_bps", "spot_obi", "spot_share", "futures_share", "taker_ratio"))
    contested = F.coalesce((share > 0.55) != (fut > 0.55), F.lit(False))
    sided = [
        (skew > 0.5, skew < -0.5, "microprice"), (obi > 0.2, obi < -0.2, "top-20 depth"), (share > 0.55, share < 0.45, "spot takers"),
        (F.col("spot_trend") == "accelerating-buy", F.col("spot_trend") == "accelerating-sell", "spot flow"), (taker > 1.05, taker < 0.95, "futures takers"),
    ]
    score = points(*[(b, 1) for b, _, _ in sided], *[(s, -1) for _, s, _ in sided])
    why = reasons(*[x for b, s, n in sided for x in ((b, f"{n}: buyers"), (s, f"{n}: sellers"))], (contested, "venues contested"))
    s = F.col("score")
    return rows.withColumn("score", score).withColumn("contested", contested).withColumn("reasons", why).withColumn(
        "verdict",
        labelled(
            (F.col("contested"), "AUCTION CONTESTED — no consensus"), (s >= 4, "BUYERS WINNING THE AUCTION (clear dominance)"), (s >= 2, "BUYERS EDGE (slight lead)"),
            (s <= -4, "SELLERS WINNING THE AUCTION (clear dominance)"), (s <= -2, "SELLERS EDGE (slight lead)"), default="AUCTION IN BALANCE (waiting for catalyst)",
        ),
    )


def demand_verdict(rows: DataFrame) -> DataFrame:
    """Spot or leveraged demand, by ordered rules.

    Columns: ``spot_cvd, futures_cvd, spot_share, futures_share, funding, long_pct, top_long_pct``; null flows count as none.
    """
    s_cvd, f_cvd, funding = (F.coalesce(c, F.lit(0.0)) for c in ("spot_cvd", "futures_cvd", "funding"))
    s_share, f_share = F.coalesce("spot_share", F.lit(0.5)), F.coalesce("futures_share", F.lit(0.5))
    s_buy, s_sell, f_buy, f_sell = (s_cvd > 0) & (s_share > 0.55), (s_cvd < 0) & (s_share < 0.45), (f_cvd > 0) & (f_share > 0.55), (f_cvd < 0) & (f_share < 0.45)
    paper = F.abs(f_cvd) > F.greatest(F.abs(s_cvd), F.lit(1.0)) * 3
    crowded = F.coalesce(F.col("long_pct") > 0.65, F.lit(False))
    verdict = labelled(
        (s_buy & f_sell & (funding <= 0) & crowded, "SPOT-ACCUMULATION-vs-FUT-DISTRIBUTION (real bid, but retail crowded long — squeeze risk both ways)"),
        (s_buy & f_sell & (funding <= 0), "SPOT-ACCUMULATION-vs-FUT-DISTRIBUTION (real bid, smart-money absorbing leverage)"),
        (s_buy & ~f_sell, "SPOT-DEMAND (durable bid)"), (s_sell & f_buy, "DISTRIBUTION-ON-RIP (real sellers to paper buyers — weak tape)"),
        (f_sell & paper, "FUTURES-DOMINATED (paper selling, thin spot — fragile)"),
        (s_buy & f_buy & (funding > 0.0005), "LEVERAGE-OVERHEATED (real + paper demand, long-crowded, funding spiking)"),
        (f_buy & paper, "LEV-LONG-BUILD (paper longs only — reversible)"), (s_sell & f_sell, "BOTH-SELLING (broad distribution, weak tape)"),
        (s_buy & f_sell, "SPOT-BID / FUTURES-DISTRIBUTION (paper friction against real bid)"), default="MIXED-ABSORPTION (no clear direction)",
    )
    why = reasons(
        (s_cvd > 0, "spot CVD buys"), (s_cvd <= 0, "spot CVD sells"), (f_cvd > 0, "futures CVD buys"), (f_cvd <= 0, "futures CVD sells"),
        (F.col("top_long_pct") < F.col("long_pct") - 0.05, "smart money fading crowd"), (F.col("top_long_pct") > F.col("long_pct") + 0.05, "smart money with crowd"),
        (funding <= -0.0003, "negative funding: squeeze fuel"),
    )
    return rows.withColumn("verdict", verdict).withColumn("reasons", why)


def macro_climate(rows: DataFrame) -> DataFrame:
    """Whether the market supports longs, from two leaders' changes (``first_pct, second_pct``) and the target's (``target_pct``)."""
    a, b, t = F.col("first_pct"), F.col("second_pct"), F.coalesce("target_pct", F.lit(0.0))
    off = (a < -1.5) & (b < -1.5)
    return rows.withColumn(
        "climate",
        labelled(
            (a.isNull() | b.isNull(), "MACRO: data unavailable"), (off & (t > a + 0.5), "MACRO RISK-OFF: relative bid"), (off, "MACRO RISK-OFF: broad selling"),
            ((a > 1.0) & (b > 1.0), "MACRO RISK-ON"), ((a > -1.5) & (a < 1.0), "MACRO NEUTRAL-CHOPPY"), default="MACRO MIXED",
        ),
    )


def regime_verdict(rows: DataFrame) -> DataFrame:
    """Labels of the futures metrics, and the regime they add up to.

    Columns: ``last_price, vwap, cvd, obi, funding, ls_ratio, top_ls_ratio, large_buy_usd, large_sell_usd``.
    """
    last, vwap, cvd, obi, rate, ls, top = (F.col(c) for c in ("last_price", "vwap", "cvd", "obi", "funding", "ls_ratio", "top_ls_ratio"))
    large = ratio("large_buy_usd", F.col("large_buy_usd") + F.col("large_sell_usd"))
    bull, bear = last > vwap * 1.0005, last < vwap * 0.9995
    labels = reasons(
        (bull, "BULL"), (bear, "BEAR"), (~bull & ~bear, "CHOP"), (cvd > 0, "AGGR-BUY"), (cvd < 0, "AGGR-SELL"), (obi > 0.2, "BID-WALL"), (obi < -0.2, "ASK-WALL"),
        (rate > 0.0005, "LONG-CROWDED"), ((rate > 0.0001) & (rate <= 0.0005), "LONG-LEAN"), (rate < -0.0005, "SHORT-CROWDED"), ((rate < -0.0001) & (rate >= -0.0005), "SHORT-LEAN"),
        (ls > 1.8, "CROWD-LONG"), (ls < 0.55, "CROWD-SHORT"), (top < ls * 0.8, "SMART-VS-CROWD-BEAR"), (top > ls * 1.2, "SMART-VS-CROWD-BULL"),
        (large > 0.65, "LARGE-BUYS"), (large < 0.35, "LARGE-SELLS"),
    )
    has = lambda name: F.array_contains("labels", name)
    return rows.withColumn("labels", labels).withColumn(
        "regime",
        labelled(
            (has("BULL") & has("AGGR-BUY"), "TREND-UP (long build confirmed)"), (has("BEAR") & has("AGGR-SELL"), "TREND-DOWN (short build confirmed)"),
            (has("CROWD-LONG") & has("SMART-VS-CROWD-BEAR") & (has("AGGR-SELL") | has("BEAR")), "TRAP-LONG (smart money fading retail longs)"),
            (has("CROWD-SHORT") & has("SMART-VS-CROWD-BULL") & (has("AGGR-BUY") | has("BULL")), "TRAP-SHORT (smart money fading retail shorts)"),
            (has("LONG-CROWDED") & has("AGGR-SELL"), "LONG-SQUEEZE RISK (crowded + sellers winning)"), (has("SHORT-CROWDED") & has("AGGR-BUY"), "SHORT-SQUEEZE RISK (crowded + buyers winning)"),
            (has("BID-WALL") | has("ASK-WALL"), "ABSORPTION / SQUEEZE"), (has("CHOP"), "CHOP / RANGE"), (has("BULL"), "WEAK-UP"), (has("BEAR"), "WEAK-DOWN"), default="MIXED",
        ),
    )


def deterministic_signals(snapshots: DataFrame) -> DataFrame:
    """One row a signal that a snapshot raises against the symbol's snapshot before it.

    Columns: ``symbol, ts_ms, spot_buy_share, futures_buy_share, spot_obi, open_interest``.
    """
    order = Window.partitionBy("symbol").orderBy("ts_ms")

    def divergence(spot: Column, fut: Column) -> Column:
        return labelled(((spot <= 0.40) & (fut >= 0.60), "spot_selling_futures_buying"), ((spot >= 0.60) & (fut <= 0.40), "spot_buying_futures_selling"))

    share = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    now = divergence(share("spot_buy_share"), share("futures_buy_share"))
    was = F.lag(now).over(order)
    obi = F.col("spot_obi")
    oi_change = ratio(F.col("open_interest") - F.lag("open_interest").over(order), F.lag("open_interest").over(order))

    def signal(when: Column, kind: str, severity: int, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("signal_type"), F.lit(severity).alias("severity"), detail.alias("detail")))

    raised = F.array_compact(
        F.array(
            signal(now.isNotNull() & ~now.eqNullSafe(was), "spot_futures_divergence", 3, now),
            signal((F.abs(obi) >= 0.45) & (F.abs(F.coalesce(F.lag(obi).over(order), F.lit(0.0))) < 0.45), "spot_depth_imbalance", 2, F.when(obi > 0, "bid").otherwise("ask")),
            signal(F.abs(oi_change) >= 0.01, "open_interest_shift", 2, F.when(oi_change > 0, "up").otherwise("down")),
        )
    )
    return snapshots.select("symbol", "ts_ms", raised.alias("raised")).select("symbol", "ts_ms", F.explode("raised").alias("s")).select("symbol", "ts_ms", "s.*")


def state_flips(rows: DataFrame, state: str, keys: Sequence[str], order: str) -> DataFrame:
    """The rows whose state differs from the key's row before; first rows and null states aren't flips."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("previous_state", before).where(F.col("previous_state").isNotNull() & F.col(state).isNotNull() & (F.col("previous_state") != F.col(state)))


def band_crossings(rows: DataFrame, value: str, bands: Sequence[float], keys: Sequence[str], order: str) -> DataFrame:
    """The rows whose value lies in another band than the key's row before."""
    band = total([F.when(F.col(value) > b, 1).otherwise(0) for b in bands])
    return state_flips(rows.withColumn("band", F.when(F.col(value).isNotNull(), band)), "band", keys, order)


def ratio_jumps(rows: DataFrame, value: str, factor: float, keys: Sequence[str], order: str) -> DataFrame:
    """The rows whose value is at least ``factor`` times the key's row before, or at most its inverse of it."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("previous", before).where((F.col("previous") > 0) & ((F.col(value) >= F.col("previous") * factor) | (F.col(value) <= F.col("previous") / factor)))


#: Width of the time ranges into which a key's raw rows are dealt.
RANGE_MS = 3_600_000


def discontinuity_spans(events: DataFrame, gap_ms: int = 15_000, keys: Sequence[str] = ("symbol",), ts: str = "ts_ms") -> DataFrame:
    """Gaps of at least ``gap_ms`` between consecutive events."""
    rows = with_previous(events.select(*keys, ts), keys, (ts,), (ts,), RANGE_MS)
    spans = rows.select(*keys, F.col(f"prev_{ts}").alias("lo"), F.col(ts).alias("hi")).where(F.col("hi") - F.col("lo") >= gap_ms)
    return spans.withColumn("reason", F.lit("discontinuity"))


def status_spans(status: DataFrame, good: str = "running") -> DataFrame:
    """Intervals in which capture wasn't ``good``: from the first bad row to the next good one; open at the end (``hi`` null)."""
    order = ("updated_at_ms", "state")
    rows = with_previous(status.select("symbol", *order).withColumn("bad", F.col("state") != good), ("symbol",), order, ("bad",), RANGE_MS)
    was_bad = F.coalesce(F.col("prev_bad"), F.lit(False))
    opens = F.when(F.col("bad") & ~was_bad, 1).otherwise(0)
    numbered = with_running_sum(rows, ("symbol",), order, opens, "island", RANGE_MS)
    # The good row that ends an island has its number still.
    ended = F.min(F.when(~F.col("bad") & was_bad, F.col("updated_at_ms")))
    first = F.min(F.when(F.col("bad"), F.struct(*order)))
    spans = numbered.groupBy("symbol", "island").agg(first.alias("first"), ended.alias("hi")).where("first is not null")
    return spans.select("symbol", F.col("first.updated_at_ms").alias("lo"), "hi", F.col("first.state").alias("reason"))


def rollover_events(rows: DataFrame, bucket: Column, keys: Sequence[str] = ("symbol", "venue"), ts: str = "ts_ms") -> DataFrame:
    """Rows that open a new period against the key's row before."""
    both = with_previous(rows.withColumn("bucket_ms", bucket), keys, (ts, "trade_id"), ("bucket_ms",), RANGE_MS)
    return both.withColumnRenamed("prev_bucket_ms", "previous_bucket").where("previous_bucket is not null and previous_bucket <> bucket_ms")


def freshness_flag(rows: DataFrame, ts: str, now: Column, fresh_ms: int) -> DataFrame:
    """Age and whether it lies in [0, fresh_ms]; rows from the future are stale."""
    return rows.withColumn("age_ms", now - F.col(ts)).withColumn("is_fresh", F.coalesce(F.col("age_ms").between(0, fresh_ms), F.lit(False)))


def latest_age(expected: DataFrame, latest: DataFrame, keys: Sequence[str], ts: str, now: Column) -> DataFrame:
    """All expected keys with the age of their latest row; missing ones are shown as unavailable."""
    return expected.join(latest.select(*keys, ts), list(keys), "left").select(*keys, F.col(ts).isNotNull().alias("available"), (now - F.col(ts)).alias("age_ms"))


def contract_check(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add ``violations``: the required columns that are null, and ``is_valid``."""
    return rows.withColumn("violations", reasons(*[(F.col(c).isNull(), f"missing {c}") for c in required])).withColumn("is_valid", F.size("violations") == 0)


def dependency_asof(results: DataFrame, upstream: DataFrame, stale_ms: int) -> DataFrame:
    """Each result with the latest upstream row at or before it; unusable if there is none or it is stale.

    ``results``: symbol, ts_ms; ``upstream``: symbol, ts_ms, value. A union in
    time order, so no pair of rows is formed.
    """
    both = results.select("symbol", "ts_ms", F.lit(1).alias("is_probe"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("up_ts")).unionByName(
        upstream.select("symbol", "ts_ms", F.lit(0).alias("is_probe"), "value", F.col("ts_ms").alias("up_ts"))
    )
    order = Window.partitionBy("symbol").orderBy("ts_ms", "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("symbol", "ts_ms", "is_probe", F.last("value", ignorenulls=True).over(order).alias("value"), F.last("up_ts", ignorenulls=True).over(order).alias("up_ts"))
    usable = F.coalesce(F.col("ts_ms") - F.col("up_ts") <= stale_ms, F.lit(False))
    return seen.where("is_probe = 1").select("symbol", "ts_ms", "value", "up_ts", usable.alias("usable"))


def live_price(keys: DataFrame, mark: DataFrame, evidence: DataFrame, quotes: DataFrame) -> DataFrame:
    """The first price there is of mark, evidence and quote mid (each ``symbol, price``), with its source."""
    j = keys.join(mark.withColumnRenamed("price", "mark"), "symbol", "left").join(evidence.withColumnRenamed("price", "evidence"), "symbol", "left").join(quotes.withColumnRenamed("price", "mid"), "symbol", "left")
    return j.select("symbol", F.coalesce("mark", "evidence", "mid").alias("price"), labelled((F.col("mark").isNotNull(), "mark"), (F.col("evidence").isNotNull(), "evidence"), (F.col("mid").isNotNull(), "book_mid")).alias("price_source"))


NATIVE_HORIZONS, LONG_HORIZONS = (1_000, 5_000, 30_000, 60_000), (900_000, 3_600_000, 14_400_000)


def classify_horizon(horizon_ms: Column) -> Column:
    return labelled((horizon_ms.isin(*NATIVE_HORIZONS), "native"), (horizon_ms.isin(*LONG_HORIZONS), "long"), default="unsupported")


def base_asset(symbol: Column, quotes: Sequence[str] = ("USDT", "USDC", "BUSD", "USD")) -> Column:
    """The symbol without its quote currency, in lower case."""
    return F.lower(F.regexp_replace(F.upper(symbol), f"(?:{'|'.join(quotes)})$", ""))
