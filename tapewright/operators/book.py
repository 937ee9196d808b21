"""Order-book operators over levels ``symbol, snapshot_id, side, price_ticks, price, qty``.

All work a snapshot (``KEYS``) at a time, for all snapshots in one plan. Price
ranges are in ticks of ``TICK``, so limits are exact. ``prices`` tables hold one
reference price a snapshot: ``symbol, snapshot_id, price``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import count_if, labelled, ratio, sum_if
from tapewright.functions.ranges import joined_by_key

KEYS = ("symbol", "snapshot_id")
TICK = 0.01


def ticks(x: float) -> int:
    return round(x / TICK)


def is_bid() -> Column:
    return F.col("side") == "bid"


def is_ask() -> Column:
    return F.col("side") == "ask"


def notional() -> Column:
    return F.col("price") * F.col("qty")


def price_ticks() -> Column:
    """The reference price in ticks, halves kept."""
    return F.round(F.col("ref_price") / TICK, 4)


def with_price(levels: DataFrame, prices: DataFrame) -> DataFrame:
    """Levels with their snapshot's reference price as ``ref_price``."""
    return levels.join(prices.select(*KEYS, F.col("price").alias("ref_price")), list(KEYS))


def mid_prices(levels: DataFrame) -> DataFrame:
    """Mid of the best levels, else the only side there is."""
    best = levels.groupBy(*KEYS).agg(F.max(F.when(is_bid(), F.col("price"))).alias("best_bid"), F.min(F.when(is_ask(), F.col("price"))).alias("best_ask"))
    return best.withColumn("price", F.coalesce((F.col("best_bid") + F.col("best_ask")) / 2, "best_bid", "best_ask"))


def ranked_levels(levels: DataFrame) -> DataFrame:
    """Add ``level_rank``, 1 at the best price of each side."""
    best_first = Window.partitionBy(*KEYS, "side").orderBy(F.when(is_bid(), -F.col("price_ticks")).otherwise(F.col("price_ticks")))
    return levels.withColumn("level_rank", F.row_number().over(best_first))


def top_levels(levels: DataFrame, n: int = 20) -> DataFrame:
    return ranked_levels(levels).where(F.col("level_rank") <= n)


def valid_levels(levels: DataFrame) -> DataFrame:
    """Levels whose price and quantity parse as positive numbers; works on text columns too."""
    price, qty = F.col("price").try_cast("double"), F.col("qty").try_cast("double")
    return levels.where((price > 0) & (qty > 0)).withColumn("price", price).withColumn("qty", qty)


def significant_levels(levels: DataFrame, min_qty: float) -> DataFrame:
    return levels.where(F.col("qty") >= min_qty).withColumn("notional", notional())


def first_significant_floors(levels: DataFrame, prices: DataFrame, min_qty: float, keep: int = 5) -> DataFrame:
    """The ``keep`` lowest significant bids of a snapshot; a snapshot without any has its price as the one floor."""
    rising = Window.partitionBy(*KEYS).orderBy("price_ticks")
    floors = levels.where(is_bid() & (F.col("qty") >= min_qty) & (F.col("price") > 0)).select(
        *KEYS, F.row_number().over(rising).alias("rank"), F.col("price").alias("floor")
    )
    return prices.join(floors.where(F.col("rank") <= keep), list(KEYS), "left").select(
        *KEYS, F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("floor", "price").alias("floor")
    )


def book_summary(levels: DataFrame, depth: int = 20) -> DataFrame:
    """Best prices, spread, notional imbalance and microprice skew of the top levels; rows of one-sided books too."""
    top = top_levels(levels, depth)
    first = F.col("level_rank") == 1

    def at_best(side: Column, c: str) -> Column:
        return F.max(F.when(side & first, F.col(c)))

    s = top.groupBy(*KEYS).agg(
        at_best(is_bid(), "price").alias("best_bid"), at_best(is_ask(), "price").alias("best_ask"), at_best(is_bid(), "qty").alias("bid_qty"), at_best(is_ask(), "qty").alias("ask_qty"),
        sum_if(is_bid(), notional()).alias("book_bid_notional"), sum_if(is_ask(), notional()).alias("book_ask_notional"),
        F.least(count_if(is_bid()), count_if(is_ask())).alias("book_levels"),
    )
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    micro = ratio(F.col("best_ask") * F.col("bid_qty") + F.col("best_bid") * F.col("ask_qty"), F.col("bid_qty") + F.col("ask_qty"))
    spread = F.col("best_ask") - F.col("best_bid")
    both = F.col("book_bid_notional") + F.col("book_ask_notional")
    return s.select(
        *KEYS, "best_bid", "best_ask", spread.alias("spread"), (spread / mid * 10_000).alias("spread_bps"),
        ratio(F.col("book_bid_notional") - F.col("book_ask_notional"), both).alias("obi"), micro.alias("microprice"),
        ((micro / mid - 1.0) * 10_000).alias("micro_price_skew_bps"), "book_levels", "book_bid_notional", "book_ask_notional",
    )


def rolling_density(levels: DataFrame, width: float = 0.20) -> DataFrame:
    """Quantity and notional in ``[p - width, p]`` of a bid and ``[p, p + width]`` of an ask."""
    w, by = ticks(width), Window.partitionBy(*KEYS, "side").orderBy("price_ticks")
    below, above = by.rangeBetween(-w, 0), by.rangeBetween(0, w)
    pick = lambda v: F.when(is_bid(), F.sum(v).over(below)).otherwise(F.sum(v).over(above))
    return levels.select(*KEYS, "side", "price_ticks", "price", "qty", pick(F.col("qty")).alias("window_qty"), pick(notional()).alias("notional"))


def top_density_windows(levels: DataFrame, width: float = 0.20, top_n: int = 10) -> DataFrame:
    """The densest windows of each side, ties to the lowest price."""
    dense = Window.partitionBy(*KEYS, "side").orderBy(F.col("window_qty").desc(), "price_ticks")
    return rolling_density(levels, width).withColumn("rank", F.row_number().over(dense)).where(F.col("rank") <= top_n)


def find_keystone(levels: DataFrame, prices: DataFrame, width: float = 0.20, lo: float = -0.30, hi: float = -0.05) -> DataFrame:
    """The bid with the densest window below it, in a band under the price; without one, the band's lower limit.

    Ties go to the highest bid, the first in book order.
    """
    dense = with_price(rolling_density(levels.where(is_bid()), width), prices)
    off = F.col("price_ticks") - price_ticks()
    found = dense.where(off.between(ticks(lo), ticks(hi))).groupBy(*KEYS).agg(F.max(F.struct("window_qty", "price_ticks")).alias("b"))
    keystone = F.coalesce(F.col("b.price_ticks") * TICK, F.col("price") + lo)
    return prices.join(found, list(KEYS), "left").select(
        *KEYS, "price", keystone.alias("keystone"), F.coalesce("b.window_qty", F.lit(0.0)).alias("window_qty"),
        (keystone - 0.05).alias("tight_lo"), (keystone + 0.05).alias("tight_hi"), (keystone - 0.10).alias("wide_lo"), (keystone + 0.10).alias("wide_hi"),
    )


def find_walls(levels: DataFrame, prices: DataFrame, lo: float = 0.05, hi: float = 1.0, window: float = 0.10, top_n: int = 5) -> DataFrame:
    """The densest ask clusters centred on a level, at a distance above the price; ties to the lowest."""
    half = Window.partitionBy(*KEYS).orderBy("price_ticks").rangeBetween(-ticks(window / 2), ticks(window / 2))
    asks = with_price(levels.where(is_ask()).withColumn("cluster_qty", F.sum("qty").over(half)), prices)
    dense = Window.partitionBy(*KEYS).orderBy(F.col("cluster_qty").desc(), "price_ticks")
    near = asks.where((F.col("price_ticks") - price_ticks()).between(ticks(lo), ticks(hi)))
    return near.select(*KEYS, F.row_number().over(dense).alias("rank"), "price", F.col("cluster_qty").alias("qty")).where(F.col("rank") <= top_n)


def zone_depth(levels: DataFrame, prices: DataFrame, lo: float = -0.5, hi: float = 0.5) -> DataFrame:
    """Quantity and notional of both sides from ``lo`` to ``hi`` around the price."""
    near = with_price(levels, prices).where((F.col("price_ticks") - price_ticks()).between(ticks(lo), ticks(hi)))
    sums = near.groupBy(*KEYS).agg(
        sum_if(is_bid(), "qty").alias("bid_qty"), sum_if(is_ask(), "qty").alias("ask_qty"),
        sum_if(is_bid(), notional()).alias("bid_notional"), sum_if(is_ask(), notional()).alias("ask_notional"),
    )
    names = ["bid_qty", "ask_qty", "bid_notional", "ask_notional"]
    out = prices.join(sums, list(KEYS), "left").select(*KEYS, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return out.withColumn("net_qty", F.col("bid_qty") - F.col("ask_qty")).withColumn("net_notional", F.col("bid_notional") - F.col("ask_notional"))


def grid(prices: DataFrame, first: Column, steps: int, name: str) -> DataFrame:
    """One row for each of ``steps`` consecutive zone numbers from ``first``."""
    return prices.select(*KEYS, F.col("price").alias("ref_price")).withColumn(name, F.explode(F.sequence(first, first + (steps - 1))))


def zone_ratio_grid(levels: DataFrame, prices: DataFrame, lo: float = -0.5, hi: float = 0.5, step: float = 0.05) -> DataFrame:
    """Bid and ask quantity of each zone of width ``step``, empty zones too; a flag where one side is three times the other.

    The grid starts at the multiple of ``step`` nearest to price + lo.
    """
    s = ticks(step)
    first = F.rint((price_ticks() + ticks(lo)) / s).cast("long")
    zones = grid(prices, first, round((hi - lo) / step) + 1, "zone")
    sums = levels.groupBy(*KEYS, F.floor(F.col("price_ticks") / s).alias("zone")).agg(sum_if(is_bid(), "qty").alias("b"), sum_if(is_ask(), "qty").alias("a"))
    b, a = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return zones.join(sums, [*KEYS, "zone"], "left").select(
        *KEYS, "zone", (F.col("zone") * step).alias("lo"), b.alias("bid_qty"), a.alias("ask_qty"), (b - a).alias("net"), ratio(b, a).alias("ratio"),
        labelled((b > a * 3, "BID"), (a > b * 3, "ASK"), default="").alias("flag"),
    )


def range_imbalance(levels: DataFrame, prices: DataFrame, half_range: float = 0.75, step: float = 0.10) -> DataFrame:
    """Per band of width ``step`` around the price: bid and ask quantity and their signed imbalance; empty bands give 0."""
    s, half = ticks(step), ticks(half_range)
    first = F.floor((price_ticks() - half) / s).cast("long")
    last = F.floor((price_ticks() + half) / s).cast("long")
    bands = prices.select(*KEYS, F.col("price").alias("ref_price")).withColumn("band", F.explode(F.sequence(first, last)))
    sums = levels.groupBy(*KEYS, F.floor(F.col("price_ticks") / s).alias("band")).agg(sum_if(is_bid(), "qty").alias("b"), sum_if(is_ask(), "qty").alias("a"))
    b, a = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return bands.join(sums, [*KEYS, "band"], "left").select(
        *KEYS, "band", b.alias("bid_qty"), a.alias("ask_qty"), F.coalesce(ratio(b - a, b + a), F.lit(0.0)).alias("imbalance")
    )


DELTA_STATES = (
    (1.0, "BUYERS_IN_CONTROL"), (0.25, "BUYERS_FAVORED"), (0.0, "BUYERS_SLIGHTLY_FAVORED"), (-0.25, "SELLERS_SLIGHTLY_FAVORED"), (-1.0, "SELLERS_FAVORED"),
)


def delta_state(delta: Column) -> Column:
    return labelled(*[(delta > least, name) for least, name in DELTA_STATES], default="SELLERS_IN_CONTROL")


def flow_alignment(bars: DataFrame, last_n: int = 3) -> DataFrame:
    """Per symbol of taker bars ``bucket_ms, buy_vol, sell_vol``: alignment (r - 1) / (r + 1) of the last bar's ratio,
    its buy share in percent and that of the last ``last_n`` bars."""
    newest = Window.partitionBy("symbol").orderBy(F.col("bucket_ms").desc())
    ranked = bars.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= last_n)
    one = F.col("n") == 1
    sums = ranked.groupBy("symbol").agg(
        sum_if(one, "buy_vol").alias("b"), sum_if(one, "sell_vol").alias("s"), F.sum("buy_vol").alias("bn"), F.sum("sell_vol").alias("sn")
    )
    b, s = F.col("b"), F.col("s")
    return sums.select(
        "symbol", F.coalesce(ratio(b - s, b + s), F.lit(0.0)).alias("flow_alignment"), ratio(b * 100, b + s).alias("tbr_last_pct"),
        ratio(F.col("bn") * 100, F.col("bn") + F.col("sn")).alias("tbr_3avg_pct"),
    )


def delta_variable(levels: DataFrame, prices: DataFrame, bars: DataFrame, half_range: float = 0.75, step: float = 0.10) -> DataFrame:
    """Wall imbalance plus flow alignment, from -2 to 2, with its state."""
    per = range_imbalance(levels, prices, half_range, step).groupBy(*KEYS).agg(
        F.sum("bid_qty").alias("bid_qty"), F.sum("ask_qty").alias("ask_qty"), F.sum("imbalance").alias("sum_imbalance"), F.count("*").alias("n_bands")
    )
    wall = F.coalesce(ratio(F.col("bid_qty") - F.col("ask_qty"), F.col("bid_qty") + F.col("ask_qty")), F.lit(0.0))
    joined = per.join(flow_alignment(bars), "symbol", "left").withColumn("flow_alignment", F.coalesce("flow_alignment", F.lit(0.0)))
    delta = wall + F.col("flow_alignment")
    return joined.select(
        *KEYS, "n_bands", wall.alias("wall_imbalance"), "flow_alignment", delta.alias("delta"), (F.col("sum_imbalance") + F.col("flow_alignment")).alias("delta_raw"),
        "tbr_last_pct", "tbr_3avg_pct", delta_state(delta).alias("state"),
    )


def depth_imbalance_slices(levels: DataFrame, depths: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Quantity imbalance of the top levels, by depth and in total."""
    ranked = ranked_levels(levels)

    def obi(keep: Column) -> Column:
        b, a = sum_if(is_bid() & keep, "qty"), sum_if(is_ask() & keep, "qty")
        return F.when(b + a > 0, (b - a) / (b + a))

    return ranked.groupBy(*KEYS).agg(*[obi(F.col("level_rank") <= d).alias(f"obi_{d}") for d in depths], obi(F.lit(True)).alias("obi_total"))


@dataclass(frozen=True)
class Tiers:
    """Lower limits of the tiers above ``small``."""

    mega: float = 250_000.0
    large: float = 50_000.0
    medium: float = 10_000.0

    def of(self, size: Column) -> Column:
        return labelled((size >= self.mega, "mega"), (size >= self.large, "large"), (size >= self.medium, "medium"), default="small")


QTY_TIERS = Tiers(5000.0, 1000.0, 200.0)
TIER_NAMES = ("mega", "large", "medium", "small")


def bid_tiers(levels: DataFrame, tiers: Tiers, by_notional: bool = True) -> DataFrame:
    """Count, quantity, notional and share of quantity of each bid tier, a column each."""
    size = notional() if by_notional else F.col("qty")
    bids = levels.where(is_bid() & (F.col("qty") > 0) & (F.col("price") > 0)).withColumn("tier", tiers.of(size))
    sums = [F.sum("qty").alias("total_qty"), F.sum(notional()).alias("total_notional")]
    for t in TIER_NAMES:
        own = F.col("tier") == t
        sums += [count_if(own).alias(f"{t}_count"), sum_if(own, "qty").alias(f"{t}_qty"), sum_if(own, notional()).alias(f"{t}_notional")]
    out = bids.groupBy(*KEYS).agg(*sums)
    return out.select("*", *[(F.col(f"{t}_qty") / F.col("total_qty") * 100).alias(f"{t}_pct") for t in TIER_NAMES])


def tier_balance(levels: DataFrame, mega_usd: float, bias: float = 1.2) -> DataFrame:
    """Quantity of the largest levels, bids against asks; the ratio is null where there are no such asks."""
    big = notional() >= mega_usd
    s = levels.groupBy(*KEYS).agg(
        sum_if(is_bid() & big, "qty").alias("mega_bids"), sum_if(is_ask() & big, "qty").alias("mega_asks"),
        sum_if(is_bid(), "qty").alias("total_bids"), sum_if(is_ask(), "qty").alias("total_asks"),
    )
    b, a = F.col("mega_bids"), F.col("mega_asks")
    heavy = labelled(
        ((a == 0) & (b > 0), "INSTITUTIONAL-BID-HEAVY"), ((b == 0) & (a > 0), "INSTITUTIONAL-ASK-HEAVY"), (a == 0, "BALANCED"),
        (b > a * bias, "INSTITUTIONAL-BID-HEAVY"), (b * bias < a, "INSTITUTIONAL-ASK-HEAVY"), default="BALANCED",
    )
    return s.select(*KEYS, "mega_bids", "mega_asks", (b - a).alias("delta"), ratio(b, a).alias("ratio"), heavy.alias("verdict"), "total_bids", "total_asks")


def mega_at_keystone(levels: DataFrame, keystones: DataFrame, mega_usd: float, tol: float = 0.10) -> DataFrame:
    """The largest bids within ``tol`` of the keystone; a row a snapshot, also without any."""
    near = levels.where(is_bid() & (notional() >= mega_usd)).join(keystones.select(*KEYS, "keystone"), list(KEYS))
    off = F.abs(F.col("price_ticks") - F.round(F.col("keystone") / TICK, 4))
    sums = near.where(off <= ticks(tol)).groupBy(*KEYS).agg(F.count("*").alias("c"), F.sum("qty").alias("q"), F.sum(notional()).alias("n"))
    return keystones.select(*KEYS, "keystone").join(sums, list(KEYS), "left").select(
        *KEYS, "keystone", F.coalesce("c", F.lit(0)).cast("long").alias("count"), F.coalesce("q", F.lit(0.0)).alias("qty"), F.coalesce("n", F.lit(0.0)).alias("notional")
    )


def absorption_ladder(levels: DataFrame, prices: DataFrame, count: int = 15, nearest: bool = False) -> DataFrame:
    """Running bid quantity below the price over ``count`` levels: the lowest first, or with ``nearest`` the highest first."""
    order = Window.partitionBy(*KEYS).orderBy(F.col("price_ticks").desc() if nearest else F.col("price_ticks"))
    below = with_price(levels.where(is_bid()), prices).where(F.col("price_ticks") < price_ticks())
    return below.select(
        *KEYS, F.row_number().over(order).alias("rank"), "price", "qty", F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_qty")
    ).where(F.col("rank") <= count)


def keystone_bid_stack(levels: DataFrame, keystones: DataFrame, tol: float = 0.05) -> DataFrame:
    """Bids around the keystone with their zone and, in the tight zone, running quantity and notional from the lowest up.

    Zones: ``below`` from six tolerances under the keystone, ``at``, and ``above`` to three over it.
    """
    near = levels.where(is_bid()).join(keystones.select(*KEYS, "keystone"), list(KEYS))
    off, t = F.col("price_ticks") - F.round(F.col("keystone") / TICK, 4), ticks(tol)
    rows = near.withColumn("off", off).where(F.col("off").between(-6 * t, 3 * t))
    tight = F.abs(F.col("off")) <= t
    up = Window.partitionBy(*KEYS).orderBy("price_ticks").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *KEYS, "price", "qty", labelled((F.col("off") < 0, "below"), (F.col("off") > 0, "above"), default="at").alias("zone"), tight.alias("is_tight"),
        F.when(tight, F.sum(F.when(tight, F.col("qty"))).over(up)).alias("cum_qty"), F.when(tight, F.sum(F.when(tight, notional())).over(up)).alias("cum_notional"),
    )


def ask_wall_ladder(levels: DataFrame, prices: DataFrame, step: float = 0.05, buckets: int = 60) -> DataFrame:
    """Ask depth of each bucket of width ``step`` above the price, with the running notional; empty buckets too."""
    s = ticks(step)
    zones = grid(prices, F.lit(0).cast("long"), buckets + 1, "zone")
    asks = with_price(levels.where(is_ask()), prices).where(F.col("price_ticks") >= price_ticks())
    sums = asks.groupBy(*KEYS, F.floor((F.col("price_ticks") - price_ticks()) / s).alias("zone")).agg(F.count("*").alias("c"), F.sum("qty").alias("q"), F.sum(notional()).alias("n"))
    up = Window.partitionBy(*KEYS).orderBy("zone").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce("n", F.lit(0.0))
    return zones.join(sums, [*KEYS, "zone"], "left").select(
        *KEYS, "zone", (F.col("ref_price") + F.col("zone") * step).alias("lo"), F.coalesce("c", F.lit(0)).cast("long").alias("n_levels"),
        F.coalesce("q", F.lit(0.0)).alias("qty"), n.alias("notional"), F.sum(n).over(up).alias("cum_notional"),
    )


def round_anchors(prices: DataFrame, step: float = 0.05, below: int = 4, above: int = 4, tol: float = 0.02) -> DataFrame:
    """Round levels around each price: multiples of ``step`` from ``below`` under the nearest to ``above`` over it."""
    center = F.rint(F.col("price") / step).cast("long")
    made = prices.withColumn("k", F.explode(F.sequence(center - below, center + above)))
    level = F.round(F.col("k") * step, 10)
    return made.select(*KEYS, "k", level.alias("level"), (level - tol).alias("lo"), (level + tol).alias("hi"))


def round_anchor_depth(levels: DataFrame, anchors: DataFrame, step: float = 0.05, tol: float = 0.02) -> DataFrame:
    """Bid quantity and notional within ``tol`` of each anchor; a bid near two anchors counts for both.

    Each bid is joined by equality with the few anchor numbers it can be near.
    """
    s, t = ticks(step), ticks(tol)
    near = F.sequence(F.ceil((F.col("price_ticks") - t) / s), F.floor((F.col("price_ticks") + t) / s))
    reach = levels.where(is_bid() & (F.col("qty") > 0)).withColumn("ks", F.when(F.ceil((F.col("price_ticks") - t) / s) <= F.floor((F.col("price_ticks") + t) / s), near))
    sums = reach.select("*", F.explode("ks").alias("k")).groupBy(*KEYS, "k").agg(F.sum("qty").alias("q"), F.sum(notional()).alias("n"))
    return anchors.join(sums, [*KEYS, "k"], "left").select(
        *KEYS, "k", "level", F.coalesce("q", F.lit(0.0)).alias("qty"), F.coalesce("n", F.lit(0.0)).alias("notional")
    )


def band_qty(levels: DataFrame, side: str, lo: Column, hi: Column, keys: Sequence[str] = KEYS) -> Column:
    """Aggregate: quantity of a side with ticks from ``lo`` to ``hi``."""
    return sum_if((F.col("side") == side) & (F.col("price_ticks") >= lo) & (F.col("price_ticks") <= hi), "qty")


def wall_fuel_ratio(levels: DataFrame, prices: DataFrame, floor: float = 0.5, target: float = 0.5) -> DataFrame:
    """Bids from the floor up to the price against asks from there to the target; the ratio is null without asks."""
    p = price_ticks()
    s = with_price(levels, prices).groupBy(*KEYS).agg(
        band_qty(levels, "bid", p - ticks(floor), p).alias("bid_pool"), band_qty(levels, "ask", p, p + ticks(target)).alias("ask_pool")
    )
    fuel = (F.col("ask_pool") == 0) | (F.col("bid_pool") > F.col("ask_pool"))
    return s.withColumn("ratio", ratio("bid_pool", "ask_pool")).withColumn("verdict", F.when(fuel, "BUYERS_HAVE_FUEL").otherwise("SELLERS_DOMINATE"))


def path_fuel_ratio(levels: DataFrame, prices: DataFrame, entry: float = 0.5, floor: float = 0.5) -> DataFrame:
    """Asks up to the entry against bids down to the floor, with a verdict in four steps; no asks give a ratio of 999."""
    p = price_ticks()
    to_entry, to_floor = is_ask() & (F.col("price_ticks") <= p + ticks(entry)), is_bid() & (F.col("price_ticks") >= p - ticks(floor))
    s = with_price(levels, prices).groupBy(*KEYS).agg(
        sum_if(to_entry, "qty").alias("required_buy_vol"), sum_if(to_entry, notional()).alias("required_buy_notional"),
        sum_if(to_floor, "qty").alias("available_fuel"), sum_if(to_floor, notional()).alias("available_notional"),
    )
    r = F.coalesce(ratio("available_fuel", "required_buy_vol"), F.lit(999.0))
    steps = lambda *names: labelled((r > 1.5, names[0]), (r >= 1.0, names[1]), (r >= 0.5, names[2]), default=names[3])
    verdict = steps("BUYERS HAVE AMPLE FUEL", "BUYERS CAN REACH", "BUYERS STRUGGLE", "BUYERS EXHAUSTED BEFORE TARGET")
    return s.select("*", r.alias("fuel_ratio"), verdict.alias("verdict"), steps("HIGH", "MEDIUM", "MEDIUM-LOW", "HIGH").alias("confidence"))


def path_ascent(levels: DataFrame, prices: DataFrame, step: float = 0.10, steps: int = 10, floor: float = 0.5) -> DataFrame:
    """At each level above the price: asks to absorb against all bids down to the floor.

    Asks are summed by step and accumulated, so no level meets every ask.
    """
    p, s = price_ticks(), ticks(step)
    fuel = with_price(levels, prices).groupBy(*KEYS).agg(band_qty(levels, "bid", p - ticks(floor), p).alias("bid_fuel"))
    asks = with_price(levels.where(is_ask()), prices)
    number = F.greatest(F.ceil((F.col("price_ticks") - p) / s), F.lit(0)).cast("long")
    sums = asks.groupBy(*KEYS, number.alias("n")).agg(F.sum("qty").alias("q"))
    up = Window.partitionBy(*KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    walk = grid(prices, F.lit(0).cast("long"), steps + 1, "n").join(sums, [*KEYS, "n"], "left").withColumn("asks_to_absorb", F.sum(F.coalesce("q", F.lit(0.0))).over(up))
    left = F.col("bid_fuel") - F.col("asks_to_absorb")
    return walk.join(fuel, list(KEYS)).where("n > 0").select(
        *KEYS, "n", (F.col("ref_price") + F.col("n") * step).alias("level"), "asks_to_absorb", left.alias("bid_fuel_remaining"),
        F.when(left > 0, "BUYERS_REACH").otherwise("BUYERS_EXHAUSTED").alias("verdict"),
    )


def path_descent(levels: DataFrame, prices: DataFrame, step: float = 0.10, steps: int = 10, reach: float = 0.5) -> DataFrame:
    """At each level below the price: bids to absorb against all asks up to ``reach``."""
    p, s = price_ticks(), ticks(step)
    fuel = with_price(levels, prices).groupBy(*KEYS).agg(
        band_qty(levels, "ask", p, p + ticks(reach)).alias("ask_fuel"), band_qty(levels, "bid", p - ticks(reach), p).alias("bid_fuel")
    )
    number = F.greatest(F.ceil((p - F.col("price_ticks")) / s), F.lit(0)).cast("long")
    sums = with_price(levels.where(is_bid()), prices).groupBy(*KEYS, number.alias("n")).agg(F.sum("qty").alias("q"))
    up = Window.partitionBy(*KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    walk = grid(prices, F.lit(0).cast("long"), steps + 1, "n").join(sums, [*KEYS, "n"], "left").withColumn("bids_to_absorb", F.sum(F.coalesce("q", F.lit(0.0))).over(up))
    left = F.col("ask_fuel") - F.col("bids_to_absorb")
    verdict = labelled(((left > 0) & (F.col("bids_to_absorb") < F.col("bid_fuel") * 0.6), "SHORT VALID"), (left > 0, "SHORT OK (tight)"), default="SQUEEZE RISK")
    return walk.join(fuel, list(KEYS)).where("n > 0").select(
        *KEYS, "n", (F.col("ref_price") - F.col("n") * step).alias("level"), "bids_to_absorb", left.alias("ask_fuel_remaining"), verdict.alias("verdict")
    )


def fall_short_level(ascent: DataFrame) -> DataFrame:
    """The first level at which the fuel is used up; null where it never is."""
    return ascent.groupBy(*KEYS).agg(F.min_by("level", F.when(F.col("bid_fuel_remaining") < 0, F.col("n"))).alias("fall_short_level"))


def wall_concentration(levels: DataFrame, prices: DataFrame, lo: float = 0.1, hi: float = 0.5, entry: float = 0.5) -> DataFrame:
    """Asks of a zone above the price, in percent of what is needed to reach the entry."""
    p = price_ticks()
    zone = is_ask() & (F.col("price_ticks") - p).between(ticks(lo), ticks(hi))
    s = with_price(levels, prices).groupBy(*KEYS).agg(
        sum_if(zone, "qty").alias("qty"), count_if(zone).alias("levels"), sum_if(zone, notional()).alias("notional"),
        sum_if(is_ask() & (F.col("price_ticks") <= p + ticks(entry)), "qty").alias("required"),
    )
    return s.withColumn("pct_of_required", ratio(F.col("qty") * 100, "required")).withColumn("heavy_wall", (F.col("required") > 0) & (F.col("qty") > F.col("required") * 0.5))


def densest_clusters(levels: DataFrame, floors: DataFrame, window: float = 0.10) -> DataFrame:
    """Bid quantity from each floor up to ``window`` above it, densest first, ties to the lowest floor.

    A floor (``symbol, snapshot_id, floor``) and a bid meet by bins as wide as the window.
    """
    w = ticks(window)
    f = floors.select(*KEYS, "floor", F.round(F.col("floor") / TICK).cast("long").alias("ft")).distinct()
    binned = f.withColumn("bin", F.explode(F.array(F.floor(F.col("ft") / w), F.floor(F.col("ft") / w) + 1)))
    bids = levels.where(is_bid()).select(*KEYS, F.floor(F.col("price_ticks") / w).alias("bin"), "price_ticks", "qty")
    near = binned.join(bids, [*KEYS, "bin"]).where((F.col("price_ticks") >= F.col("ft")) & (F.col("price_ticks") <= F.col("ft") + w))
    sums = near.groupBy(*KEYS, "ft").agg(F.sum("qty").alias("q"))
    order = Window.partitionBy(*KEYS).orderBy(F.col("qty").desc(), "lo")
    return f.join(sums, [*KEYS, "ft"], "left").select(*KEYS, F.col("floor").alias("lo"), (F.col("floor") + window).alias("hi"), F.coalesce("q", F.lit(0.0)).alias("qty")).withColumn(
        "rank", F.row_number().over(order)
    )


def level_absorption(levels: DataFrame, anchors: DataFrame, sizes: Sequence[float] = (1000.0, 5000.0, 10000.0)) -> DataFrame:
    """What percentage of the bids at each anchor a sale of each size takes; ``no_bid`` where there are none."""
    depth = round_anchor_depth(levels, anchors, tol=0.01)
    out = depth.select(*KEYS, "k", "level", "qty", (F.col("qty") == 0).alias("no_bid"))
    return out.select("*", *[ratio(F.lit(s * 100), "qty").alias(f"absorbed_pct_{int(s)}") for s in sizes])


def keystone_wall_balance(levels: DataFrame, keystones: DataFrame, zone: float = 0.10, wall_lo: float = 0.10, wall_hi: float = 0.50) -> DataFrame:
    """Bids around the keystone against asks of the seller zone above the price."""
    near = levels.join(keystones.select(*KEYS, "keystone", F.col("price").alias("ref_price")), list(KEYS))
    kz = is_bid() & (F.abs(F.col("price_ticks") - F.round(F.col("keystone") / TICK, 4)) <= ticks(zone))
    sw = is_ask() & (F.col("price_ticks") - price_ticks()).between(ticks(wall_lo), ticks(wall_hi))
    s = near.groupBy(*KEYS).agg(
        sum_if(kz, "qty").alias("keystone_qty"), sum_if(kz, notional()).alias("keystone_notional"), sum_if(sw, "qty").alias("wall_qty"), sum_if(sw, notional()).alias("wall_notional")
    )
    return s.withColumn("qty_ratio", F.col("keystone_qty") / F.greatest("wall_qty", F.lit(1e-9))).withColumn(
        "notional_ratio", F.col("keystone_notional") / F.greatest("wall_notional", F.lit(1e-9))
    )


def adjacent_wall_counts(levels: DataFrame, factor: float = 1.15) -> DataFrame:
    """Asks at least ``factor`` times, or at most its inverse of, the ask below them."""
    before = F.lag("qty").over(Window.partitionBy(*KEYS).orderBy("price_ticks"))
    asks = levels.where(is_ask()).select(*KEYS, "qty", before.alias("prev"))
    known = F.col("prev") > 0
    return asks.groupBy(*KEYS).agg(
        count_if(known & (F.col("qty") >= F.col("prev") * factor)).alias("walls_built"), count_if(known & (F.col("qty") <= F.col("prev") / factor)).alias("walls_eroded")
    )


def accumulate_prior_walls(walls: DataFrame) -> DataFrame:
    """All wall levels ever recorded (``symbol, cycle, price_ticks, qty``), each with its newest quantity."""
    return walls.groupBy("symbol", "price_ticks").agg(F.max_by("qty", F.struct("cycle", "qty")).alias("qty"), F.max("cycle").alias("last_cycle"))


def wall_delta(prior: DataFrame, levels: DataFrame, window: float = 0.02, threshold: float = 1.15) -> DataFrame:
    """Earlier wall levels (``symbol, price_ticks, qty``) against the asks now at and within half a window of them.

    ``levels`` hold one snapshot a symbol. Bins one window wide bring near levels together.
    """
    half = max(1, ticks(window / 2))
    probes = prior.select("symbol", F.col("price_ticks").alias("wall"), F.col("qty").alias("prior"))
    reach = probes.withColumn("t", F.explode(F.sequence(F.col("wall") - half, F.col("wall") + half)))
    asks = levels.where(is_ask()).select("symbol", F.col("price_ticks").alias("t"), "qty")
    now = reach.join(asks, ["symbol", "t"], "left").groupBy("symbol", "wall", "prior").agg(
        sum_if((F.col("t") == F.col("wall")) & F.col("qty").isNotNull(), "qty").alias("current_exact"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("current_window")
    )
    return now.withColumn("delta_window", F.col("current_window") - F.col("prior")).withColumn(
        "direction",
        labelled((F.col("current_window") > F.col("prior") * threshold, "BUILT UP"), (F.col("current_window") < F.col("prior") / threshold, "ERODED"), default="STABLE"),
    )


def wall_set_diff(walls: DataFrame) -> DataFrame:
    """Walls (``symbol, snapshot_id, price_ticks``) that formed or were absorbed against the symbol's snapshot before."""
    snaps = walls.select("symbol", "snapshot_id").distinct()
    chain = snaps.withColumn("prev_id", F.lag("snapshot_id").over(Window.partitionBy("symbol").orderBy("snapshot_id"))).where("prev_id is not null")
    now = chain.join(walls, ["symbol", "snapshot_id"]).select("symbol", "snapshot_id", "price_ticks", F.lit(True).alias("is_now"))
    was = chain.join(walls.withColumnRenamed("snapshot_id", "prev_id"), ["symbol", "prev_id"]).select("symbol", "snapshot_id", "price_ticks", F.lit(True).alias("was"))
    both = now.join(was, ["symbol", "snapshot_id", "price_ticks"], "full_outer")
    event = labelled((F.col("was").isNull(), "wall_formed"), (F.col("is_now").isNull(), "wall_absorbed"))
    return both.select("symbol", "snapshot_id", "price_ticks", event.alias("event")).where("event is not null")


def ladder_l2(levels: DataFrame, n: int = 5) -> DataFrame:
    """The top levels of both sides as sorted arrays, best first."""
    top = top_levels(levels, n)
    side = lambda s: F.array_sort(F.collect_list(F.when(s, F.struct("level_rank", "price", "qty"))))
    return top.groupBy(*KEYS).agg(side(is_bid()).alias("bids"), side(is_ask()).alias("asks"))


def wall_trap(fuel: DataFrame, counts: DataFrame) -> DataFrame:
    """Chance that buyers absorb the asks, and the trap flag, from fuel ratio and wall counts."""
    r, built = F.col("ratio"), F.col("walls_built")
    prob = F.when((r > 1.5) & (built <= 1), 0.65).when((r > 1.2) & (built <= 2), 0.55).when(r > 1.0, 0.45).otherwise(0.30)
    return fuel.join(counts, list(KEYS)).select(*KEYS, "ratio", "walls_built", "walls_eroded", prob.alias("probability_absorb"), ((built >= 3) | (r < 1.0)).alias("trap_down"))


def wall_band(prices: DataFrame, floor_bps: float = 30.0, ceiling_bps: float = 100.0, max_bps: float = 300.0) -> DataFrame:
    """Floor, entry and target around the price, wider with volatility (``atr_pct``; null or not positive: the floor)."""
    top = min(max_bps, ceiling_bps * 3)
    atr = F.col("atr_pct")
    bps = F.when(atr >= 2.0, top).when(atr > 0.5, floor_bps + (atr - 0.5) / 1.5 * (top - floor_bps)).otherwise(floor_bps)
    source = labelled((atr.isNull() | (atr <= 0), "default_floor"), (atr >= 2.0, "atr_ceiling"), (atr <= 0.5, "atr_floor"), default="atr_linear")
    p = F.col("price")
    return prices.select(*KEYS, "price", "atr_pct", bps.alias("band_bps"), source.alias("scaling_source"), (p * (1 - bps / 10_000)).alias("bid_floor"), p.alias("entry"), (p * (1 + bps / 10_000)).alias("ask_target"))


SCORE_LADDERS = {
    "bid_ask_qty_ratio": (">", 0.5, 0.3), "taker_buy_trend": (">", 0.55, 0.50), "oi_change_trend": (">", 0.0, -0.1),
    "top_long_drift": ("<", 0.75, 0.80), "net_buy_trend": (">", 0.55, 0.50),
}


def keystone_scorecard(inputs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Score from 0 to 10 that a keystone holds: each factor gives 2, 1 or 0 by its ladder, times its weight.

    ``inputs`` has a column a factor besides its keys; a null factor gives 0.
    """
    w = dict.fromkeys(SCORE_LADDERS, 1.0) | {k: v for k, v in (weights or {}).items() if k in SCORE_LADDERS}
    score = F.lit(0.0)
    for name, (op, first, second) in SCORE_LADDERS.items():
        over = lambda x, c=F.col(name), up=op == ">": c > x if up else c < x
        score = score + F.when(over(first), 2.0 * w[name]).when(over(second), w[name]).otherwise(0.0)
    most = 2.0 * sum(w.values()) or 10.0
    normal = score / most * 10
    return inputs.select(
        "*", F.round(normal, 2).alias("score"), F.round(score, 4).alias("raw_score"), F.round(normal * 10, 1).alias("holds_probability"),
        F.round(100 - F.round(normal * 10, 1), 1).alias("breaks_probability"),
    )


def keystone_trade_intensity(trades: DataFrame, keystones: DataFrame, min_wide_qty: float = 5.0) -> DataFrame:
    """Taker flow in the tight zone and large buys in the wide one; ``keystones`` has one row a symbol."""
    k = keystones.select("symbol", F.round(F.col("keystone") / TICK, 4).alias("kt"), "keystone")
    off = F.abs(F.col("price_ticks") - F.col("kt"))
    near = joined_by_key(trades, k, ["symbol"]).where(off <= 10)
    buy, tight, n = ~F.col("is_buyer_maker"), off <= 5, F.col("price") * F.col("qty")
    wide = buy & (F.col("qty") >= min_wide_qty)
    return near.groupBy("symbol", "keystone").agg(
        count_if(tight & buy).alias("tight_buy_count"), sum_if(tight & buy, "qty").alias("tight_buy_qty"), sum_if(tight & buy, n).alias("tight_buy_notional"),
        count_if(tight & ~buy).alias("tight_sell_count"), sum_if(tight & ~buy, "qty").alias("tight_sell_qty"), sum_if(tight & ~buy, n).alias("tight_sell_notional"),
        count_if(wide).alias("wide_buy_count"), sum_if(wide, n).alias("wide_buy_notional"),
    )


def zone_buy_sell(trades: DataFrame, lo: float, hi: float, step: float = 0.05) -> DataFrame:
    """Taker flow by nearest sub-zone of a price band."""
    buy = ~F.col("is_buyer_maker")
    near = trades.where(F.col("price_ticks").between(ticks(lo), ticks(hi)))
    out = near.groupBy("symbol", "venue", F.rint(F.col("price") / step).cast("long").alias("zone")).agg(
        sum_if(buy, "qty").alias("buy"), sum_if(~buy, "qty").alias("sell"), count_if(buy).alias("buy_n"), count_if(~buy).alias("sell_n")
    )
    return out.withColumn("net", F.col("buy") - F.col("sell")).withColumn("price", F.round(F.col("zone") * step, 10))
