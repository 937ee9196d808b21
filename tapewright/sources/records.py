"""Raw records to typed rows: snapshots, trades in several spellings, bars, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_TRADE = "p string, price string, q string, qty string, m boolean, isBuyerMaker boolean, is_buyer_maker boolean, T long, time long, a long, id long, quoteQty string"
_SIDE = "struct<trades_normalized:array<struct<id:bigint,ts:bigint,price:double,qty:double,is_buyer_maker:boolean>>,bids:array<array<double>>,asks:array<array<double>>>"
SNAPSHOT_DDL = f"symbol string, observed_at_ms long, depth_levels int, errors array<string>, spot {_SIDE}, futures {_SIDE}, _corrupt string"
QUOTE_DDL = "ts long, bid string, bidQty string, ask string, askQty string"


def read_snapshots(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, stream: bool = False) -> DataFrame:
    """Nested raw snapshots of a time range from JSON lines; broken rows keep their text in ``_corrupt``."""
    reader = (spark.readStream if stream else spark.read).schema(SNAPSHOT_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.json(path)
    if start_ms is not None:
        rows = rows.where(F.col("observed_at_ms") >= start_ms)
    return rows if end_ms is None else rows.where(F.col("observed_at_ms") < end_ms)


def trades_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """All trades of both venues, with the time of the snapshot that holds them; snapshots overlap."""

    def side(venue: str) -> DataFrame:
        return snapshots.select("symbol", "observed_at_ms", F.lit(venue).alias("venue"), F.explode(F.col(f"{venue}.trades_normalized")).alias("t")).select(
            "symbol", "observed_at_ms", "venue", F.col("t.id").alias("trade_id"), F.col("t.ts").alias("ts_ms"), F.col("t.price").alias("price"), F.col("t.qty").alias("qty"), F.col("t.is_buyer_maker").alias("is_buyer_maker")
        )

    return side("spot").unionByName(side("futures"))


def slim_snapshots(snapshots: DataFrame) -> DataFrame:
    """Only the fields that the stream's consumers read."""
    keep = lambda v: F.struct(F.col(f"{v}.trades_normalized").alias("trades_normalized")).alias(v)
    return snapshots.select("symbol", "observed_at_ms", keep("spot"), keep("futures"))


def normalize_trades(raw: DataFrame, venue: Column) -> tuple[DataFrame, DataFrame]:
    """Typed trades from camelCase and one-letter fields, and the rejected rows (no usable price, quantity or time)."""
    price, qty = F.coalesce("p", "price").try_cast("double"), F.coalesce("q", "qty").try_cast("double")
    maker = F.coalesce("m", "isBuyerMaker", "is_buyer_maker", F.lit(False))
    typed = raw.withColumn("_price", price).withColumn("_qty", qty).withColumn("_ts", F.coalesce("T", "time"))
    good = (F.col("_price") > 0) & (F.col("_qty") > 0) & (F.col("_ts") > 0)
    ok = F.coalesce(good, F.lit(False))
    out = typed.where(ok).select(
        F.coalesce("a", "id").alias("trade_id"), F.col("_ts").alias("ts_ms"), F.col("_price").alias("price"), F.col("_qty").alias("qty"),
        F.coalesce(F.col("quoteQty").try_cast("double"), F.col("_price") * F.col("_qty")).alias("quote_qty"), maker.alias("is_buyer_maker"), F.when(maker, "sell").otherwise("buy").alias("side"), venue.alias("venue"),
    )
    return out, typed.where(~ok).drop("_price", "_qty", "_ts")


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


def normalize_bars(bars: DataFrame, doubles: Sequence[str] = ()) -> DataFrame:
    """camelCase columns in snake_case; the named ones cast to double, null where they don't parse."""
    return bars.select(*[(F.col(c).try_cast("double") if snake(c) in doubles else F.col(c)).alias(snake(c)) for c in bars.columns])


VENUES = {"perps": "futures", "perp": "futures", "fut": "futures", "futures": "futures", "spot": "spot"}


def normalize_identity(rows: DataFrame) -> DataFrame:
    """Upper-case symbols and canonical venues; unknown venues become null."""
    venue = F.element_at(F.create_map(*[F.lit(x) for kv in VENUES.items() for x in kv]), F.lower(F.trim("venue")))
    return rows.withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("venue", venue)


def read_quote_tape(spark: SparkSession, path: str) -> DataFrame:
    """Best-quote rows of a JSON tape (objects or arrays of them, each on a line), prices and quantities as exact decimals."""
    number = lambda c: F.col(c).try_cast("decimal(18,8)")
    return spark.read.schema(QUOTE_DDL).json(path).select(F.col("ts").alias("ts_ms"), number("bid").alias("bid_price"), number("bidQty").alias("bid_qty"), number("ask").alias("ask_price"), number("askQty").alias("ask_qty"))


def headline(doc: DataFrame, names: dict[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """One column a name: the first of its spellings that isn't null; spellings the table lacks are passed over."""
    have = {f.name: f.dataType for f in doc.schema.fields}

    def there(path: str) -> bool:
        head, _, rest = path.partition(".")
        return head in have and (not rest or isinstance(have[head], T.StructType) and rest in have[head].names)

    return doc.select(*keys, *[F.coalesce(*[F.col(p) for p in paths if there(p)], F.lit(None)).alias(name) for name, paths in names.items()])


def ticker_change(rows: DataFrame) -> DataFrame:
    """Change in percent under any of its names, as text or number; unusable values are null."""
    cols = [F.col(c).cast("string").try_cast("double") for c in ("priceChangePercent", "price_change_percent", "change_pct") if c in rows.columns]
    return rows.withColumn("change_pct_24h", F.coalesce(*cols, F.lit(None).cast("double")))


def bound_array(values: Column, cap: int = 128) -> Column:
    """``items`` (the first ``cap``), ``count`` and ``truncated``."""
    return F.struct(F.slice(values, 1, cap).alias("items"), F.size(values).alias("count"), (F.size(values) > cap).alias("truncated"))


def json_safe(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers become null, ready for JSON."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
