"""Small column expressions that many operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_if(condition: Column, value: Column | str) -> Column:
    """Sum of the rows that meet the condition, 0 if none does."""
    return F.sum(F.when(condition, col(value)).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(col(b) != 0, col(a) / col(b))


def labelled(*rules: tuple[Column, str | None], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the texts of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in rules]))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def bucket_start(ts_ms: Column | str, width_ms: int, offset_ms: int = 0) -> Column:
    """Start of the bucket, aligned to the epoch shifted by ``offset_ms`` (19,800,000 for UTC+05:30)."""
    ts = col(ts_ms) + offset_ms
    return ts - F.pmod(ts, F.lit(width_ms)) - offset_ms


def nearest_bucket(price: Column | str, size: float) -> Column:
    """Number of the nearest price bucket, halves to the even one."""
    return F.rint(col(price) / size).cast("long")


def is_buy() -> Column:
    """The taker bought: the buyer wasn't the maker."""
    return ~F.col("is_buyer_maker")


def sign_label(value: Column, width: float, up: str = "UP", down: str = "DOWN", flat: str = "FLAT") -> Column:
    return F.when(value > width, up).when(value < -width, down).when(value.isNotNull(), flat)
