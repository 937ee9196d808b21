"""Windows over long keys, cut into ranges of their order, with what lies before a range carried in.

A window that is partitioned by a key alone puts all of a busy key into one
task. Here it is partitioned by the key and a range of a number (time or id);
one row a key and range, a small table, is carried over the ranges' edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def ranged(df: DataFrame, by: str, width: int) -> DataFrame:
    """Add the number of the range that holds ``by``."""
    return df.withColumn(RANGE, F.floor(F.col(by) / width))


def joined_by_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of ``per_key``, a table of one row an instrument (and horizon), which is broadcast.

    Left to its size checks, Spark sorts both sides by key where rows fill less than a fifth of a shuffle's partitions, and a task
    then holds all rows of a busy key.
    """
    return rows.join(F.broadcast(per_key), list(keys))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int, prefix: str = "prev_") -> DataFrame:
    """Add the columns of the key's previous row; ranges are of the first column of ``order``."""
    rows = ranged(df, order[0], width)
    place, values = [*keys, RANGE], F.struct(*columns)
    last = rows.groupBy(*place).agg(F.max_by(values, F.struct(*order)).alias("_last"))
    carried = last.select(*place, F.lag("_last").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_carried"))
    within = F.lag(values).over(Window.partitionBy(*place).orderBy(*order))
    found = rows.withColumn("_within", within).join(carried, place)
    # A range's first row has no row within it; the columns of one that has may be null.
    before = F.when(F.col("_within").isNull(), F.col("_carried")).otherwise(F.col("_within"))
    return found.select(*df.columns, *[before[c].alias(f"{prefix}{c}") for c in columns])


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to and with each row."""
    rows = ranged(df, order[0], width).withColumn("_value", value)
    place = [*keys, RANGE]
    totals = rows.groupBy(*place).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*place, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    within = F.sum("_value").over(Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(carried, place).select(*df.columns, (F.col("_within") + F.col("_carried")).alias(name))


def with_highest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: int) -> DataFrame:
    """Add the greatest ``value`` of the key's rows before each row; ranges are of the first column of ``order``."""
    rows = ranged(df, order[0], width)
    place = [*keys, RANGE]
    highs = rows.groupBy(*place).agg(F.max(value).alias("_high"))
    carried = highs.select(*place, F.max("_high").over(Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    within = F.max(value).over(Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_within", within).join(carried, place).select(*df.columns, F.greatest("_within", "_carried").alias(name))


def with_next_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], at: str, value: str, name: str, width: int) -> DataFrame:
    """Add the first ``value`` that isn't null at or after each row; ``order`` goes backwards, ranges are of ``at``."""
    rows = ranged(df, at, width)
    place = [*keys, RANGE]
    first = rows.groupBy(*place).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = first.select(*place, F.last("_first", ignorenulls=True).over(later).alias("_carried"))
    # Backwards, so that the frame grows row by row: a frame that shrinks is summed anew at each row.
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(carried, place).select(*df.columns, F.coalesce("_within", "_carried").alias(name))


def with_reach(df: DataFrame, at: str, reach: int, width: int) -> DataFrame:
    """Each row in its range, and as a guest (``_guest``) in the range before if it lies within ``reach`` of its end; for windows that look ahead."""
    if reach > width:
        raise ValueError("a window reaches no further than a range")
    own = F.floor(F.col(at) / width)
    places = F.when(F.col(at) - own * width <= reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_back", F.explode(places)).withColumn(RANGE, own - F.col("_back")).withColumn("_guest", F.col("_back") > 0).drop("_back")


def with_counts_under(thresholds: DataFrame, at: str, equal: Column, values: DataFrame, value: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add how many of the key's ``values`` are under each threshold (those equal to it too where ``equal``; null for a null
    threshold), how many there are, and how many are null: three ``names``. Keys without values have no rows.

    Values and thresholds lie in one order, cut into ranges of values by quantiles of the whole table. Equal values of a key are
    one row with their number, so a range isn't filled by one value. Counts run within a range; one row a key and range is carried.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    under, known, absent = names
    v = F.col(value).cast("double").alias("_v")
    held = values.select(*keys, v).groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.lit(1).alias("_tie"))
    cuts = values.select(v).agg(F.percentile_approx("_v", [i / parts for i in range(1, max(parts, 2))], 40 * parts).alias("_cuts"))
    asked = thresholds.select(*keys, F.col(at).cast("double").alias("_v"), F.lit(0).cast("long").alias("_n"), F.when(equal, 2).otherwise(0).alias("_tie"), F.struct(*thresholds.columns).alias("_row"))
    both = asked.unionByName(held.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)))
    # Nulls are a range of their own.
    number = F.when(F.col("_v").isNull(), -1).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))), F.lit(0)))
    rows = both.join(F.broadcast(cuts)).withColumn(RANGE, number).drop("_cuts")  # one row of quantiles
    place = [*keys, RANGE]
    totals = rows.groupBy(*place).agg(F.sum("_n").alias("_total"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = F.when(F.col(RANGE) >= 0, F.col("_total")).otherwise(0)
    carried = totals.select(
        *place, F.coalesce(F.sum(counts).over(earlier), F.lit(0)).alias("_carried"), F.sum(counts).over(whole).alias(known),
        F.sum(F.col("_total") - counts).over(whole).alias(absent),
    )
    within = F.sum("_n").over(Window.partitionBy(*place).orderBy("_v", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_within", within).where(F.col("_row").isNotNull()).join(carried, place).where(F.col(known) + F.col(absent) > 0)
    return found.select("_row.*", F.when(F.col(RANGE) >= 0, F.col("_within") + F.col("_carried")).alias(under), known, absent)


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The key's different values in order: ``value``, its rows ``n``, the rows up to and with it ``upto``, all the key's rows ``size``; nulls don't count.

    Values are counted where they lie first. The order is cut into ranges by quantiles of the whole table, whose totals, one row a
    key and range, are carried over.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cuts = held.agg(F.percentile_approx(value, [i / parts for i in range(1, max(parts, 2))], 40 * parts).alias("_cuts"))
    rows = held.join(F.broadcast(cuts)).withColumn(RANGE, F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")  # one row of quantiles
    place = [*keys, RANGE]
    totals = rows.groupBy(*place).agg(F.sum("n").alias("_total"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*place, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"), F.sum("_total").over(whole).alias("size"))
    within = F.sum("n").over(Window.partitionBy(*place).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(carried, place).select(*keys, value, "n", (F.col("_within") + F.col("_carried")).alias("upto"), "size")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """One row a key: the middle value, or the mean of the two middle ones."""
    at = lambda place: F.max(F.when((F.col("upto") - F.col("n") < place) & (place <= F.col("upto")), F.col(value)))
    low, high = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    return distribution(df, keys, value).groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def with_least_half(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str) -> DataFrame:
    """Mark the half of the key's rows (rounded down) with the least ``value``, ties by ``tie``, a number that tells rows apart."""
    k = F.floor(F.col("size") / 2)
    cut = distribution(df.select(*keys, value), keys, value).where((F.col("upto") - F.col("n") < k) & (k <= F.col("upto")))
    limits = cut.select(*keys, F.col(value).alias("_limit"), (k - F.col("upto") + F.col("n")).alias("_left"))
    # Of the rows that tie with the limit, the number of the last one inside.
    tied = joined_by_key(df.select(*keys, value, tie), limits, keys).where(F.col(value) == F.col("_limit"))
    last = distribution(tied, [*keys, "_left"], tie).where(F.col("upto") == F.col("_left")).select(*keys, F.col(tie).alias("_last"))
    rows = df.join(F.broadcast(limits.join(last, list(keys), "left")), list(keys), "left")  # one row a key
    inside = (F.col(value) < F.col("_limit")) | ((F.col(value) == F.col("_limit")) & (F.col(tie) <= F.col("_last")))
    return rows.withColumn(name, F.coalesce(inside, F.lit(False))).drop("_limit", "_left", "_last")
