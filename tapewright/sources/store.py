"""Table semantics of the durable stores: range reads, idempotent appends, latest views, retention, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_tape_range(tape: DataFrame, symbol: str, venue: str, start_ms: int, end_ms: int, limit: int) -> DataFrame:
    """The first ``limit`` rows of a time range in order; the filters reach the files."""
    rows = tape.where((F.col("symbol") == symbol) & (F.col("venue") == venue) & (F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    return rows.orderBy("ts_ms", "update_id").limit(limit)


def fresh_rows(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't stored, one a key: what an insert-if-absent adds. The least row of a key wins."""
    first = Window.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key])
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.join(stored.select(*key), list(key), "left_anti")


def reachable(stored: DataFrame, new: DataFrame, key: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """The stored rows that can share a key with ``new``: in partitions that it touches, between its least and greatest keys.

    Both limits reach the files: partitions that the batch doesn't touch aren't listed for reading, row groups outside its range
    of a key column are skipped. So what an append reads follows the batch where keys grow with time. ``partition`` columns must be part of the key.
    """
    ordered = [c for c, t in new.dtypes if c in key and t in ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "float", "double")]
    parts = [c for c in partition if c in key]
    limits = new.agg(*[f(c).alias(f"{n}_{c}") for c in ordered for n, f in (("lo", F.min), ("hi", F.max))]).first() if ordered else None
    for c in ordered:
        if limits[f"lo_{c}"] is not None:
            # Null keys lie in no range.
            stored = stored.where(F.col(c).between(limits[f"lo_{c}"], limits[f"hi_{c}"]) | F.col(c).isNull())
    if parts:
        touched = new.select(*parts).distinct().limit(MOST_PARTITIONS + 1).collect()
        if len(touched) <= MOST_PARTITIONS:
            for c in parts:
                values = {r[c] for r in touched}
                stored = stored.where(F.col(c).isin(list(values - {None})) | F.col(c).isNull())
    return stored


#: Partitions of one batch that are named one by one; a batch that touches more is limited by its range of keys alone.
MOST_PARTITIONS = 1000


def append_idempotent(new: DataFrame, path: str, key: Sequence[str], partition: Sequence[str] = ()) -> None:
    """Append the rows whose key a Parquet table doesn't have yet; running it again changes nothing. One writer at a time."""
    spark = new.sparkSession
    try:
        stored = spark.read.schema(new.schema).parquet(path)
        stored.take(1)
        new = fresh_rows(new, reachable(stored, new, key, partition), key)
    except Exception as e:  # the first batch makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = fresh_rows(new, new.limit(0), key)
    new.write.mode("append").partitionBy(*partition).parquet(path)


def ledger_write(rows: DataFrame, path: str) -> None:
    """Append calculation results, a folder a substrate."""
    rows.write.mode("append").partitionBy("substrate").parquet(path)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; ties go to the greatest of the other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def retention_filter(rows: DataFrame, keys: Sequence[str], ts: str, now: Column, max_age_ms: int, keep: int, cap: int) -> DataFrame:
    """Rows young enough, and the newest ``keep`` of each key whatever their age; never more than ``cap`` a key."""
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *[c for c in rows.columns if c not in keys and c != ts])
    ranked = rows.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(((now - F.col(ts) <= max_age_ms) | (F.col("_rank") <= keep)) & (F.col("_rank") <= cap)).drop("_rank")


def recent_history(rows: DataFrame, keys: Sequence[str], ts: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows of each key, newest first by ``rank``."""
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *[c for c in rows.columns if c not in keys and c != ts])
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def watermark_max(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(ts).alias("watermark_ms"))


def merge_tapes(durable: DataFrame, live: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both tapes without repeats of the key; the durable row wins."""
    both = durable.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    first = Window.partitionBy(*key).orderBy("_p", *[c for c in durable.columns if c not in key])
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("source", F.when(F.col("_p") == 0, "durable").otherwise("live")).drop("_n", "_p")


def tombstone_filter(rows: DataFrame, key: str, version: str, forgotten: str = "forgotten") -> DataFrame:
    """The newest version of each id, without the ids whose newest version is forgotten."""
    return latest_per_key(rows, [key], [version]).where(~F.col(forgotten))


def rebuild_projection(events: DataFrame, keys: Sequence[str], event_id: str, order: Sequence[str]) -> DataFrame:
    """The latest state of each subject over unique events, and how many there were; late rows don't rewind it."""
    unique = events.dropDuplicates([*keys, event_id])
    rest = [c for c in unique.columns if c not in keys and c not in order and c != event_id]
    return unique.groupBy(*keys).agg(F.count("*").alias("event_count"), F.max(F.struct(*order, event_id, *rest)).alias("r")).select(
        *keys, "event_count", *[F.col(f"r.{c}").alias(c) for c in (*order, event_id, *rest)]
    )


def shuffle_stability_check(build, rows: DataFrame, parts: int = 7) -> DataFrame:
    """Rows that ``build`` gives for the table but not for the same table dealt anew; none if it doesn't depend on order."""
    return build(rows).exceptAll(build(rows.repartition(parts, F.rand(7))))


def overlay_fresh_book(rest: DataFrame, deltas: DataFrame) -> DataFrame:
    """Each symbol's newest streamed book that has levels, else its polled one, with the source.

    Both: ``symbol, ts_ms, bids, asks`` (arrays).
    """
    full = deltas.where((F.size("bids") > 0) & (F.size("asks") > 0))
    newest = full.groupBy("symbol").agg(F.max(F.struct("ts_ms", "bids", "asks")).alias("d"))
    return rest.join(newest, "symbol", "left").select(
        "symbol", F.coalesce("d.ts_ms", "ts_ms").alias("ts_ms"), F.coalesce("d.bids", "bids").alias("bids"), F.coalesce("d.asks", "asks").alias("asks"), F.when(F.col("d").isNotNull(), "stream").otherwise("rest").alias("book_source")
    )


def merge_derivatives(evidence: DataFrame, **series: DataFrame) -> DataFrame:
    """Evidence (a row a symbol) with each series as an ordered array and its number of bars; missing series have none."""
    out = evidence
    for name, rows in series.items():
        cols = [c for c in rows.columns if c != "symbol"]
        made = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(made, "symbol", "left").withColumn(f"{name}_bars", F.coalesce(F.size(name), F.lit(0)))
    return out


def decision_audit(rows: DataFrame, limit: int, **equal: object) -> DataFrame:
    """The newest decisions that match; filters left out match all."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.col("ts_ms").desc(), *[c for c in rows.columns if c != "ts_ms"]).limit(limit)


def denial_rates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("decisions"), (F.sum(F.when(F.col("allowed"), 0).otherwise(1)) / F.count("*")).alias("denial_rate"))
