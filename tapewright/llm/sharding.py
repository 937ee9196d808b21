"""Contiguous shards of near-equal byte size, from global prefix sums.

The order is the row order by key. Rows are range-partitioned on it, each
partition contributes its byte and row totals, and the running sum of those
totals turns every local prefix sum into a global one. A row belongs to the
shard in which its first byte falls, so a shard's size differs from the target
by at most one row. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.storage import materialize


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32``: UTF-8 bytes plus one, and the CRC-32 of the UTF-8 text (null text: of no bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def balanced_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in a shard) to ``id, size, text_crc32`` rows.

    Order: id ascending, nulls first, then text_crc32 and size; rows equal in
    all three are interchangeable. An empty table gives an empty result. A row
    larger than several targets leaves the shards it spans empty. Only the
    totals of the range partitions (one row each) are combined across the
    table, in one window over as many rows as there are partitions.
    """
    order = [F.col("id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    # The place in the partition is fixed by writing it down: what follows reads it twice.
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", 33)
    local = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (
        placed.groupBy(part.alias("part"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(everything).alias("bytes_total"),
        )
    )
    numbered = (
        placed.withColumn("part", part)
        .withColumn("local_bytes", F.coalesce(F.sum("size").over(local), F.lit(0)))
        .join(F.broadcast(totals), "part")  # one row for each partition
        .withColumn("start_byte", F.col("bytes_before") + F.col("local_bytes"))
        .withColumn("rank", F.col("rows_before") + F.col("place").bitwiseAND((1 << 33) - 1))
        .withColumn("shard", F.expr(f"cast(start_byte * {shards} div bytes_total as int)"))
        .select("id", "size", "text_crc32", "shard", "rank")
    )
    firsts = numbered.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return numbered.join(F.broadcast(firsts), "shard").select(  # at most ``shards`` rows
        "id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot")
    )


def op3_sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of the registered query: every row of documents with its shard under the ``bytes`` law."""
    placed = balanced_shards(sized_rows(docs), shards)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
