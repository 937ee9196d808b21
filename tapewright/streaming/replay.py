"""Stored tables as streams of bounded triggers, and sinks that a repeated batch doesn't change.

A batch is written under its own number and overwritten if it runs again, so a
restarted stream leaves each batch once. What readers see is what a commit
names; it is written last.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "tapewright_batch"
ARRIVAL = "tapewright_arrival"


def arriving(rows: DataFrame, arrival: Column, folder: str, closing: DataFrame | None = None, files: int = 1) -> DataFrame:
    """A stream with one trigger for each number of ``arrival``, in order.

    Each range becomes ``files`` files, written side by side after those of
    earlier ranges; so ranges must be narrow enough for as many tasks.
    ``closing`` rows come last, in files of their own: a heartbeat that moves
    the watermark on.
    """
    spark, run = rows.sparkSession, f"{folder}/tapewright-{uuid.uuid4().hex}"
    rows.withColumn(ARRIVAL, arrival).write.partitionBy(ARRIVAL).parquet(f"{run}/staged")
    staged = spark.read.schema(rows.withColumn(ARRIVAL, F.lit(0).cast("long")).schema).parquet(f"{run}/staged")
    parts = [staged.where(F.col(ARRIVAL) == number).drop(ARRIVAL) for (number,) in sorted(staged.select(ARRIVAL).distinct().collect())]
    if closing is not None:
        parts.append(closing.select(*rows.columns))
    for done, part in enumerate(parts, 1):
        part.coalesce(files).write.mode("append").parquet(f"{run}/stream")
        # A trigger is a number of files: what a range has too few of is made up by files without rows.
        for _ in range(done * files - len(spark.read.schema(rows.schema).parquet(f"{run}/stream").inputFiles()) if files > 1 else 0):
            part.limit(0).coalesce(1).write.mode("append").parquet(f"{run}/stream")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{run}/stream")


def run_to_end(stream: DataFrame, run: str, mode: str) -> list[dict]:
    """Run a stream over everything there is now into ``run/out``, a folder a batch; returns what Spark reports of each trigger."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/{BATCH}={number}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/state").foreachBatch(write).trigger(availableNow=True).start()
    started.awaitTermination()
    return list(started.recentProgress)


def numbered(schema: T.StructType) -> T.StructType:
    """The schema with the batch's number; ``schema.add`` would change the schema itself."""
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])


def written_batches(spark: SparkSession, stream: DataFrame, run: str) -> DataFrame:
    """All rows that a stream wrote, with the number of their batch."""
    return spark.read.schema(numbered(stream.schema)).parquet(f"{run}/out")


def drain(stream: DataFrame, folder: str, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over everything there is now and read what it wrote.

    ``complete`` keeps the last result only; ``update`` with ``keys`` keeps each key's rows of its last batch.
    """
    spark, run = stream.sparkSession, f"{folder}/tapewright-{uuid.uuid4().hex}"
    run_to_end(stream, run, mode)
    rows = written_batches(spark, stream, run)
    if mode == "complete":
        last = rows.agg(F.max(BATCH)).first()[0]
        rows = rows.where(F.col(BATCH) == F.lit(last))
    elif keys:
        rows = rows.join(rows.groupBy(*keys).agg(F.max(BATCH).alias(BATCH)), [*keys, BATCH])
    return rows.drop(BATCH)


def late_rows(stream: DataFrame, folder: str, window_ms: int, late_ms: int, ts_ms: str = "ts_ms") -> DataFrame:
    """The rows that a windowed sum of the same stream leaves out as late: their window had closed.

    A batch's watermark is the greatest time of the batches before the last one, less ``late_ms``: Spark closes windows
    by the batches so far and drops what it had closed by one batch earlier. Of each batch only its greatest time is kept.
    """
    spark, run = stream.sparkSession, f"{folder}/tapewright-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.agg(F.max(ts_ms).alias("high")).write.mode("overwrite").parquet(f"{run}/marks/{BATCH}={number}")
        marks = spark.read.schema(f"high long, {BATCH} long").parquet(f"{run}/marks").where(F.col(BATCH) <= number - 2)
        high = marks.agg(F.max("high")).first()[0]
        end = F.col(ts_ms) - F.pmod(F.col(ts_ms), F.lit(window_ms)) + window_ms
        late = batch.where(F.lit(False) if high is None else end <= high - late_ms)
        late.write.mode("overwrite").parquet(f"{run}/out/{BATCH}={number}")

    stream.writeStream.option("checkpointLocation", f"{run}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return written_batches(spark, stream, run).drop(BATCH)


class LatestAndHistory:
    """A sink of two views that change together: the history of all rows, and the newest row of each key.

    Keys are dealt to buckets. A batch overwrites its own folder of the history and, for each bucket that it touches,
    a folder with the bucket's newest rows; its commit names these and is written last. A batch that runs again starts
    from the commits before it and leaves the same. Rows of the buckets it doesn't touch aren't read.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], schema, buckets: int = 16):
        self.path, self.keys, self.order, self.schema, self.buckets = path, list(keys), list(order), schema, buckets

    def _commits(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        rows = spark.read.schema(f"bucket int, {BATCH} long").parquet(f"{self.path}/commits")
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def _versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The newest batch of each bucket: at most ``buckets`` numbers."""
        try:
            found = self._commits(spark, before).where("bucket is not null").groupBy("bucket").agg(F.max(BATCH)).collect()
        except Exception as e:  # nothing is committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        return {bucket: number for bucket, number in found}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/latest/{BATCH}={number}/bucket={bucket}" for bucket, number in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths).select(*self.schema.names) if paths else spark.createDataFrame([], self.schema)

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        from tapewright.sources.store import latest_per_key

        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.path}/history/{BATCH}={number}")
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/history/{BATCH}={number}")
        touched = sorted(b for (b,) in rows.select(self._bucket()).distinct().collect())
        before = self._versions(spark, number)
        held = self._read(spark, {b: n for b, n in before.items() if b in touched})
        newest = latest_per_key(rows.unionByName(held), self.keys, self.order).select(*self.schema.names)
        newest.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/latest/{BATCH}={number}")
        commit = spark.createDataFrame([(b,) for b in touched] or [(None,)], "bucket int")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{BATCH}={number}")

    def latest(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self._versions(spark))

    def history(self, spark: SparkSession) -> DataFrame:
        """The rows of committed batches."""
        rows = spark.read.schema(numbered(self.schema)).parquet(f"{self.path}/history")
        return rows.join(self._commits(spark).select(BATCH).distinct(), BATCH, "left_semi").drop(BATCH)

    def drained(self, stream: DataFrame) -> LatestAndHistory:
        """Run a stream into the sink over everything there is now."""
        stream.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.write).trigger(availableNow=True).start().awaitTermination()
        return self
