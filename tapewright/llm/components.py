"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.storage import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of its neighbours and itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself are linked to the least of them; ``links`` have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    moved = links.join(least, "b")
    return (
        moved.select(F.col("least").alias("low"), F.col("a").alias("high"))
        .unionByName(least.select(F.col("least").alias("low"), F.col("b").alias("high")))
        .select(F.col("low").alias("a"), F.col("high").alias("b"))
        .where("a < b")
        .distinct()
    )


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component``: the least node of each node's component, for all nodes of ``links`` (a, b: of any type with an order).

    Ends when a round changes nothing; each round's links are written down, so
    the lineage stays short. Only counts and sums of hashes reach the driver.
    """
    now = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    stars = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
