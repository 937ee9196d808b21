"""The table of registered queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.sources.views import Market, with_views

PLACES = 6


@dataclass
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(Market(spark, sf_dir)))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sql = with_views(self.sql)
        if not self.doubles:
            return sql
        swapped = ", ".join(f"round({c}, {PLACES}) + 0E0 AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({swapped}) FROM ({sql}) AS q"


QUERIES: dict[str, Query] = {}


def folder(market: Market) -> str:
    """The shared folder that the cluster names; a local one only where none is named on a single machine, as in tests."""
    named = market.spark.conf.get("spark.checkpoint.dir", None)
    if not named and not market.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs a shared folder, named in spark.checkpoint.dir")
    return named or tempfile.mkdtemp(prefix="spark-query-")


_SHARED: dict[tuple, tuple[str, object]] = {}


def shared(market: Market, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written once for all queries of a session that ask for ``name`` over the same files.

    Written when first asked for; anew if the source files change or the written ones are gone.
    """
    spark = market.spark
    newest = F.max("_metadata.file_modification_time").cast("string")
    files = tuple(tuple(getattr(market, t).select(newest, F.sum("_metadata.file_size"), F.count("*")).first()) for t in tables)
    key = (spark.sparkContext.applicationId, market.sf_dir, name, files)
    if key in _SHARED:
        path, schema = _SHARED[key]
        try:
            spark.read.parquet(path)
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the shared folder was cleared
            del _SHARED[key]
    df = build()
    path = f"{folder(market)}/tapewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SHARED[key] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros: sums may come in any order."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register the function that builds a query from the market views; ``sql`` names the views in braces."""

    def add(build: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = Query(name, build, sql, tuple(doubles.split()))
        return build

    return add
