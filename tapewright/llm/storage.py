"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Paths written while a step is being made, if one is.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where the setting is absent on a single machine, as in tests."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"a cluster needs a shared folder, named in {SETTING}")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The result no longer depends on executors that computed it. Files stay
    until the step that wrote them is ``settle``d, else until the cluster clears
    its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tapewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more; a path that isn't there is no error."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession, step: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The written result of a step and its path; tables that the step wrote on its way are deleted once the result is committed."""
    made: list[str] = []
    token = _written.set(made)
    try:
        kept = materialize(step())
    finally:
        _written.reset(token)
    *spare, path = made
    drop(spark, *spare)
    return kept, path


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out
