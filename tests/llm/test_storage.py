"""Tables written on the way to a result go once the result stands."""

from pathlib import Path

import pytest

from tapewright.llm import storage


def tables(spark):
    return {p.name for p in Path(storage.shared_folder(spark).removeprefix("file:")).iterdir() if p.name.startswith("tapewright-")}


def test_settle_keeps_the_result_alone(spark):
    was = tables(spark)
    other = storage.materialize(spark.range(3))
    outside = tables(spark) - was
    kept, path = storage.settle(spark, lambda: storage.materialize(storage.materialize(spark.range(10)).where("id > 4")).selectExpr("id + 1 AS id"))
    assert tables(spark) - was - outside == {path.rsplit("/", 1)[1]}
    assert sorted(r.id for r in kept.collect()) == [6, 7, 8, 9, 10]
    assert other.count() == 3
    storage.drop(spark, path, path)
    assert tables(spark) - was == outside


def test_a_failed_step_leaves_no_record(spark):
    def fails():
        storage.materialize(spark.range(2))
        raise ValueError("no result")

    with pytest.raises(ValueError, match="no result"):
        storage.settle(spark, fails)
    before = tables(spark)
    storage.materialize(spark.range(1))
    assert len(tables(spark) - before) == 1
