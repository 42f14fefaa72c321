"""Sealed batches against a fold row by row, whole and cut into small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from fanout.operators.sealing import Budget, sealed_batches


def folded(rows, budget):
    """rows (key, time, id, size) of all keys, one after another."""
    out, held = [], {}

    def seal(key, why):
        batch = held[key]
        out.append((key, batch["n"], batch["first"], batch["rows"], batch["bytes"], batch["from"], batch["to"], why))
        held[key] = {"n": batch["n"] + 1, "first": batch["first"] + batch["rows"], "rows": 0, "bytes": 0}

    for key, time, _, size in sorted(rows):
        batch = held.setdefault(key, {"n": 0, "first": 0, "rows": 0, "bytes": 0})
        if batch["rows"] and time - batch["from"] >= budget.linger_ms:
            seal(key, "time")
            batch = held[key]
        if not batch["rows"]:
            batch["from"] = time
        batch["rows"] += 1
        batch["bytes"] += size
        batch["to"] = time
        if batch["rows"] == budget.max_rows:
            seal(key, "rows")
        elif batch["bytes"] >= budget.max_bytes:
            seal(key, "bytes")
    for key, batch in list(held.items()):
        if batch["rows"]:
            seal(key, "end")
    return sorted(out)


def sealed(spark, rows, budget, **block):
    frame = spark.createDataFrame(rows, "key string, time long, id long, size long")
    got = sealed_batches(frame, F.col("key"), F.col("time"), F.col("size"), [F.col("id")], budget, **block)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [8, 37, 1 << 20])
@pytest.mark.parametrize("budget", [Budget(4, 10**9, 10**9), Budget(10**3, 50, 10**9), Budget(10**3, 10**9, 20), Budget(9, 120, 30)])
def test_against_a_fold(spark, budget, block):
    rnd = random.Random(block)
    rows = [
        (rnd.choice("abhhhhhh"), rnd.randrange(1200), i, rnd.choice([0, 1, 5, 9, 33, 400]))
        for i in range(500)
    ]
    assert sealed(spark, rows, budget, block=block) == folded(rows, budget)


def test_every_reason_and_both_at_once(spark):
    rows = [("k", 0, 0, 5), ("k", 0, 1, 5), ("k", 50, 2, 1), ("k", 51, 3, 99), ("k", 51, 4, 1), ("k", 52, 5, 1), ("k", 52, 6, 1)]
    got = sealed(spark, rows, Budget(3, 10, 40))
    assert got == folded(rows, Budget(3, 10, 40))
    assert [r[-1] for r in got] == ["bytes", "bytes", "rows"]


def test_empty_and_refused(spark):
    assert sealed(spark, [], Budget(3, 10, 40)) == []
    with pytest.raises(ValueError, match="budget"):
        sealed(spark, [], Budget(0, 10, 40))


def test_a_hot_key_spreads_over_tasks(spark):
    """No task walks more than a block and the rows that its last batch reaches into."""
    frame = spark.range(20_000).select(F.lit("hot").alias("key"), F.col("id").alias("time"), "id", F.lit(1).alias("size"))
    got = sealed_batches(frame, F.col("key"), F.col("time"), F.col("size"), [F.col("id")], Budget(10, 10**9, 10**9), block=1000)
    assert got.agg(F.sum("rows"), F.count("*")).first() == (20_000, 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("rows").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(t.n for t in tasks) < 15_000


def test_one_batch_may_fill_many_blocks(spark):
    """A block is never smaller than two batches' rows."""
    rows = [("k", i, i, 1) for i in range(300)]
    assert sealed(spark, rows, Budget(1000, 10**9, 10**9), block=8) == [("k", 0, 0, 300, 300, 0, 299, "end")]
