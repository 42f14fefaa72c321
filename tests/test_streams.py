"""Queries that stream: how much a trigger takes."""

import os

from fanout.operators import corpus
from fanout.plans import streams
from fanout.session import scratch_path
from fanout.streaming import jobs


def test_a_trigger_takes_a_file_for_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    batches = corpus.batches(spark.range(0, 160, 1, 4 * cores).withColumnRenamed("id", "batch_id"), per_batch=4)
    target = scratch_path(spark, "target")
    jobs.drain(jobs.start_ingest(streams._staged(spark, batches), jobs.epoch_sink(target), scratch_path(spark, "offsets")))
    (drained,) = [d for d in os.listdir(target) if d.startswith("drain=")]
    assert len(os.listdir(f"{target}/{drained}")) == 4
    landed = spark.read.parquet(target)
    assert landed.count() == landed.select("batch_id", "event_seq").distinct().count() > 0


def test_there_are_two_triggers_or_more(spark):
    batches = corpus.batches(spark.range(0, 80, 1, 1).withColumnRenamed("id", "batch_id"), per_batch=4)
    target = scratch_path(spark, "target")
    jobs.drain(jobs.start_ingest(streams._staged(spark, batches), jobs.epoch_sink(target), scratch_path(spark, "offsets")))
    (drained,) = os.listdir(target)
    assert len([e for e in os.listdir(f"{target}/{drained}") if e.startswith("epoch=")]) >= 2
