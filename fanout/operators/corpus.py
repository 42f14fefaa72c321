"""Corpus jobs: nested batches, flat events, framed messages and send schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.functions import corpus as C


def batch_range(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Batch ids ``[lo, hi)``, generated on the executors."""
    return spark.range(lo, hi).withColumnRenamed("id", "batch_id")


def batches(ids: DataFrame, per_batch: int = S.EVENTS_PER_BATCH) -> DataFrame:
    """Nested batches for a frame holding ``batch_id``."""
    b = F.col("batch_id")
    return ids.select(
        b,
        C.sensor(b).alias("sensor"),
        C.region(b).alias("region"),
        C.batch_ts_ms(b).alias("batch_ts_ms"),
        C.prefill_send_ts_us(b).alias("send_ts_us"),
        C.events(b, per_batch).alias("events"),
    )


def flat_events(ids: DataFrame, per_batch: int = S.EVENTS_PER_BATCH) -> DataFrame:
    """The generator one event per row, without ever building the array."""
    seqs = ids.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(per_batch - 1))).alias("seq"))
    b, s = F.col("batch_id"), F.col("seq")
    return seqs.select(
        b,
        s,
        C.event_name(b, s).alias("name"),
        C.unit(b, s).alias("unit"),
        C.value(b, s).alias("value"),
        C.quality(b, s).alias("quality"),
        C.tags(b, s).alias("tags"),
    )


def flat_messages(ids: DataFrame, per_batch: int = S.EVENTS_PER_BATCH) -> DataFrame:
    """Flat events beside their batch's header: what flattening the nested corpus gives."""
    b = F.col("batch_id")
    return flat_events(ids, per_batch).select(
        "*",
        C.sensor(b).alias("sensor"),
        C.region(b).alias("region"),
        C.batch_ts_ms(b).alias("batch_ts_ms"),
        C.prefill_send_ts_us(b).alias("send_ts_us"),
    )


def send_schedule(
    messages: DataFrame, *, index: str, sent_us: str, rate: int, producers: int, partitions: int, origin_us: int
) -> DataFrame:
    """Intended send times, who sends what where, and how far each message's own time lies behind.

    Producer ``i`` of ``n`` owns indices ``i, i+n, ...``; partitions are dealt round-robin over the
    global index, so neither the producers nor the partitions are ever uneven by more than one.
    """
    n = F.col(index)
    due = C.due_offset_us(n, rate)
    return messages.select(
        n.alias("n"),
        F.pmod(n, F.lit(producers)).cast("int").alias("producer"),
        F.pmod(n, F.lit(partitions)).cast("int").alias("partition"),
        due.alias("due_us"),
        (F.lit(origin_us) + due).alias("send_ts_us"),
        (F.col(sent_us) - F.lit(origin_us) - due).alias("lag_us"),
    )
