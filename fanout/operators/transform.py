"""Nested batches in, flat typed rows out. No shuffle anywhere.

Filters are written straight after the fan-out so whole-stage codegen fuses generate, filter and
derive into one stage; batch-level fields are computed before the fan-out, once per batch. This
module must never import the expectation it is checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.functions.numeric import truncating_div
from fanout.functions.text import ascii_upper

HEADER = ["batch_id", "sensor", "region", "batch_ts_ms", "send_ts_us"]


def is_sentinel(unit: Column) -> Column:
    return unit == S.DROP_UNIT


def below_floor(quality: Column) -> Column:
    """Null quality is not below the floor."""
    return quality.isNotNull() & (quality < S.QUALITY_FLOOR)


def flatten(batches: DataFrame) -> DataFrame:
    """One row per event; a batch without events yields none."""
    return batches.select(*HEADER, F.inline("events"))


def drop_sentinel(events: DataFrame) -> DataFrame:
    return events.filter(~is_sentinel(F.col("unit")))


def drop_low_quality(events: DataFrame) -> DataFrame:
    return events.filter(~below_floor(F.col("quality")))


def coalesce_region(frame: DataFrame) -> DataFrame:
    return frame.withColumn("region", F.coalesce("region", F.lit("")))


def scaled(value: Column, seq: Column) -> Column:
    return truncating_div(value * 1000, seq.cast("long") + 1)


def derive_scaled(events: DataFrame) -> DataFrame:
    return events.withColumn("value_scaled", scaled(F.col("value"), F.col("seq")))


def upper_names(events: DataFrame) -> DataFrame:
    return events.withColumn("name_upper", ascii_upper(F.col("name")))


def stamp(frame: DataFrame) -> DataFrame:
    """Epoch milliseconds and microseconds become timestamps; no zone is involved."""
    return frame.withColumn("batch_ts", F.timestamp_millis("batch_ts_ms")).withColumn(
        "send_ts", F.timestamp_micros("send_ts_us")
    )


def batch_id_checked(b: Column) -> Column:
    return F.when(b >= 0, b).otherwise(F.raise_error(F.concat(F.lit("negative batch_id "), b.cast("string"))))


def seq_checked(s: Column) -> Column:
    return F.when(s.between(0, 65535), s.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("seq outside 16 bits: "), s.cast("string")))
    )


def narrow_problem(b: Column, s: Column) -> Column:
    """The reject-side spelling of the two checks, for callers that split rather than fail."""
    return F.when(b < 0, F.lit("negative batch_id")).when(~s.between(0, 65535), F.lit("seq outside 16 bits"))


def land(batches: DataFrame) -> DataFrame:
    """The whole transform, ending in the twelve target columns in table order.

    Refuses batches of another schema before anything runs.
    """
    S.require_schema(batches, S.BATCH)
    header = batches.select(
        batch_id_checked(F.col("batch_id")).alias("batch_id"),
        "sensor",
        F.coalesce("region", F.lit("")).alias("region"),
        F.timestamp_millis("batch_ts_ms").alias("batch_ts"),
        F.timestamp_micros("send_ts_us").alias("send_ts"),
        "events",
    )
    return _shape(header.select("batch_id", "sensor", "region", "batch_ts", "send_ts", F.inline("events")))


def land_flat(events: DataFrame) -> DataFrame:
    """The same transform for events that arrive one per row beside their batch's header."""
    return _shape(
        events.withColumn("batch_id", batch_id_checked(F.col("batch_id")))
        .withColumn("region", F.coalesce("region", F.lit("")))
        .withColumn("batch_ts", F.timestamp_millis("batch_ts_ms"))
        .withColumn("send_ts", F.timestamp_micros("send_ts_us"))
    )


def _shape(rows: DataFrame) -> DataFrame:
    kept = rows.filter(~is_sentinel(F.col("unit"))).filter(~below_floor(F.col("quality")))
    return kept.select(
        "batch_id",
        seq_checked(F.col("seq")).alias("event_seq"),
        "sensor",
        "region",
        ascii_upper(F.col("name")).alias("name_upper"),
        "unit",
        "value",
        scaled(F.col("value"), F.col("seq")).alias("value_scaled"),
        "quality",
        "tags",
        "batch_ts",
        "send_ts",
    )


def land_by_array(batches: DataFrame) -> DataFrame:
    """The same rows, filtering and mapping inside the array before the fan-out.

    Fewer rows leave the generate, but the lambdas run outside whole-stage codegen; ``land`` is the
    default and this is the alternative the bench compares it with.
    """
    kept = F.filter("events", lambda e: ~is_sentinel(e["unit"]) & ~below_floor(e["quality"]))
    shaped = F.transform(
        kept,
        lambda e: F.struct(
            seq_checked(e["seq"]).alias("event_seq"),
            ascii_upper(e["name"]).alias("name_upper"),
            e["unit"].alias("unit"),
            e["value"].alias("value"),
            scaled(e["value"], e["seq"]).alias("value_scaled"),
            e["quality"].alias("quality"),
            e["tags"].alias("tags"),
        ),
    )
    return batches.select(
        batch_id_checked(F.col("batch_id")).alias("batch_id"),
        "sensor",
        F.coalesce("region", F.lit("")).alias("region"),
        F.timestamp_millis("batch_ts_ms").alias("batch_ts"),
        F.timestamp_micros("send_ts_us").alias("send_ts"),
        F.inline(shaped),
    ).select(*S.COLUMNS)


# The same transform for people who write SQL. ``batches`` is the input view.
LAND_SQL = f"""
SELECT batch_id, seq AS event_seq, sensor, region,
       translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS name_upper,
       unit, value, value * 1000 div (seq + 1) AS value_scaled, quality, tags, batch_ts, send_ts
FROM (SELECT batch_id, sensor, coalesce(region, '') AS region,
             timestamp_millis(batch_ts_ms) AS batch_ts, timestamp_micros(send_ts_us) AS send_ts, events
      FROM {{batches}})
LATERAL VIEW inline(events) e AS seq, name, unit, value, quality, tags
WHERE unit <> '{S.DROP_UNIT}' AND NOT (quality IS NOT NULL AND quality < {S.QUALITY_FLOOR})
"""


def land_sql(batches: DataFrame) -> DataFrame:
    S.require_schema(batches, S.BATCH)
    return batches.sparkSession.sql(LAND_SQL, batches=batches)


def survival(batches: DataFrame) -> DataFrame:
    """How many events survive both filters, as counts and as basis points. One pass, one row."""
    return survival_flat(flatten(batches))


def survival_flat(rows: DataFrame) -> DataFrame:
    """The same for events that arrive one per row."""
    events = rows.agg(
        F.count("*").alias("events"),
        F.count_if(~is_sentinel(F.col("unit")) & ~below_floor(F.col("quality"))).alias("landed"),
    )
    return events.withColumn(
        "yield_bp", truncating_div(F.col("landed") * 10000, F.greatest(F.col("events"), F.lit(1)))
    )
