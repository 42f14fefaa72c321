"""The deterministic corpus as column expressions over a batch id and an event sequence number.

Every field is a closed form, so a corpus of any size is generated where it is needed, without a
shuffle and without storing anything. ``batch_id`` is a non-negative BIGINT, ``seq`` an INT.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.functions.numeric import truncating_div


# tags by the sum of batch id and sequence number: their count and their names repeat after as many
_TAG_CYCLE = [[f"tag-{(i + j) % S.TAGS}" for j in range(i % 4)] for i in range(S.TAGS * 4)]


def _units() -> Column:
    return F.array(*[F.lit(u) for u in S.UNITS])


def sensor(b: Column) -> Column:
    return F.concat(F.lit("sensor-"), (b % S.SENSORS).cast("string"))


def region(b: Column) -> Column:
    """Null for every tenth batch."""
    return F.when(b % 10 != 0, F.concat(F.lit("region-"), (b % S.REGIONS).cast("string")))


def batch_ts_ms(b: Column) -> Column:
    return F.lit(S.BASE_TS_MS) + b


def prefill_send_ts_us(b: Column) -> Column:
    return F.lit(S.BASE_TS_MS * 1000) + b


def event_name(b: Column, seq: Column) -> Column:
    at = (b * 31 + seq) % S.NAMES
    spelled = F.concat(F.lit("metric_"), at.cast("string"))
    return F.when(at >= 0, F.get(F.array(*[F.lit(f"metric_{i}") for i in range(S.NAMES)]), at.cast("int"))).otherwise(spelled)


def unit(b: Column, seq: Column) -> Column:
    return F.element_at(_units(), ((b * 7 + seq) % len(S.UNITS) + 1).cast("int"))


def value(b: Column, seq: Column) -> Column:
    """``(b * 1000003 + seq * 97) mod 2**64``, then modulo 2**31 - 1.

    Done in 32-bit halves that no BIGINT overflows; 2**32 is 2 modulo the modulus.
    """
    low = F.lit(0xFFFFFFFF)
    lower = b.bitwiseAND(low) * 1_000_003 + seq.cast("long") * 97
    upper = (F.shiftright(b, 32) * 1_000_003 + F.shiftright(lower, 32)).bitwiseAND(low)
    return (upper * 2 + lower.bitwiseAND(low)) % F.lit(S.VALUE_MODULUS)


def quality(b: Column, seq: Column) -> Column:
    """Null for every fifth event."""
    return F.when((b + seq) % 5 != 0, ((b * 13 + seq * 7) % 100).cast("double") / 100.0)


def tags(b: Column, seq: Column) -> Column:
    """Zero to three tags. ``slice`` with length 0 is empty, where ``sequence(0, -1)`` counts down."""
    candidates = F.array(*[F.concat(F.lit("tag-"), ((b + seq + j) % S.TAGS).cast("string")) for j in range(3)])
    spelled = F.slice(candidates, 1, ((b + seq) % 4).cast("int"))
    known = F.from_json(F.lit(json.dumps(_TAG_CYCLE)), "array<array<string>>")
    return F.when(b + seq >= 0, F.get(known, ((b + seq) % len(_TAG_CYCLE)).cast("int"))).otherwise(spelled)


def event(b: Column, seq: Column) -> Column:
    return F.struct(
        seq.cast("int").alias("seq"),
        event_name(b, seq).alias("name"),
        unit(b, seq).alias("unit"),
        value(b, seq).alias("value"),
        quality(b, seq).alias("quality"),
        tags(b, seq).alias("tags"),
    )


def events(b: Column, per_batch: int = S.EVENTS_PER_BATCH) -> Column:
    """A batch's events: stretches of the fields' cycles, cut from literals where the batch id is in range."""
    return F.when((b >= 0) & (b < F.lit(1 << 42)), _events_from_cycles(b, per_batch)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(per_batch - 1)), lambda s: event(b, s))
    )


def _cycle(values: list, kind: str, start: Column, length: int) -> Column:
    """``length`` values of an endless cycle from the place that ``start`` has in it."""
    period = len(values)
    written = F.from_json(F.lit(json.dumps((values * (-(-length // period) + 1))[: period + length])), f"array<{kind}>")
    return F.slice(written, (start % period + 1).cast("int"), length)


def _events_from_cycles(b: Column, per_batch: int) -> Column:
    names = [f"metric_{i}" for i in range(S.NAMES)]
    # null for every fifth event, else hundredths: both repeat after a hundred events, and after a hundred batches
    qualities = [[None if (i + s) % 5 == 0 else (i * 13 + s * 7) % 100 / 100.0 for s in range(per_batch)] for i in range(100)]
    quality_of = F.from_json(F.lit(json.dumps(qualities)), "array<array<double>>")
    steps = F.from_json(F.lit(json.dumps([s * 97 for s in range(per_batch)])), "array<bigint>")
    # no BIGINT overflows below 2**42
    values = F.transform(steps, lambda step: (b * 1_000_003 + step) % F.lit(S.VALUE_MODULUS))
    zipped = F.arrays_zip(
        F.sequence(F.lit(0), F.lit(per_batch - 1)),
        _cycle(names, "string", b * 31, per_batch),
        _cycle(S.UNITS, "string", b * 7, per_batch),
        values,
        F.element_at(quality_of, (b % 100 + 1).cast("int")),
        _cycle(_TAG_CYCLE, "array<string>", b, per_batch),
    )
    return zipped.cast("array<struct<seq:int,name:string,unit:string,value:bigint,quality:double,tags:array<string>>>")


def due_offset_us(n: Column, rate: Column | int) -> Column:
    """When message ``n`` of a schedule at ``rate`` per second is due: integer division, no drift."""
    rate = F.lit(rate) if isinstance(rate, int) else rate
    return truncating_div(n * 1_000_000, rate)
