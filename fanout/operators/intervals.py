"""Points in windows, many windows at once: an interval join by equal time bins.

A window is cut into bins about as wide as a quarter of it or wider, a power of BASE, so it fills BASE + 1 bins at most
however long it is; a point has one bin at each width that any window uses, which 64-bit times bound to 32.
Bins meet by equality, and the window's own ends are checked after. So the join is an ordinary hash or sort-merge
join, a long window does not widen the bins of a short one, and what meets in vain is less than twice what
meets.

A bin that holds more than its share of points is split: its points are dealt to parts by a hash of the row, and its
windows are copied to every part. Which bins, a count says that is made ahead of the join and reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from fanout.session import kept

BASE_BITS = 2  # bins widen by steps of 4
BASE = 1 << BASE_BITS
HOT_BINS = 10_000  # split bins number this at most, whatever the data: they are broadcast
HOT_POINTS = 1_000_000  # a bin with no more points than this is never split


def _level(length: Column) -> Column:
    """Exponent of the widest power of BASE that is not longer than a length of 1 or more."""
    return F.call_function("div", F.length(F.bin(length)) - 1, F.lit(BASE_BITS)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level * BASE_BITS)


def _spread(points: DataFrame) -> Column:
    plain = [f.name for f in points.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*plain)


def in_windows(
    points: DataFrame,
    at: Column,
    windows: DataFrame,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    hot_points: int = HOT_POINTS,
) -> DataFrame:
    """Every pair of a point and a window with ``start <= at < end`` and equal ``keys``.

    ``at``, ``start`` and ``end`` are whole numbers of one unit. A point in no window is in no row, nor is a window
    without points; a null or empty span holds nothing. ``keys`` are columns of both, shown once; the other
    columns of the two must differ in name. Counts the points of each bin when called, in a table that is kept.
    """
    keys = list(keys)
    spans = windows.filter(F.col(start) < F.col(end)).withColumn("_level", _level(F.col(end) - F.col(start)))
    used = spans.groupBy("_level").agg(F.min(start).alias("first"), F.max(end).alias("last")).collect()
    levels = sorted(r["_level"] for r in used)
    first, last = min((r["first"] for r in used), default=0), max((r["last"] for r in used), default=0)
    binned = spans.withColumn(
        "_bin",
        F.explode(F.sequence(_bin(F.col(start), F.col("_level")), _bin(F.col(end) - 1, F.col("_level")))),
    )
    bins = [*keys, "_level", "_bin"]
    near = (
        points.withColumn("_at", at)
        .filter((F.col("_at") >= first) & (F.col("_at") < last))
        .withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
        .withColumn("_bin", _bin(F.col("_at"), F.col("_level")))
    )
    counts = kept(near.groupBy(*bins).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(hot_points, total // HOT_BINS)
    hot = counts.filter(F.col("_n") > share).select(*bins, F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    # more than total / HOT_BINS points each, so HOT_BINS rows at most
    hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = near.join(hot, bins, "left").withColumn("_part", F.pmod(_spread(points), parts).cast("int")).drop("_parts")
    copied = (
        binned.join(hot, bins, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    inside = (F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(end))
    return dealt.join(copied, [*bins, "_part"]).filter(inside).drop("_level", "_bin", "_part", "_at")


def window_sums(
    points: DataFrame,
    at: Column,
    values: dict[str, Column],
    windows: DataFrame,
    start: str,
    end: str,
    by: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Sums of ``values`` over the points with ``start <= at < end`` and equal ``keys``, for each ``by`` of the windows.

    No point meets a window: the points are summed up in order once, and a window is the running sum at its end less that
    at its start. So the work grows with points plus windows however much they overlap. ``values`` are whole numbers; null
    counts as 0, and a window without points sums to 0. Windows of the same ``by`` and ``keys`` (null is a value of its
    own) are added up. Deals points and ends out by ranges of their order when called, in a table that is kept.
    """
    keys, by, names = list(keys), list(by), list(values)
    nothing = [F.lit(0).cast("long").alias(v) for v in names]
    pooled = (
        points.select(*keys, at.cast("long").alias("_at"), *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(v) for v, c in values.items()])
        .filter("_at is not null")
        .groupBy(*keys, "_at")
        .agg(*[F.sum(v).alias(v) for v in names])
    )
    owner = F.struct(*by)
    spans = windows.filter(F.col(start) < F.col(end))
    # an end comes before the points of its own time: it takes in what lies before it
    ends = spans.select(*keys, owner.alias("_by"), F.inline(F.array(
        F.struct(F.col(start).cast("long").alias("_at"), F.lit(-1).alias("_sign")),
        F.struct(F.col(end).cast("long").alias("_at"), F.lit(1).alias("_sign")),
    ))).select(*keys, "_at", F.lit(0).alias("_kind"), *nothing, "_by", "_sign")
    by_type = ends.schema["_by"].dataType
    none = [F.lit(None).cast(by_type).alias("_by"), F.lit(0).alias("_sign")]
    both = ends.unionByName(pooled.select(*keys, "_at", F.lit(1).alias("_kind"), *names, *none))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are sampled, so two evaluations may differ: the dealing is kept
    dealt = kept(both.repartitionByRange(tasks, *keys, "_at", "_kind").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(*[F.sum(v).alias(v) for v in names])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(
        *keys, F.lit(None).cast("long").alias("_at"), F.lit(-1).alias("_kind"), "_range",
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in names], *none,
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.unionByName(carried).select(*keys, "_kind", "_by", "_sign", *[F.sum(v).over(inside).alias(v) for v in names])
    found = placed.filter("_kind = 0").groupBy(*keys, "_by").agg(*[F.sum(F.col(v) * F.col("_sign")).alias(v) for v in names])
    return found.select(*[f"_by.{c}" for c in by], *[k for k in keys if k not in by], *names)
