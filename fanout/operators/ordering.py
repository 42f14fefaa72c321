"""Ordered computations that stay exact when one key holds most of the rows.

A plain window over a hot key sorts that key's rows in one task, and ``percentile`` keeps one map
entry per distinct value of the key. Everything here first reduces rows with map-side aggregation
and then orders only pieces whose size has a bound that does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanout.session import cut, kept

BLOCK = 65_536


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` over the integer ``order`` within ``keys``.

    ``order`` must be unique within ``keys``. Rows are summed inside blocks of ``block`` consecutive
    order values; only one row per block takes part in the pass across blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.sum(value).over(inside))
    return (
        local.join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_block", "_local", "_offset")
    )


def previous(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """The preceding row's non-null ``value`` within ``keys``, null on a key's first row."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    lasts = blocked.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = lasts.select(*keys, "_block", F.lag("_last").over(across).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.withColumn("_near", F.lag(value).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_block", "_near", "_carried")
    )


def _cells(value: Column) -> tuple[Column, Column]:
    """Two digits that never disagree with the order of ``value``.

    The first is the logarithm of the magnitude in 1/1024 octaves, the second the linear position
    inside that step. Each has about two million possible values at most, and about two million
    distinct doubles share both, so no ordered piece can be larger than that. Both infinities and NaN, which
    comes after all numbers, have cells of their own.
    """
    v = value.cast("double")
    magnitude = F.abs(v)
    finite = magnitude < float("inf")
    step = F.when(finite & (magnitude > 0), F.floor(F.log2(magnitude) * 1024))
    beyond = F.when(F.isnan(v), F.lit(1 << 41)).when(v > 0, F.lit(1 << 40)).otherwise(F.lit(-(1 << 40)))
    first = F.when(~finite, beyond).when(v > 0, step + 2_097_152).when(v < 0, -(step + 2_097_152)).otherwise(F.lit(0))
    inside = F.floor((magnitude / F.pow(F.lit(2.0), step / 1024) - 1) * float(2**31))
    second = F.when(finite & (v > 0), inside).when(finite & (v < 0), -inside).otherwise(F.lit(0))
    return first.cast("long"), second.cast("long")


def select_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
) -> DataFrame:
    """For each key, the values standing at the given ranks of its ascending order; one row per key.

    ``ranks`` maps an output column to a function from the key's row count to a 1-based rank. Equal
    values are counted together before the first shuffle, then the rank is found digit by digit.
    ``keys`` and ``value`` must not be null; a row counts ``weight`` times if that is given. Runs the
    counting when called, and writes it as a table.
    """
    keys = list(keys)
    first, second = _cells(F.col(value))
    counts = (
        df.groupBy(*keys, value)
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
        .withColumn("_c1", first)
        .withColumn("_c2", second)
    )
    # read four times below, of different columns: written once as columns
    counts = kept(counts)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_name"), rank(F.col("_total")).cast("long").alias("_rank"))
            for name, rank in ranks.items()
        ]
    )
    targets = totals.select(*keys, F.inline(wanted))

    found = _descend(counts.groupBy(*keys, "_c1").agg(F.sum("_n").alias("_n")), targets, keys, "_c1")
    found = _descend(
        counts.groupBy(*keys, "_c1", "_c2").agg(F.sum("_n").alias("_n")), found, [*keys, "_c1"], "_c2"
    )
    found = _descend(counts, found, [*keys, "_c1", "_c2"], value)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks]
    )


def _descend(histogram: DataFrame, targets: DataFrame, on: list[str], digit: str) -> DataFrame:
    """Narrow each target to the histogram cell its rank falls in, with the rank inside that cell."""
    joined = histogram.select(*on, digit, "_n").join(targets, on)
    upto = Window.partitionBy(*on, "_name").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("_upto", F.sum("_n").over(upto))
    hit = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
    return placed.filter(hit).select(
        *on, digit, "_name", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank")
    )


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Rank ``ceil(q * n)``, at least 1: always an observed value, never an interpolation."""
    # exact in integers, q being the decimal fraction it is written as
    exact = Fraction(str(q))
    above, below = exact.numerator, exact.denominator
    return lambda n: F.greatest(F.call_function("div", n * above + (below - 1), F.lit(below)), F.lit(1))


def lower_middle(n: Column) -> Column:
    return F.call_function("div", n + 1, F.lit(2))


def upper_middle(n: Column) -> Column:
    return F.call_function("div", n + 2, F.lit(2))


def rank_within(df: DataFrame, keys: Sequence[str], major: Column, ties: Sequence[Column], out: str) -> DataFrame:
    """1-based position within ``keys`` by ascending ``major``, then by ``ties``.

    Rows are dealt by ranges of the whole order, ties included, so one key, and one value within it, spread
    over as many tasks as they need. A row's place is its place in its range plus the rows of its key
    in earlier ranges. ``keys`` must not be null. Runs the dealing when called, as a checkpoint.
    """
    keys = list(keys)
    tied = [f"_tie{i}" for i in range(len(ties))]
    named = df.withColumns({"_major": major, **dict(zip(tied, ties, strict=True))})
    order = ["_major", *tied]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are sampled, so two evaluations may differ: the dealing is kept
    dealt = cut(named.repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    piece = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        dealt.withColumn("_local", F.row_number().over(piece))
        .join(before, [*keys, "_range"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop(*order, "_range", "_local", "_before")
    )
