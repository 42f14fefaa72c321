"""Cost of a run from per-container counter series.

A series is ``(arm, container, line, t_ms, <counters>)`` with -1 where a counter could not be read.
``line`` orders samples of equal time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.functions.numeric import cap_bytes
from fanout.operators.ordering import previous, running_sum
from fanout.session import cut

BUCKET_MS = 1_000


def is_readable() -> Column:
    """No counter is the -1 sentinel."""
    return F.forall(F.array(*S.SAMPLE_COUNTERS), lambda c: c >= 0)


def readable_samples(series: DataFrame) -> DataFrame:
    return series.groupBy("arm", "container").agg(
        F.count_if(is_readable()).alias("readable"), F.count_if(~is_readable()).alias("unreadable")
    )


def container_cost(series: DataFrame) -> DataFrame:
    """One row per container; figures are null with under two readable samples or no elapsed time.

    First and last samples come from ``min_by``/``max_by``, which merge, so no series is ever sorted.
    """
    ok = is_readable()
    position = F.when(ok, F.struct("t_ms", "line"))
    picked = F.struct("t_ms", *S.SAMPLE_COUNTERS)
    ends = series.groupBy("arm", "container").agg(
        F.min_by(picked, position).alias("a"),
        F.max_by(picked, position).alias("z"),
        F.count_if(ok).alias("samples"),
        F.count_if(~ok).alias("unreadable"),
        F.max(F.when(ok, F.col("anon"))).alias("peak_anon"),
        F.max(F.when(ok, F.col("mem_current"))).alias("peak_current"),
    )
    window = F.col("z.t_ms") - F.col("a.t_ms")
    usable = (F.col("samples") >= 2) & (window > 0)

    def delta(counter: str) -> Column:
        return F.when(usable, F.greatest(F.col(f"z.{counter}") - F.col(f"a.{counter}"), F.lit(0)))

    return ends.select(
        "arm",
        "container",
        F.when(usable, window).alias("window_ms"),
        delta("usage_usec").alias("cpu_us"),
        delta("user_usec").alias("user_us"),
        delta("system_usec").alias("system_us"),
        delta("throttled_usec").alias("throttled_us"),
        delta("nr_throttled").alias("nr_throttled"),
        F.when(usable, F.col("peak_anon")).alias("peak_anon"),
        # the counter already is a running peak, so its last reading is the window's
        F.when(usable, F.col("z.mem_peak")).alias("peak_charged"),
        F.when(usable, F.col("peak_current")).alias("peak_current"),
        "samples",
        "unreadable",
        (delta("nr_throttled") > 0).alias("throttled"),
    )


ADDED = ["cpu_us", "user_us", "system_us", "throttled_us", "nr_throttled", "peak_anon", "peak_charged", "peak_current"]


def arm_cost(costs: DataFrame, declared: DataFrame) -> DataFrame:
    """Per arm, the containers added up; null throughout unless every declared one has a cost.

    ``declared`` is ``(arm, container)``. Cores are recomputed over the longest window.
    """
    parts = declared.select("arm", "container").join(costs, ["arm", "container"], "left")
    whole = F.count_if(F.col("window_ms").isNull()) == 0
    summed = parts.groupBy("arm").agg(
        F.count("*").alias("containers"),
        F.when(whole, F.max("window_ms")).alias("window_ms"),
        *[F.when(whole, F.sum(c)).alias(c) for c in ADDED],
        F.when(whole, F.min("samples")).alias("samples"),
        F.sum(F.coalesce("unreadable", F.lit(0))).alias("unreadable"),
    )
    return summed.withColumn("cores_used", F.col("cpu_us") / (F.col("window_ms") * 1000.0))


def data_plane_cost(costs: DataFrame, declared: DataFrame) -> DataFrame:
    """The data-plane containers' own CPU and memory beside the arm total."""
    on_plane = F.col("role") == "data-plane"
    joined = declared.select("arm", "container", "role").join(costs, ["arm", "container"])
    return joined.groupBy("arm").agg(
        F.sum("cpu_us").alias("cpu_us"),
        F.sum(F.when(on_plane, F.col("cpu_us"))).alias("data_plane_cpu_us"),
        F.sum(F.when(on_plane, F.col("peak_anon"))).alias("data_plane_peak_anon"),
        F.max(F.when(on_plane, F.col("window_ms"))).alias("data_plane_window_ms"),
    )


def sampler_window(series: DataFrame) -> DataFrame:
    """Per arm, earliest to latest readable sample; null if any container has none or no time passed."""
    ok = is_readable()
    per_container = series.groupBy("arm", "container").agg(
        F.min(F.when(ok, F.col("t_ms"))).alias("first"), F.max(F.when(ok, F.col("t_ms"))).alias("last")
    )
    spans = per_container.groupBy("arm").agg(
        F.min("first").alias("from_ms"),
        F.max("last").alias("to_ms"),
        F.count_if(F.col("first").isNull()).alias("blind"),
    )
    good = (F.col("blind") == 0) & (F.col("from_ms") < F.col("to_ms"))
    return spans.select(
        "arm", F.when(good, F.col("from_ms")).alias("from_ms"), F.when(good, F.col("to_ms")).alias("to_ms")
    )


def simultaneous_peak(series: DataFrame) -> DataFrame:
    """The most anonymous memory each arm held at one instant, readings carried forward.

    The carried-forward total only moves when some container is sampled, and then by that
    container's change. So the total is a running sum of changes over one-second buckets, and no
    grid of seconds by containers is ever built.
    """
    ok = series.filter(is_readable()).select("arm", "container", "line", "t_ms", "anon")
    first = ok.groupBy("arm").agg(F.min("t_ms").alias("first"))
    bucket = F.call_function("div", F.col("t_ms") - F.col("first"), F.lit(BUCKET_MS))
    held = (
        ok.join(first, "arm")
        .groupBy("arm", "container", bucket.alias("bucket"))
        .agg(F.max_by("anon", F.struct("t_ms", "line")).alias("anon"))
    )
    changed = previous(held, ["arm", "container"], "bucket", "anon", "before").withColumn(
        "change", F.col("anon") - F.coalesce("before", F.lit(0))
    )
    per_bucket = changed.groupBy("arm", "bucket").agg(F.sum("change").alias("change"))
    totals = running_sum(per_bucket, ["arm"], "bucket", "change", "total")
    return totals.groupBy("arm").agg(F.max("total").alias("peak_anon"))


def cap_check(readings: DataFrame, declared: DataFrame) -> DataFrame:
    """Caps read back from each container against the declared ones.

    ``readings`` is ``(container, meta)`` with ``cpu.max=<quota>/<period> memory.max=<bytes>``;
    ``declared`` is ``(container, cpus, memory)``.
    """
    cpu = F.regexp_extract("meta", r"(?:^|\s)cpu\.max=(\S+)", 1)
    mem = F.regexp_extract("meta", r"(?:^|\s)memory\.max=(\S+)", 1)
    quota = F.split_part(cpu, F.lit("/"), F.lit(1)).try_cast("double")
    period = F.split_part(cpu, F.lit("/"), F.lit(2)).try_cast("double")
    cores = F.when(period > 0, quota / period)
    want_bytes = cap_bytes(F.col("memory"))
    close = F.abs(cores - F.col("cpus").try_cast("double")) < 0.01
    return declared.join(readings, "container").select(
        "container",
        cores.alias("cores"),
        F.when(cpu == "", F.lit("no cpu.max"))
        .when(mem == "", F.lit("no memory.max"))
        .when(~F.coalesce(close, F.lit(False)), F.lit("cpus differ"))
        .when(~want_bytes.eqNullSafe(mem.try_cast("long")), F.lit("memory differs"))
        .alias("problem"),
    )


def cores_between(readings: DataFrame) -> DataFrame:
    """Cores, share of the cap and user share between each container's first and last reading."""
    at = F.struct("t_ms", "line")
    picked = F.struct("t_ms", "usage_usec", "user_usec", "system_usec")
    ends = readings.groupBy("arm", "container").agg(
        F.min_by(picked, at).alias("a"), F.max_by(picked, at).alias("z"), F.max("cap_cores").alias("cap_cores")
    )
    elapsed_us = (F.col("z.t_ms") - F.col("a.t_ms")) * 1000
    used = F.greatest(F.col("z.usage_usec") - F.col("a.usage_usec"), F.lit(0))
    user = F.greatest(F.col("z.user_usec") - F.col("a.user_usec"), F.lit(0))
    system = F.greatest(F.col("z.system_usec") - F.col("a.system_usec"), F.lit(0))
    cores = F.when(elapsed_us > 0, used / elapsed_us)
    return ends.select(
        "arm",
        "container",
        cores.alias("cores"),
        F.when(F.col("cap_cores") > 0, cores / F.col("cap_cores")).otherwise(F.lit(0.0)).alias("share_of_cap"),
        F.when(user + system > 0, user / (user + system)).alias("user_share"),
    )
