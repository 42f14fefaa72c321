"""Metrics over measurement windows: throughput, latency, settling, schedules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.operators.intervals import window_sums
from fanout.operators.ordering import nearest_rank, select_ranks
from fanout.session import kept

QUANTILES = {"p50_us": 0.5, "p99_us": 0.99, "p999_us": 0.999}
SKETCH_ACCURACY = 10_000  # a sketched rank is off by this part of the rows at most
MINUTE_MS = 60_000
SKETCH_K = 4096  # a stored sketch: some tens of kilobytes however many rows a minute has
SKETCH_RANK_ERROR = 0.004  # three times the error that a sketch of this size exceeds in one of a hundred


def in_ms_window(ts: str, from_ms: Column | int, to_ms: Column | int) -> Column:
    """``[from, to)`` on whole milliseconds, written on the timestamp so that it reaches the scan."""

    def bound(v: Column | int) -> Column:
        return F.timestamp_millis(F.lit(v) if isinstance(v, int) else v)

    return (F.col(ts) >= bound(from_ms)) & (F.col(ts) < bound(to_ms))


def rows_in_window(landed: DataFrame, keys: Sequence[str], from_ms: int, to_ms: int) -> DataFrame:
    return landed.filter(in_ms_window("ingest_ts", from_ms, to_ms)).groupBy(*keys).agg(F.count("*").alias("rows"))


def _latencies(landed: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    lat = F.unix_micros("ingest_ts") - F.unix_micros("send_ts")
    return landed.filter(in_ms_window("ingest_ts", from_ms, to_ms)).withColumn("lat_us", lat)


def latency(landed: DataFrame, keys: Sequence[str], from_ms: int, to_ms: int) -> DataFrame:
    """Mergeable-sketch quantiles beside an exact maximum and count: one partial aggregate.

    A key without rows in the window has no latency and is absent.
    """
    sketch = F.percentile_approx("lat_us", F.array(*[F.lit(q) for q in QUANTILES.values()]), SKETCH_ACCURACY)
    return (
        _latencies(landed, from_ms, to_ms)
        .groupBy(*keys)
        .agg(sketch.alias("_q"), F.max("lat_us").alias("max_us"), F.count("*").alias("rows"))
        .select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(QUANTILES)], "max_us", "rows")
    )


def latency_checked(landed: DataFrame, keys: Sequence[str], from_ms: int, to_ms: int) -> DataFrame:
    """For each sketched quantile, whether it lies within the sketch's rank error of the exact one."""
    found = latency(landed, keys, from_ms, to_ms)
    return within_rank_error(found, landed, keys, from_ms, to_ms, 1 / SKETCH_ACCURACY)


def latency_exact(landed: DataFrame, keys: Sequence[str], from_ms: int, to_ms: int) -> DataFrame:
    """Nearest-rank quantiles, exact whatever the number of distinct latencies of one key."""
    lat = _latencies(landed, from_ms, to_ms).select(*keys, "lat_us")
    quantiles = select_ranks(lat, keys, "lat_us", {n: nearest_rank(q) for n, q in QUANTILES.items()})
    totals = lat.groupBy(*keys).agg(F.max("lat_us").alias("max_us"), F.count("*").alias("rows"))
    return quantiles.join(totals, list(keys)).select(*keys, *QUANTILES, "max_us", "rows")


def latency_sketches(landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row a minute and key: a mergeable sketch of the latencies, their exact maximum and their number.

    Kept as a table, it answers for any span of minutes without the rows.
    """
    lat = F.unix_micros("ingest_ts") - F.unix_micros("send_ts")
    minute = F.call_function("div", F.unix_millis("ingest_ts"), F.lit(MINUTE_MS))
    return (
        landed.withColumn("lat_us", lat)
        .groupBy(*keys, minute.alias("minute"))
        .agg(
            F.kll_sketch_agg_bigint("lat_us", F.lit(SKETCH_K)).alias("sketch"),
            F.max("lat_us").alias("max_us"),
            F.count("*").alias("rows"),
        )
    )


def sketched_latency(sketches: DataFrame, keys: Sequence[str], from_minute: int, to_minute: int) -> DataFrame:
    """Quantiles of the minutes ``[from, to)``, each within SKETCH_RANK_ERROR of its rank, from their sketches alone."""
    minute = F.col("minute")
    return (
        sketches.filter((minute >= from_minute) & (minute < to_minute))
        .groupBy(*keys)
        .agg(
            F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("_sketch"),
            F.max("max_us").alias("max_us"),
            F.sum("rows").alias("rows"),
        )
        .select(
            *keys,
            *[F.kll_sketch_get_quantile_bigint("_sketch", F.lit(q)).alias(n) for n, q in QUANTILES.items()],
            "max_us",
            "rows",
        )
    )


def within_rank_error(
    found: DataFrame, landed: DataFrame, keys: Sequence[str], from_ms: int, to_ms: int, error: float
) -> DataFrame:
    """For each quantile of ``found``, whether it lies between the exact ones ``error`` below and above its rank."""
    near = {}
    for name, q in QUANTILES.items():
        near[f"{name}_lo"] = nearest_rank(max(0.0, round(q - error, 6)))
        near[f"{name}_hi"] = nearest_rank(min(1.0, round(q + error, 6)))
    lat = _latencies(landed, from_ms, to_ms).select(*keys, "lat_us")
    within = [
        F.col(n).between(F.col(f"{n}_lo"), F.col(f"{n}_hi")).alias(n.replace("_us", "_within")) for n in QUANTILES
    ]
    return found.join(select_ranks(lat, keys, "lat_us", near), list(keys)).select(*keys, *within, "max_us", "rows")


def rows_by_run(landed: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each run's own window, ``windows`` being (run, from_ms, to_ms); 0 where none landed.

    Windows may overlap: a row counts for every window it falls into.
    """
    counts = window_sums(
        landed, F.unix_millis("ingest_ts"), {"rows": F.lit(1)}, windows.select("run", "from_ms", "to_ms"), "from_ms", "to_ms", ["run"]
    )
    return windows.select("run", "from_ms", "to_ms").join(counts, "run", "left").fillna(0, ["rows"])


DIGIT_BITS = 3  # latencies are narrowed down so many bits at a time


def latency_by_run(landed: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact nearest-rank quantiles of each run's own window; a run without rows is refused and has none.

    A quantile is found digit by digit, from the highest: the rows of the window that share the digits found so far are
    counted by their next one, as sums over the window. Each digit costs one pass over rows and windows, however much
    windows overlap. Runs the counting when called.
    """
    lat = F.unix_micros("ingest_ts") - F.unix_micros("send_ts")
    points = landed.select(F.unix_millis("ingest_ts").alias("at_ms"), lat.alias("lat_us")).filter("at_ms is not null and lat_us is not null")
    points = kept(points.groupBy("at_ms", "lat_us").agg(F.count("*").alias("n")))
    ends = points.agg(F.min("lat_us").alias("a"), F.max("lat_us").alias("z")).first()
    least, most = (0, 0) if ends.a is None else (ends.a, ends.z)
    ranks = {n: nearest_rank(q) for n, q in QUANTILES.items()} | {"max_us": lambda n: n}
    spans = windows.select("run", "from_ms", "to_ms").filter("run is not null")
    over = (F.col("lat_us") - least).alias("over")
    sought = spans.select("run", F.explode(F.array(*[F.lit(n) for n in ranks])).alias("name")).distinct()
    sought = sought.select("run", "name", F.lit(0).cast("long").alias("top"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("rows"))
    rounds = -(-max(1, (most - least).bit_length()) // DIGIT_BITS)
    digits = [f"d{d}" for d in range(1 << DIGIT_BITS)]
    for k in reversed(range(rounds)):
        shift = k * DIGIT_BITS
        top = F.call_function("shiftright", "over", F.lit(shift + DIGIT_BITS))
        digit = F.call_function("shiftright", "over", F.lit(shift)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        near = points.select("at_ms", "n", over).select("at_ms", "n", top.alias("top"), digit.alias("digit"))
        counted = window_sums(
            near,
            F.col("at_ms"),
            {c: F.when(F.col("digit") == d, F.col("n")) for d, c in enumerate(digits)},
            spans.join(sought, "run"),
            "from_ms",
            "to_ms",
            ["run", "name", "rank", "rows"],
            ["top"],
        )
        total = F.coalesce("rows", reduce(lambda a, b: a + b, [F.col(c) for c in digits]))
        first = F.coalesce(*[F.when(F.col("name") == n, rank(total)) for n, rank in ranks.items()])
        ranked = counted.withColumn("rows", total).withColumn("rank", F.coalesce("rank", first)).filter("rows > 0")
        upto = [reduce(lambda a, b: a + b, [F.col(c) for c in digits[: d + 1]]) for d in range(len(digits))]
        place = reduce(lambda rest, d: F.when(F.col("rank") <= upto[d], d).otherwise(rest), reversed(range(len(digits) - 1)), F.lit(len(digits) - 1))
        below = reduce(
            lambda rest, d: F.when(F.col("_digit") == d, upto[d - 1]).otherwise(rest), range(1, len(digits)), F.lit(0).cast("long")
        )
        sought = kept(
            ranked.withColumn("_digit", place).select(
                "run",
                "name",
                (F.col("top") * (1 << DIGIT_BITS) + F.col("_digit")).alias("top"),
                (F.col("rank") - below).alias("rank"),
                "rows",
            )
        )
    found = sought.groupBy("run").agg(
        *[F.max(F.when(F.col("name") == n, F.col("top") + least)).alias(n) for n in ranks], F.max("rows").alias("rows")
    )
    return (
        windows.select("run")
        .join(found, "run", "left")
        .select(
            "run",
            *QUANTILES,
            "max_us",
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.when(F.col("rows").isNull(), F.lit("no rows in window")).alias("refusal"),
        )
    )


def run_rates(runs: DataFrame) -> DataFrame:
    """Rates of one window from ``rows, window_ms, cpu_us``; all three derive from the same interval."""
    seconds = F.col("window_ms") / 1000.0
    rows = F.col("rows").cast("double")
    cores = F.col("cpu_us") / (seconds * 1e6)
    rate = rows / seconds
    return runs.select(
        "*",
        F.when(F.col("window_ms") > 0, rate).otherwise(F.lit(0.0)).alias("rows_per_s"),
        F.when(F.col("rows") > 0, F.col("cpu_us") / rows).alias("cpu_us_per_row"),
        F.when(F.col("window_ms") > 0, cores).alias("cores_used"),
        F.when((F.col("window_ms") > 0) & (F.col("cpu_us") > 0), rate / cores).otherwise(F.lit(0.0)).alias(
            "rows_per_s_per_core"
        ),
    )


def kept_up(runs: DataFrame) -> DataFrame:
    """Share of the offered rate that landed; below 0.98 the run was saturated.

    Reads ``rows, window_ms, offered_msgs_per_s, expected_rows, batches``, the last two giving the
    rows one message is worth.
    """
    offered = F.col("offered_msgs_per_s") * F.col("expected_rows") / F.col("batches")
    share = (F.col("rows") / (F.col("window_ms") / 1000.0)) / offered
    return runs.withColumn("offered_rows_per_s", offered.cast("double")).withColumn(
        "kept_up_share", F.when(F.col("offered_rows_per_s") > 0, share).otherwise(F.lit(0.0))
    ).withColumn("saturated", F.col("kept_up_share") < S.SATURATED_BELOW)


def mode_metrics(runs: DataFrame) -> DataFrame:
    """The metrics only a sustained run has, as a map; empty for a drain.

    A saturated run's subtraction measures the age of its backlog, so the names say so.
    """
    prefix = F.when(F.col("saturated"), F.lit("backlog_age")).otherwise(F.lit("latency"))
    pairs = [
        (F.lit("kept_up_share"), F.col("kept_up_share")),
        (F.lit("offered_rows_per_s"), F.col("offered_rows_per_s")),
        (F.lit("max_schedule_lag_us"), F.col("max_schedule_lag_us").cast("double")),
        *[(F.concat(prefix, F.lit(f"_{n}")), F.col(n).cast("double")) for n in [*QUANTILES, "max_us"]],
        (F.concat(prefix, F.lit("_rows")), F.col("rows").cast("double")),
    ]
    sustained = F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<double>")
    )
    return runs.withColumn("mode_metrics", F.when(F.col("mode") == "sustained", sustained).otherwise(empty))


# Polling: a table (run, tick, rows) with one poll per second, ``rows`` null where unreadable.
# Every loop below ends at its deadline, so a run has at most that many distinct ticks however many
# rows the table holds for it; polls are reduced to one per tick before anything is ordered.


def _polls(polls: DataFrame, deadline_s: int) -> DataFrame:
    per_tick = polls.groupBy("run", "tick").agg(F.max("rows").alias("rows"))
    first = per_tick.groupBy("run").agg(F.min("tick").alias("opened"))
    return per_tick.join(first, "run").filter(F.col("tick") - F.col("opened") <= deadline_s)


def _with_beyond(ends: DataFrame, polls: DataFrame, deadline_s: int) -> DataFrame:
    """Adds ``polls_beyond``: how many of the run's ticks lay past the deadline and so had no say."""
    per_tick = polls.select("run", "tick").distinct()
    first = per_tick.groupBy("run").agg(F.min("tick").alias("opened"))
    late = per_tick.join(first, "run").groupBy("run").agg(
        F.count_if(F.col("tick") - F.col("opened") > deadline_s).alias("polls_beyond")
    )
    return ends.join(late, "run")


def _poll_order() -> Window:
    return Window.partitionBy("run").orderBy("tick")


def _unreadable_streak(order: Window) -> Column:
    """True on the poll that makes five unreadable in a row."""
    streak = F.col("rows").isNull()
    for back in range(1, S.PROBE_MAX_FAILURES):
        streak = streak & F.lag(F.col("rows").isNull(), back).over(order)
    return F.coalesce(streak, F.lit(False))


def quiesce_point(polls: DataFrame) -> DataFrame:
    """Per run: when three polls running repeated the last readable count, or why that never came.

    An unreadable poll starts the three over but is not itself a change.
    """
    order = _poll_order()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    polled = _polls(polls, S.QUIESCE_MAX_S)
    steps = polled.withColumn(
        "same", F.col("rows").eqNullSafe(F.last("rows", ignorenulls=True).over(before)) & F.col("rows").isNotNull()
    ).withColumn("gave_up", _unreadable_streak(order))
    settled = F.col("same") & F.lag("same", 1).over(order) & F.lag("same", 2).over(order)
    steps = steps.withColumn("settled", F.coalesce(settled, F.lit(False)))
    ends = steps.groupBy("run").agg(
        F.min(F.when(F.col("settled"), F.col("tick"))).alias("settled_at"),
        F.min(F.when(F.col("gave_up"), F.col("tick"))).alias("gave_up_at"),
        F.max_by("rows", F.when(F.col("rows").isNotNull(), F.col("tick"))).alias("last_rows"),
        F.max_by("rows", F.when(F.col("settled"), -F.col("tick"))).alias("settled_rows"),
    )
    refused = F.col("gave_up_at").isNotNull() & (
        F.col("settled_at").isNull() | (F.col("gave_up_at") < F.col("settled_at"))
    )
    never_read = F.col("last_rows").isNull()
    outcome = ends.select(
        "run",
        F.when(~refused, F.col("settled_at")).alias("settled_at"),
        F.when(~refused, F.coalesce("settled_rows", "last_rows")).alias("rows"),
        F.when(refused, F.lit("unreadable"))
        .when(never_read, F.lit("never read"))
        .when(F.col("settled_at").isNull(), F.lit("not settled"))
        .otherwise(F.lit("settled"))
        .alias("outcome"),
    )
    return _with_beyond(outcome, polls, S.QUIESCE_MAX_S)


def warmup_point(polls: DataFrame) -> DataFrame:
    """Per run: the poll completing three increases running between adjacent readable polls."""
    order = _poll_order()
    steps = _polls(polls, S.WARMUP_MAX_S).withColumn(
        "rose", F.coalesce(F.col("rows") > F.lag("rows").over(order), F.lit(False))
    )
    warm = F.col("rose") & F.lag("rose", 1).over(order) & F.lag("rose", 2).over(order)
    outcome = (
        steps.withColumn("warm", F.coalesce(warm, F.lit(False)))
        .groupBy("run")
        .agg(F.min(F.when(F.col("warm"), F.col("tick"))).alias("warm_at"))
        .withColumn("outcome", F.when(F.col("warm_at").isNull(), F.lit("did not start")).otherwise(F.lit("warm")))
    )
    return _with_beyond(outcome, polls, S.WARMUP_MAX_S)


def drain_complete(polls: DataFrame, expected: str = "expected_rows") -> DataFrame:
    """Per run: the first poll at or past the expected count, unless probing failed or time ran out.

    ``polls`` carries the run's expected count in every row.
    """
    order = _poll_order()
    wanted = polls.groupBy("run").agg(F.max(expected).alias(expected))
    steps = _polls(polls, S.DRAIN_MAX_S).withColumn("gave_up", _unreadable_streak(order)).join(wanted, "run")
    ends = steps.groupBy("run").agg(
        F.min(F.when(F.col("rows") >= F.col(expected), F.col("tick"))).alias("done_at"),
        F.min(F.when(F.col("gave_up"), F.col("tick"))).alias("gave_up_at"),
    )
    refused = F.col("gave_up_at").isNotNull() & (
        F.col("done_at").isNull() | (F.col("gave_up_at") < F.col("done_at"))
    )
    outcome = ends.select(
        "run",
        F.when(~refused, F.col("done_at")).alias("done_at"),
        F.when(refused, F.lit("unreadable"))
        .when(F.col("done_at").isNull(), F.lit("timed out"))
        .otherwise(F.lit("drained"))
        .alias("outcome"),
    )
    return _with_beyond(outcome, polls, S.DRAIN_MAX_S)


def load_report(sends: DataFrame) -> DataFrame:
    """Per run, from a send log ``(run, due_us, actual_us, failed, rate)``.

    The achieved share is recomputed from the totals, never averaged from parts.
    """
    totals = sends.groupBy("run").agg(
        F.count("*").alias("sent"),
        F.count_if(~F.col("failed")).alias("delivered"),
        F.count_if(F.col("failed")).alias("failed"),
        F.max("rate").alias("rate"),
        (F.max("actual_us") - F.min("due_us")).alias("elapsed_us"),
        F.max(F.col("actual_us") - F.col("due_us")).alias("max_lag_us"),
    )
    # sent / (rate * elapsed) < 0.99, kept in integers
    behind = F.col("sent") * 100_000_000 < F.col("rate") * F.col("elapsed_us") * 99
    share = F.when(
        F.col("elapsed_us") > 0, F.col("sent") / (F.col("rate") * (F.col("elapsed_us") / 1e6))
    )
    return totals.select(
        "*",
        share.alias("achieved_share"),
        F.when(F.col("failed") > 0, F.lit("failed sends"))
        .when(behind, F.lit("generator too slow"))
        .alias("refusal"),
    )


def topic_depth(offsets: DataFrame) -> DataFrame:
    """Messages held per topic: high minus low over its partitions, and summed."""
    per_partition = offsets.groupBy("topic", "partition").agg(
        (F.max("offset") - F.min("offset") + 1).alias("depth")
    )
    return per_partition.groupBy("topic").agg(
        F.count("*").alias("partitions"), F.sum("depth").alias("depth")
    )


def backlog_window(depths: DataFrame, *, threads: int, msgs_per_s: int, request_s: int) -> DataFrame:
    """How long a backlog lasts: the first consumer to run dry, less a 30 percent margin.

    ``depths`` is ``(topic, partition, depth)``, one row each. Partitions are dealt to threads
    round-robin and every consumer reads at the rate's share for the partitions it was dealt.
    """
    per_thread = depths.groupBy("topic", F.pmod("partition", F.lit(threads)).alias("thread")).agg(
        F.sum("depth").alias("assigned"), F.count("*").alias("streams")
    )
    # assigned / (rate * streams / all_streams): the soonest is the smallest assigned / streams
    soonest = per_thread.groupBy("topic").agg(
        F.min(F.col("assigned") / F.col("streams")).alias("_leanest"),
        F.sum("streams").alias("streams"),
        F.sum("assigned").alias("depth"),
    )
    dry_s = F.col("_leanest") * F.col("streams") / msgs_per_s
    return soonest.select(
        "topic",
        "streams",
        "depth",
        F.when(F.col("depth") == 0, F.lit(float(request_s)))
        .otherwise(F.least(dry_s * 0.70, F.lit(float(request_s))))
        .alias("window_s"),
    )
