"""Window, poll, load and resource queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanout.operators import resources, windows
from fanout.plans import inputs
from fanout.plans.oracle import COSTS, DECLARED, EV, LATENCY, OFFSETS, POLLS, RUN_WINDOWS, RUNS, SENDS, SERIES, with_views
from fanout.session import kept

# 2024-01-05 to 2024-01-25, in epoch milliseconds
FROM_MS, TO_MS = 1_704_412_800_000, 1_706_140_800_000


def rows_in_window(spark, sf):
    return windows.rows_in_window(inputs.latency_rows(spark, sf), ["run"], FROM_MS, TO_MS)


def latency_window(spark, sf):
    """Whether each sketched quantile keeps its promise; ``latency_exact`` has the exact ones."""
    return windows.latency_checked(inputs.latency_rows(spark, sf), ["run"], FROM_MS, TO_MS)


SPANS_MS = {"whole": (FROM_MS, TO_MS), "day": (FROM_MS, FROM_MS + 86_400_000), "hours": (FROM_MS + 360_000_000, FROM_MS + 378_000_000)}


def latency_sketches(spark, sf):
    """Three spans read from one stored table of sketches a minute; whether each quantile keeps the sketch's promise."""
    landed = inputs.latency_rows(spark, sf)
    sketches = kept(windows.latency_sketches(landed, ["run"]))
    spans = []
    for name, (lo, hi) in SPANS_MS.items():
        found = windows.sketched_latency(sketches, ["run"], lo // windows.MINUTE_MS, hi // windows.MINUTE_MS)
        checked = windows.within_rank_error(found, landed, ["run"], lo, hi, windows.SKETCH_RANK_ERROR)
        spans.append(checked.withColumn("span", F.lit(name)))
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def latency_exact(spark, sf):
    return windows.latency_exact(inputs.latency_rows(spark, sf), ["run"], FROM_MS, TO_MS)


def latency_max(spark, sf):
    """The exact half of the approximate summary."""
    return windows.latency(inputs.latency_rows(spark, sf), ["run"], FROM_MS, TO_MS).select("run", "max_us", "rows")


def run_window_rows(spark, sf):
    return windows.rows_by_run(inputs.latency_rows(spark, sf), inputs.run_windows(spark, sf))


def run_window_latency(spark, sf):
    return windows.latency_by_run(inputs.latency_rows(spark, sf), inputs.run_windows(spark, sf))


def sampler_window(spark, sf):
    return resources.sampler_window(inputs.series(spark, sf))


def run_rates(spark, sf):
    rates = windows.run_rates(inputs.runs(spark, sf))
    return rates.select("run", "rows", "rows_per_s", "cpu_us_per_row", "cores_used", "rows_per_s_per_core")


def kept_up(spark, sf):
    return windows.kept_up(inputs.runs(spark, sf)).select("run", "offered_rows_per_s", "kept_up_share", "saturated")


def mode_metrics(spark, sf):
    named = windows.mode_metrics(windows.kept_up(inputs.runs(spark, sf)))
    return named.select("run", F.explode("mode_metrics").alias("metric", "value"))


def quiesce_point(spark, sf):
    return windows.quiesce_point(inputs.polls(spark, sf))


def warmup_point(spark, sf):
    return windows.warmup_point(inputs.polls(spark, sf))


def drain_complete(spark, sf):
    return windows.drain_complete(inputs.polls(spark, sf))


def load_report(spark, sf):
    return windows.load_report(inputs.sends(spark, sf))


def backlog_window(spark, sf):
    depths = inputs.offsets(spark, sf).groupBy("topic", "partition").agg(
        (F.max("offset") - F.min("offset") + 1).alias("depth")
    )
    return windows.backlog_window(depths, threads=3, msgs_per_s=64, request_s=60)


def readable_samples(spark, sf):
    return resources.readable_samples(inputs.series(spark, sf))


def container_cost(spark, sf):
    return resources.container_cost(inputs.series(spark, sf))


def arm_cost(spark, sf):
    costs = resources.container_cost(inputs.series(spark, sf))
    return resources.arm_cost(costs, inputs.declared_containers(spark, sf))


def data_plane_cost(spark, sf):
    costs = resources.container_cost(inputs.series(spark, sf))
    return resources.data_plane_cost(costs, inputs.declared_containers(spark, sf))


def simultaneous_peak(spark, sf):
    return resources.simultaneous_peak(inputs.series(spark, sf))


def cap_check(spark, sf):
    return resources.cap_check(inputs.cap_readings(spark, sf), inputs.cap_declared(spark, sf))


def cores_between(spark, sf):
    ok = inputs.series(spark, sf).filter("usage_usec >= 0").withColumn("cap_cores", F.lit(2.0))
    return resources.cores_between(ok)


QUERIES = {
    "rows_in_window": rows_in_window,
    "latency_window": latency_window,
    "latency_sketches": latency_sketches,
    "latency_exact": latency_exact,
    "latency_max": latency_max,
    "run_window_rows": run_window_rows,
    "run_window_latency": run_window_latency,
    "sampler_window": sampler_window,
    "run_rates": run_rates,
    "kept_up": kept_up,
    "mode_metrics": mode_metrics,
    "quiesce_point": quiesce_point,
    "warmup_point": warmup_point,
    "drain_complete": drain_complete,
    "load_report": load_report,
    "backlog_window": backlog_window,
    "readable_samples": readable_samples,
    "container_cost": container_cost,
    "arm_cost": arm_cost,
    "data_plane_cost": data_plane_cost,
    "simultaneous_peak": simultaneous_peak,
    "cap_check": cap_check,
    "cores_between": cores_between,
}

_IN = f"ingest_us >= {FROM_MS}000 AND ingest_us < {TO_MS}000"
_OFFERED = "offered_msgs_per_s * expected_rows / batches"
_SHARE = f"""CASE WHEN {_OFFERED} > 0 THEN ("rows" / (window_ms / 1000.0::DOUBLE)) / ({_OFFERED}) ELSE 0.0::DOUBLE END"""
_FIVE = """n IS NULL AND p1 IS NULL AND p2 IS NULL AND p3 IS NULL AND p4 IS NULL AND rn >= 5"""


def _stepped(limit: int) -> str:
    lags = ", ".join(f"lag(n, {i}) OVER w p{i}" for i in range(1, 5))
    return f"""stepped AS (SELECT *, {lags}, row_number() OVER w rn, last_value(n IGNORE NULLS) OVER (PARTITION BY run ORDER BY tick
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen FROM polls WHERE since <= {limit}
      WINDOW w AS (PARTITION BY run ORDER BY tick)),
      beyond AS (SELECT run, count(*) FILTER (since > {limit}) polls_beyond FROM polls GROUP BY run)"""


ORACLES = {
    "rows_in_window": with_views(EV, LATENCY) + f'SELECT run, count(*) "rows" FROM lat WHERE {_IN} GROUP BY 1',
    "latency_exact": with_views(EV, LATENCY)
    + f"""SELECT run, quantile_disc(l, 0.5) p50_us, quantile_disc(l, 0.99) p99_us, quantile_disc(l, 0.999) p999_us, max(l) max_us,
      count(*) "rows" FROM (SELECT run, ingest_us - send_us l FROM lat WHERE {_IN}) GROUP BY 1""",
    "latency_window": with_views(EV, LATENCY)
    + f"""SELECT run, true p50_within, true p99_within, true p999_within, max(ingest_us - send_us) max_us, count(*) "rows" FROM lat
      WHERE {_IN} GROUP BY 1""",
    "latency_sketches": with_views(EV, LATENCY)
    + " UNION ALL ".join(
        f"""SELECT '{name}' span, run, true p50_within, true p99_within, true p999_within, max(ingest_us - send_us) max_us, count(*) "rows"
      FROM lat WHERE ingest_us >= {lo}000 AND ingest_us < {hi}000 GROUP BY run"""
        for name, (lo, hi) in SPANS_MS.items()
    ),
    "latency_max": with_views(EV, LATENCY)
    + f'SELECT run, max(ingest_us - send_us) max_us, count(*) "rows" FROM lat WHERE {_IN} GROUP BY 1',
    "run_window_rows": with_views(EV, SERIES, RUN_WINDOWS, LATENCY)
    + """SELECT w.run, from_ms, to_ms, count(ingest_us) "rows" FROM run_windows w
      LEFT JOIN lat ON ingest_us >= from_ms * 1000 AND ingest_us < to_ms * 1000 GROUP BY ALL""",
    "run_window_latency": with_views(EV, SERIES, RUN_WINDOWS, LATENCY)
    + """SELECT w.run, quantile_disc(l, 0.5) p50_us, quantile_disc(l, 0.99) p99_us, quantile_disc(l, 0.999) p999_us, max(l) max_us,
      count(l) "rows", CASE WHEN count(l) = 0 THEN 'no rows in window' END refusal FROM run_windows w
      LEFT JOIN (SELECT ingest_us, ingest_us - send_us l FROM lat) ON ingest_us >= from_ms * 1000 AND ingest_us < to_ms * 1000 GROUP BY 1""",
    "sampler_window": with_views(EV, SERIES)
    + """SELECT arm, CASE WHEN good THEN a END from_ms, CASE WHEN good THEN z END to_ms FROM (SELECT arm, min(a) a, max(z) z,
      bool_and(a IS NOT NULL) AND min(a) < max(z) good FROM (SELECT arm, container, min(t_ms) FILTER (ok) a, max(t_ms) FILTER (ok) z
      FROM series GROUP BY ALL) GROUP BY arm)""",
    "run_rates": with_views(EV, RUNS)
    + """SELECT run, "rows", CASE WHEN window_ms > 0 THEN r / s ELSE 0 END rows_per_s, CASE WHEN r > 0 THEN cpu_us / r END cpu_us_per_row,
      CASE WHEN window_ms > 0 THEN cpu_us / (s * 1e6) END cores_used,
      CASE WHEN window_ms > 0 AND cpu_us > 0 THEN (r / s) / (cpu_us / (s * 1e6)) ELSE 0 END rows_per_s_per_core
      FROM (SELECT *, CAST("rows" AS DOUBLE) r, window_ms / 1000.0::DOUBLE s FROM runs)""",
    "kept_up": with_views(EV, RUNS)
    + f"SELECT run, {_OFFERED} offered_rows_per_s, {_SHARE} kept_up_share, ({_SHARE}) < 0.98 saturated FROM runs",
    "mode_metrics": with_views(EV, RUNS)
    + f"""SELECT run, metric, value FROM (SELECT run, unnest([
        {{'metric': 'kept_up_share', 'value': share}}, {{'metric': 'offered_rows_per_s', 'value': offered}},
        {{'metric': 'max_schedule_lag_us', 'value': max_schedule_lag_us::DOUBLE}}, {{'metric': pre || '_p50_us', 'value': p50_us::DOUBLE}},
        {{'metric': pre || '_p99_us', 'value': p99_us::DOUBLE}}, {{'metric': pre || '_p999_us', 'value': p999_us::DOUBLE}},
        {{'metric': pre || '_max_us', 'value': max_us::DOUBLE}}, {{'metric': pre || '_rows', 'value': "rows"::DOUBLE}}], recursive := true)
      FROM (SELECT *, CASE WHEN share < 0.98 THEN 'backlog_age' ELSE 'latency' END pre FROM
        (SELECT *, {_SHARE} share, {_OFFERED} offered FROM runs WHERE mode = 'sustained')))""",
    "quiesce_point": with_views(EV, POLLS, _stepped(900))
    + f""", same AS (SELECT *, n IS NOT NULL AND seen IS NOT NULL AND n = seen same FROM stepped),
      three AS (SELECT *, same AND lag(same) OVER w AND lag(same, 2) OVER w three FROM same WINDOW w AS (PARTITION BY run ORDER BY tick)),
      ended AS (SELECT run, min(tick) FILTER (three) s, min(tick) FILTER ({_FIVE}) g, arg_max(n, tick) FILTER (n IS NOT NULL) last_n,
        arg_min(n, tick) FILTER (three) settled_n FROM three GROUP BY run)
      SELECT run, CASE WHEN NOT refused THEN s END settled_at, CASE WHEN NOT refused THEN coalesce(settled_n, last_n) END AS "rows",
        CASE WHEN refused THEN 'unreadable' WHEN last_n IS NULL THEN 'never read' WHEN s IS NULL THEN 'not settled' ELSE 'settled' END outcome, polls_beyond
      FROM (SELECT *, g IS NOT NULL AND (s IS NULL OR g < s) refused FROM ended JOIN beyond USING (run))""",
    "warmup_point": with_views(EV, POLLS, _stepped(120))
    + """, rose AS (SELECT *, coalesce(n > p1 AND p1 > p2 AND p2 > p3, false) warm FROM stepped)
      SELECT run, min(tick) FILTER (warm) warm_at, CASE WHEN bool_or(warm) THEN 'warm' ELSE 'did not start' END outcome, any_value(polls_beyond) polls_beyond
      FROM rose JOIN beyond USING (run) GROUP BY run""",
    "drain_complete": with_views(EV, POLLS, _stepped(600))
    + f""", wanted AS (SELECT run, max(expected_rows) want FROM polls GROUP BY run),
      ended AS (SELECT run, min(tick) FILTER (n >= want) d, min(tick) FILTER ({_FIVE}) g FROM stepped JOIN wanted USING (run) GROUP BY run)
      SELECT run, CASE WHEN NOT refused THEN d END done_at, CASE WHEN refused THEN 'unreadable' WHEN d IS NULL THEN 'timed out'
        ELSE 'drained' END outcome, polls_beyond FROM (SELECT *, g IS NOT NULL AND (d IS NULL OR g < d) refused FROM ended JOIN beyond USING (run))""",
    "load_report": with_views(EV, SENDS)
    + """SELECT run, sent, delivered, failed, rate, elapsed_us, max_lag_us, sent / (rate * (elapsed_us / 1e6)) achieved_share,
      CASE WHEN failed > 0 THEN 'failed sends' WHEN sent * 100000000 < rate * elapsed_us * 99 THEN 'generator too slow' END refusal
      FROM (SELECT run, count(*) sent, count(*) FILTER (NOT failed) delivered, count(*) FILTER (failed) failed, CAST(max(rate) AS BIGINT) rate,
        max(actual_us) - min(due_us) elapsed_us, max(actual_us - due_us) max_lag_us FROM sends GROUP BY run)""",
    "backlog_window": with_views(EV, OFFSETS)
    + """, depths AS (SELECT topic, part, max(off) - min(off) + 1 depth FROM offsets GROUP BY ALL),
      threads AS (SELECT topic, part % 3 th, sum(depth) assigned, count(*) streams FROM depths GROUP BY ALL)
      SELECT topic, CAST(sum(streams) AS BIGINT) streams, CAST(sum(assigned) AS BIGINT) depth,
      least(min(assigned / streams) * sum(streams) / 64 * 0.70::DOUBLE, 60.0::DOUBLE) window_s FROM threads GROUP BY topic""",
    "readable_samples": with_views(EV, SERIES)
    + "SELECT arm, container, count(*) FILTER (ok) readable, count(*) FILTER (NOT ok) unreadable FROM series GROUP BY ALL",
    "container_cost": with_views(EV, SERIES, COSTS) + "SELECT * FROM costs",
    "arm_cost": with_views(EV, SERIES, COSTS, DECLARED)
    + """, parts AS (SELECT d.arm, d.container, c.* EXCLUDE (arm, container) FROM declared d LEFT JOIN costs c USING (arm, container)),
      whole AS (SELECT arm, bool_and(window_ms IS NOT NULL) g, count(*) containers, max(window_ms) w, sum(cpu_us) a, sum(user_us) b,
        sum(system_us) c, sum(throttled_us) d, sum(nr_throttled) e, sum(peak_anon) f, sum(peak_charged) h, sum(peak_current) i,
        min(samples) s, sum(coalesce(unreadable, 0)) u FROM parts GROUP BY arm)
      SELECT arm, containers, CASE WHEN g THEN w END window_ms, CAST(CASE WHEN g THEN a END AS BIGINT) cpu_us,
        CAST(CASE WHEN g THEN b END AS BIGINT) user_us, CAST(CASE WHEN g THEN c END AS BIGINT) system_us,
        CAST(CASE WHEN g THEN d END AS BIGINT) throttled_us, CAST(CASE WHEN g THEN e END AS BIGINT) nr_throttled,
        CAST(CASE WHEN g THEN f END AS BIGINT) peak_anon, CAST(CASE WHEN g THEN h END AS BIGINT) peak_charged,
        CAST(CASE WHEN g THEN i END AS BIGINT) peak_current, CASE WHEN g THEN s END samples, CAST(u AS BIGINT) unreadable,
        CASE WHEN g THEN CAST(a AS BIGINT) / (w * 1000.0::DOUBLE) END cores_used FROM whole""",
    "data_plane_cost": with_views(EV, SERIES, COSTS, DECLARED)
    + """SELECT arm, CAST(sum(cpu_us) AS BIGINT) cpu_us, CAST(sum(cpu_us) FILTER (role = 'data-plane') AS BIGINT) data_plane_cpu_us,
      CAST(sum(peak_anon) FILTER (role = 'data-plane') AS BIGINT) data_plane_peak_anon, max(window_ms) FILTER (role = 'data-plane') data_plane_window_ms
      FROM declared JOIN costs USING (arm, container) GROUP BY arm""",
    # grid of every second an arm has a sample in, each container's last reading carried into it
    "simultaneous_peak": with_views(EV, SERIES)
    + """, rd AS (SELECT arm, container, (t_ms - min(t_ms) OVER (PARTITION BY arm)) // 1000 bucket, t_ms, line, anon FROM series WHERE ok),
      held AS (SELECT arm, container, bucket, arg_max(anon, line) anon FROM rd GROUP BY ALL),
      grid AS (SELECT * FROM (SELECT DISTINCT arm, bucket FROM held) JOIN (SELECT DISTINCT arm, container FROM held) USING (arm)),
      carried AS (SELECT g.arm, g.bucket, h.anon FROM grid g ASOF JOIN held h ON g.arm = h.arm AND g.container = h.container AND g.bucket >= h.bucket),
      totals AS (SELECT arm, bucket, sum(anon) total FROM carried GROUP BY ALL)
      SELECT arm, CAST(max(total) AS BIGINT) peak_anon FROM totals GROUP BY arm""",
    "cap_check": """SELECT 'c-' || c container, cores, CASE WHEN c % 7 = 0 THEN 'no cpu.max' WHEN c % 5 = 0 THEN 'no memory.max'
        WHEN cores IS NULL OR c % 11 = 0 THEN 'cpus differ' WHEN c % 13 = 0 THEN 'memory differs' END problem
      FROM (SELECT c_custkey c, CASE WHEN c_custkey % 7 NOT IN (0, 1) THEN (c_custkey % 4 + 1)::DOUBLE END cores FROM customer)""",
    "cores_between": with_views(EV, SERIES)
    + """, p AS (SELECT arm, container, arg_min((t_ms, usage_usec, user_usec, system_usec), line) a, arg_max((t_ms, usage_usec, user_usec, system_usec), line) z
        FROM series WHERE ok GROUP BY ALL),
      q AS (SELECT arm, container, (z[1] - a[1]) * 1000 el, greatest(z[2] - a[2], 0) used, greatest(z[3] - a[3], 0) us, greatest(z[4] - a[4], 0) sy FROM p)
      SELECT arm, container, CASE WHEN el > 0 THEN used / el END cores, CASE WHEN el > 0 THEN used / el / 2.0::DOUBLE END share_of_cap,
        CASE WHEN us + sy > 0 THEN us / (us + sy) END user_share FROM q""",
}
