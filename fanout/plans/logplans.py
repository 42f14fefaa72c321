"""Server-log and collector-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanout.operators import logs
from fanout.operators.transform import land
from fanout.operators.windows import in_ms_window
from fanout.plans import inputs
from fanout.plans.oracle import EV, FEED, FEED_LANDED, GC, QUERY_LOG, RUN_WINDOWS, SERIES, with_views
from fanout.schemas import PROFILE_COUNTERS

# 2024-01-05 to 2024-01-25
FROM_MS, TO_MS = 1_704_412_800_000, 1_706_140_800_000
TABLES = ["db.sensor_events", "db.landing"]


def profile_events_parse(spark, sf):
    parsed = logs.parse_profile_events(inputs.profile_text(spark, sf))
    shown = [F.try_element_at("counters", F.lit(c)).alias(c) for c in PROFILE_COUNTERS]
    return parsed.select("event_id", "malformed", F.size("counters").alias("entries"), *shown)


def _attributed(spark, sf, forwarded=False):
    return logs.attribute_inserts(inputs.query_log(spark, sf), TABLES, FROM_MS, TO_MS, forwarded=forwarded)


def insert_attribution(spark, sf):
    return _attributed(spark, sf).select(
        "event_id", "run", "type", F.array_join(F.array_sort(F.map_keys("counters")), ",").alias("counters")
    )


def insert_attribution_forwarded(spark, sf):
    return _attributed(spark, sf, forwarded=True).select("event_id", "run", "type")


def server_cost(spark, sf):
    return logs.server_cost(_attributed(spark, sf), ["run"])


def server_metrics_of(spark, sf):
    """Server cost against the rows that landed in the same window."""
    user = F.regexp_extract("sensor", r"([0-9]+)$", 1).cast("long")
    landed = (
        land(inputs.feed(spark, sf))
        .filter(in_ms_window("send_ts", FROM_MS, TO_MS))
        .groupBy(F.concat(F.lit("run-"), (user % 12).cast("string")).alias("run"))
        .agg(F.count("*").alias("rows"))
    )
    return logs.server_metrics(logs.server_cost(_attributed(spark, sf), ["run"]).join(landed, "run"))


def server_metrics(spark, sf):
    return server_metrics_of(spark, sf).select(
        "run",
        "server_cpu_us_per_row",
        "server_cpu_us_per_written_row",
        "server_rows_per_insert",
        "server_cpu_wait_us",
        "server_inserted_bytes",
    )


def part_log_summary(spark, sf):
    since = F.timestamp_millis(F.lit(915_148_800_000))
    return logs.part_log_summary(inputs.part_log(spark, sf), ["table"], since)


def network_wait(spark, sf):
    return logs.network_wait(inputs.query_log(spark, sf), ["run"], F.timestamp_millis(F.lit(FROM_MS)))


def run_window_attribution(spark, sf):
    """What the inserts of each run's own window cost the server; windows overlap."""
    log = inputs.query_log(spark, sf).withColumnRenamed("run", "writer")
    return logs.run_costs(log, inputs.run_windows(spark, sf), TABLES)


def run_window_network(spark, sf):
    log = inputs.query_log(spark, sf).withColumnRenamed("run", "writer")
    return logs.run_network_totals(log, inputs.run_windows(spark, sf))


def run_window_parts(spark, sf):
    return logs.run_part_totals(inputs.part_log(spark, sf), inputs.part_windows(spark, sf))


def query_log_by_date(spark, sf):
    """The same attribution over a log written by date, of which only the windows' days are read."""
    log = spark.read.parquet(inputs.dated_query_log(spark, sf)).withColumnRenamed("run", "writer")
    short = inputs.run_windows(spark, sf).filter("to_ms - from_ms < 3600000 and from_ms % 23 = 0")
    inserts = logs.attribute_to_runs(log, short, TABLES)
    return inserts.select("run", "event_id", "event_date", "type", "written_rows")


def settle_reading(spark, sf):
    return logs.settle_reading(inputs.settle_rungs(spark, sf), ["format"])


def _split(spark, sf):
    return logs.gc_lines(inputs.gc_text(spark, sf))


def gc_lines(spark, sf):
    return _split(spark, sf).select(
        "line_no", "run", "container", "kind", "uptime_s", "tags"
    )


def gc_heap_config(spark, sf):
    return logs.gc_heap_config(_split(spark, sf))


def gc_pauses(spark, sf):
    return logs.gc_pauses(_split(spark, sf))


def gc_summary(spark, sf):
    return logs.gc_summary(_split(spark, sf))


def gc_summary_window(spark, sf):
    """The same, over pauses in the first half of the time that the log's pauses span."""
    ends = logs.gc_pauses(_split(spark, sf)).agg(F.min("uptime_s").alias("a"), F.max("uptime_s").alias("z")).first()
    return logs.gc_summary(_split(spark, sf), (ends.a, (ends.a + ends.z) / 2)).select(
        "run", "container", "pauses", "total_ns", "p50_ns", "from_uptime_s", "to_uptime_s", "refusal"
    )


def gc_by_label(spark, sf):
    return logs.gc_by_label(logs.gc_pauses(_split(spark, sf)))


QUERIES = {
    "profile_events_parse": profile_events_parse,
    "insert_attribution": insert_attribution,
    "insert_attribution_forwarded": insert_attribution_forwarded,
    "server_cost": server_cost,
    "server_metrics": server_metrics,
    "part_log_summary": part_log_summary,
    "network_wait": network_wait,
    "run_window_attribution": run_window_attribution,
    "run_window_network": run_window_network,
    "run_window_parts": run_window_parts,
    "query_log_by_date": query_log_by_date,
    "settle_reading": settle_reading,
    "gc_lines": gc_lines,
    "gc_heap_config": gc_heap_config,
    "gc_pauses": gc_pauses,
    "gc_summary": gc_summary,
    "gc_summary_window": gc_summary_window,
    "gc_by_label": gc_by_label,
}

_ATTRIBUTED = f"""att AS (SELECT * FROM qlog WHERE ts >= make_timestamp({FROM_MS}000) AND ts < make_timestamp({TO_MS}000)
  AND is_insert AND list_has_any(tabs, ['db.sensor_events', 'db.landing']))"""
_SERVER = """fin AS (SELECT run, count(*) FILTER (f) queries, count(*) FILTER (kind = 'QueryStart') started,
    count(*) FILTER (kind LIKE 'Exception%') failed, sum(written_rows) FILTER (f) written_rows,
    sum(coalesce(c_user, 0) + coalesce(c_sys, 0)) FILTER (f AND (c_user IS NOT NULL OR c_sys IS NOT NULL)) cpu_us,
    sum(c_user) FILTER (f) user_us, sum(c_sys) FILTER (f) system_us, sum(c_bytes) FILTER (f) inserted_bytes,
    count(*) FILTER (f AND c_user IS NULL AND c_sys IS NULL) queries_without_cpu, count(*) FILTER (f AND c_async > 0) async_q
    FROM (SELECT *, kind = 'QueryFinish' f FROM att WHERE is_initial) GROUP BY run),
  server AS (SELECT *, refusal IS NULL fine FROM (SELECT *, CASE WHEN queries = 0 THEN 'no attributed inserts' WHEN async_q > 0 THEN 'async inserts'
    WHEN queries = queries_without_cpu THEN 'no cpu counters' END refusal FROM fin))"""
_MET = """met AS (SELECT q.* EXCLUDE (run), w.run FROM qlog q JOIN run_windows w ON {} )"""
_MET_START = _MET.format("ts >= make_timestamp(from_ms * 1000) AND ts < make_timestamp(to_ms * 1000)")
_MET_AFTER = _MET.format("ts > make_timestamp(from_ms * 1000) AND ts < make_timestamp(to_ms * 1000)")
_MET_ATTRIBUTED = "att AS (SELECT * FROM met WHERE is_insert AND list_has_any(tabs, ['db.sensor_events', 'db.landing']))"
_BIG = "CAST(CASE WHEN fine THEN {} END AS BIGINT) {}"
_NULL = "CAST(NULL AS BIGINT) {}"

_HEAP = """init AS (SELECT *, CASE WHEN u % 5 <> 4 THEN k % 5 END slot FROM shapes WHERE is_init),
  heap AS (SELECT run, container, max('G1') FILTER (slot = 0) collector, arg_max('25.0.' || k, e) FILTER (slot = 2) AS version,
    arg_max(k * 1048576, e) FILTER (slot = 3) initial_bytes, max(8 * 1048576) FILTER (slot = 4) min_bytes,
    arg_max((k + 100) * 1048576, e) FILTER (slot = 1) max_bytes FROM init GROUP BY ALL),
  files AS (SELECT run, container, count(*) FILTER (kind IN ('gc', 'other')) decorated, count(*) FILTER (kind = 'gc') gc_lines,
    count(*) FILTER (kind = 'foreign') "foreign" FROM shapes GROUP BY ALL)"""


def _gc_totals(where: str) -> str:
    return f"""good AS (SELECT * FROM pauses WHERE NOT broken AND {where}),
  flaws AS (SELECT run, container, count(*) FILTER (broken) bad FROM pauses GROUP BY ALL),
  tot AS (SELECT run, container, count(*) pauses, CAST(sum(pause_ns) AS BIGINT) total_ns, max(pause_ns) max_ns,
    quantile_disc(pause_ns, 0.5) p50_ns, quantile_disc(pause_ns, 0.99) p99_ns, quantile_disc(pause_ns, 0.999) p999_ns,
    arg_max(label, pause_ns * 100000000000::HUGEINT + line_no) max_label, arg_min(uptime_s, line_no) from_uptime_s, arg_max(uptime_s, line_no) to_uptime_s,
    max((k + 60) * 1048576) FILTER (heap) peak_committed_bytes, max((k + 40) * 1048576) FILTER (heap) peak_occupancy_bytes,
    max(k * 1024) FILTER (heap) peak_live_bytes FROM good GROUP BY ALL),
  judged AS (SELECT f.*, h.* EXCLUDE (run, container), t.* EXCLUDE (run, container), CASE WHEN decorated = 0 THEN 'not unified logging'
      WHEN bad > 0 THEN 'unreadable pause' WHEN gc_lines = 0 THEN 'no gc lines'
      WHEN collector IS NULL AND max_bytes IS NULL THEN 'no collector initialised' END refusal
    FROM files f LEFT JOIN heap h USING (run, container) LEFT JOIN flaws USING (run, container) LEFT JOIN tot t USING (run, container))"""


_FINE = "CASE WHEN refusal IS NULL THEN {} END {}"

_COST = f"""SELECT run, queries, started, failed, greatest(started - queries - failed, 0) in_flight, queries_without_cpu,
      {_BIG.format('written_rows', 'written_rows')}, {_BIG.format('cpu_us', 'cpu_us')}, {_BIG.format('coalesce(user_us, 0)', 'user_us')},
      {_BIG.format('coalesce(system_us, 0)', 'system_us')}, {_NULL.format('real_us')}, {_NULL.format('os_cpu_virtual_us')},
      {_NULL.format('os_cpu_wait_us')}, {_NULL.format('inserted_rows')}, {_BIG.format('inserted_bytes', 'inserted_bytes')}, refusal FROM server"""

ORACLES = {
    "profile_events_parse": with_views(EV)
    + """SELECT e event_id, k % 11 IN (1, 2, 3) malformed, CAST(CASE WHEN k % 11 IN (1, 2, 3) THEN NULL WHEN k % 11 = 0 THEN 0
      WHEN k % 11 = 4 THEN 1 ELSE 2 END AS INTEGER) entries, CASE WHEN k % 11 > 4 THEN k END UserTimeMicroseconds,
      CASE WHEN k % 11 > 4 THEN k*3 END SystemTimeMicroseconds, CASE WHEN k % 11 = 4 THEN k*2 END InsertedRows,
      """
    + ", ".join(_NULL.format(c) for c in PROFILE_COUNTERS if c not in ("UserTimeMicroseconds", "SystemTimeMicroseconds", "InsertedRows"))
    + " FROM ev",
    "insert_attribution": with_views(EV, QUERY_LOG, _ATTRIBUTED)
    + """SELECT e event_id, run, kind AS type, concat_ws(',', CASE WHEN c_async IS NOT NULL THEN 'AsyncInsertQuery' END,
      CASE WHEN c_bytes IS NOT NULL THEN 'InsertedBytes' END, CASE WHEN c_sys IS NOT NULL THEN 'SystemTimeMicroseconds' END,
      CASE WHEN c_user IS NOT NULL THEN 'UserTimeMicroseconds' END) counters FROM att WHERE is_initial""",
    "insert_attribution_forwarded": with_views(EV, QUERY_LOG, _ATTRIBUTED)
    + "SELECT e event_id, run, kind AS type FROM att WHERE NOT is_initial",
    "server_cost": with_views(EV, QUERY_LOG, _ATTRIBUTED, _SERVER) + _COST,
    "run_window_attribution": with_views(EV, SERIES, RUN_WINDOWS, QUERY_LOG, _MET_START, _MET_ATTRIBUTED, _SERVER) + _COST,
    "run_window_network": with_views(EV, SERIES, RUN_WINDOWS, QUERY_LOG, _MET_AFTER)
    + """SELECT run, count(*) inserts, CAST(sum(duration_ms) AS BIGINT) duration_ms, CAST(sum(c_net) AS BIGINT) waiting_us FROM met
      WHERE kind = 'QueryFinish' AND is_insert GROUP BY run""",
    "run_window_parts": """SELECT run, "table", count(*) FILTER (l_returnflag = 'A') parts_written,
      CAST(coalesce(sum(q) FILTER (l_returnflag = 'A'), 0) AS BIGINT) rows_written, count(*) FILTER (l_returnflag = 'N') merges,
      CAST(coalesce(sum(q) FILTER (l_returnflag = 'N'), 0) AS BIGINT) rows_merged
      FROM (SELECT 't' || (l_suppkey % 3) "table", l_returnflag, CAST(l_quantity AS BIGINT) q, epoch_us(CAST(l_shipdate AS TIMESTAMP)) shipped FROM lineitem)
      JOIN (SELECT 'p-' || l_orderkey run, epoch_us(CAST(l_shipdate AS TIMESTAMP)) d, CAST(l_quantity AS BIGINT) n_days FROM lineitem
        WHERE l_orderkey % 400 = 0 AND l_linenumber = 1) ON shipped > d - 1000 AND shipped < d + n_days * 86400000000
      GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag = 'A') > 0""",
    "query_log_by_date": with_views(EV, SERIES, RUN_WINDOWS, QUERY_LOG, _MET_START, _MET_ATTRIBUTED)
    + """SELECT a.run, e event_id, event_date, kind AS type, written_rows FROM att a JOIN run_windows w ON w.run = a.run
      WHERE is_initial AND to_ms - from_ms < 3600000 AND from_ms % 23 = 0""",
    "server_metrics": with_views(EV, FEED, FEED_LANDED, QUERY_LOG, _ATTRIBUTED, _SERVER)
    + f"""SELECT run, CASE WHEN fine THEN CAST(cpu_us AS BIGINT) / n END server_cpu_us_per_row,
      CASE WHEN fine THEN CAST(cpu_us AS BIGINT) / CAST(written_rows AS BIGINT) END server_cpu_us_per_written_row,
      CASE WHEN queries = 0 THEN 0.0::DOUBLE WHEN fine THEN CAST(written_rows AS BIGINT) / queries END server_rows_per_insert,
      {_NULL.format('server_cpu_wait_us')}, {_BIG.format('inserted_bytes', 'server_inserted_bytes')}
      FROM server JOIN (SELECT 'run-' || (CAST(substr(sensor, 8) AS BIGINT) % 12) run, count(*) n FROM fl
        WHERE send_ts >= make_timestamp({FROM_MS}000) AND send_ts < make_timestamp({TO_MS}000) GROUP BY 1) USING (run)""",
    "part_log_summary": """SELECT "table", count(*) FILTER (l_returnflag = 'A') parts_written,
      CAST(coalesce(sum(q) FILTER (l_returnflag = 'A'), 0) AS BIGINT) rows_written, count(*) FILTER (l_returnflag = 'N') merges,
      CAST(coalesce(sum(q) FILTER (l_returnflag = 'N'), 0) AS BIGINT) rows_merged
      FROM (SELECT 't' || (l_suppkey % 3) "table", l_returnflag, CAST(l_quantity AS BIGINT) q FROM lineitem WHERE l_shipdate > TIMESTAMP '1999-01-01')
      GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0""",
    "network_wait": with_views(EV, QUERY_LOG)
    + f"""SELECT run, count(*) inserts, CAST(sum(duration_ms) AS BIGINT) duration_ms, CAST(sum(c_net) AS BIGINT) waiting_us FROM qlog
      WHERE kind = 'QueryFinish' AND is_insert AND ts > make_timestamp({FROM_MS}000) GROUP BY run""",
    "settle_reading": """SELECT format, w max_wait_us, max(c) at_concurrency FROM (SELECT 'fmt-' || (l_suppkey % 7) format,
      l_partkey % 500 wait, CAST(l_linenumber AS BIGINT) c, max(l_partkey % 500) OVER (PARTITION BY l_suppkey % 7) w FROM lineitem)
      WHERE wait = w GROUP BY ALL""",
    "gc_lines": with_views(EV, GC)
    + """SELECT e line_no, run, container, kind, CASE WHEN kind IN ('blank', 'foreign') THEN NULL WHEN kind = 'other' THEN 1.0::DOUBLE
      ELSE e / 1000.0::DOUBLE END uptime_s, CASE WHEN kind IN ('blank', 'foreign') THEN '' WHEN kind = 'other' THEN 'safepoint'
      WHEN is_init THEN CASE WHEN k % 5 = 0 THEN 'gc' ELSE 'gc,init' END WHEN is_noise THEN 'gc,start'
      WHEN k % 4 = 3 THEN 'gc,phases' ELSE 'gc' END tags FROM shapes""",
    "gc_heap_config": with_views(EV, GC, _HEAP)
    + """SELECT run, container, collector, version, initial_bytes, CAST(min_bytes AS BIGINT) min_bytes, max_bytes, 0::BIGINT bad_sizes
      FROM (SELECT DISTINCT run, container FROM shapes WHERE kind = 'gc') LEFT JOIN heap USING (run, container)""",
    "gc_pauses": with_views(EV, GC)
    + """SELECT run, container, line_no, gc_id, uptime_s, generation, CASE WHEN broken THEN '' ELSE label END AS label,
      CASE WHEN NOT broken THEN pause_ns END pause_ns, CASE WHEN heap AND NOT broken THEN (k + 40) * 1048576 END before_bytes,
      CASE WHEN heap AND NOT broken THEN k * 1024 END after_bytes, CASE WHEN heap AND NOT broken THEN (k + 60) * 1048576 END capacity_bytes,
      CASE WHEN broken THEN 'no duration' END error FROM pauses""",
    "gc_summary": with_views(EV, GC, _HEAP, _gc_totals("true"))
    + "SELECT run, container, decorated, gc_lines, \"foreign\", "
    + ", ".join(
        _FINE.format(f"coalesce({c}, 0)", c) for c in ["pauses", "total_ns", "max_ns", "p50_ns", "p99_ns", "p999_ns"]
    )
    + ", "
    + _FINE.format("coalesce(max_label, '')", "max_label")
    + ", "
    + _FINE.format("coalesce(total_ns / pauses, 0)", "mean_ns")
    + ", "
    + ", ".join(
        _FINE.format(c, c)
        for c in [
            "from_uptime_s",
            "to_uptime_s",
            "peak_committed_bytes",
            "peak_occupancy_bytes",
            "peak_live_bytes",
            "collector",
            "max_bytes",
        ]
    )
    + ", "
    + _FINE.format("peak_committed_bytes / max_bytes", "committed_share")
    + ", refusal FROM judged",
    "gc_summary_window": with_views(EV, GC, _HEAP, _gc_totals("uptime_s >= (SELECT min(uptime_s) FROM pauses) AND uptime_s < (SELECT (min(uptime_s) + max(uptime_s)) / 2 FROM pauses)"))
    + "SELECT run, container, "
    + ", ".join(_FINE.format(f"coalesce({c}, 0)", c) for c in ["pauses", "total_ns", "p50_ns"])
    + ", "
    + ", ".join(_FINE.format(c, c) for c in ["from_uptime_s", "to_uptime_s"])
    + ", refusal FROM judged",
    "gc_by_label": with_views(EV, GC)
    + """SELECT run, container, label, count(*) pauses, CAST(sum(pause_ns) AS BIGINT) total_ns FROM pauses WHERE NOT broken GROUP BY ALL""",
}
