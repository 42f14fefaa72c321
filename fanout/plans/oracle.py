"""The inputs of ``inputs.py`` again, as DuckDB SQL views of the same names.

Nothing here is shared with the Spark side: formulas are written a second time on purpose.
"""

from __future__ import annotations

EV = """ev AS (SELECT event_id e, ts, epoch_us(ts) us, epoch_us(ts) // 1000 ms, user_id u, event_type t, value,
  CAST(json_extract(props, '$.k') AS BIGINT) k FROM events)"""

_UNITS = "['count','bytes','ms','drop','ratio','celsius','volts','rpm']"


def corpus(ids: str) -> str:
    """The flat corpus over a subquery of batch ids ``b``."""
    return f"""corpus AS (SELECT b, CAST(s AS INTEGER) s,
  'sensor-' || (b % 1024) sensor,
  CASE WHEN b % 10 <> 0 THEN 'region-' || (b % 7) END region,
  1772000000000 + b batch_ts_ms, 1772000000000000 + b send_ts_us,
  'metric_' || ((b*31+s) % 32) AS name,
  {_UNITS}[(b*7+s) % 8 + 1] unit,
  (b*1000003 + s*97) % 2147483647 AS value,
  CASE WHEN (b+s) % 5 <> 0 THEN ((b*13+s*7) % 100) / 100.0::DOUBLE END quality,
  list_transform(range(0, (b+s) % 4), lambda j: 'tag-' || ((b+s+j) % 16)) tags
  FROM ({ids}), range(100) r(s))"""


DOC_CORPUS = corpus("SELECT doc_id b FROM documents")
EVENT_CORPUS = corpus("SELECT event_id b FROM events")

LANDED = """landed AS (SELECT b batch_id, s event_seq, sensor, coalesce(region, '') region, upper(name) name_upper,
  unit, value, value*1000 // (s+1) value_scaled, quality, tags, batch_ts_ms, send_ts_us
  FROM corpus WHERE unit <> 'drop' AND (quality IS NULL OR quality >= 0.2))"""

FEED = """feed AS (SELECT e batch_id, CAST(i AS INTEGER) seq, 'sensor-' || u sensor,
  CASE WHEN t <> 'error' THEN t END region, ms batch_ts_ms, us send_ts_us,
  CASE WHEN (e+i) % 7 = 0 THEN 'ı_ß_a' || k ELSE 'metric_' || ((k+i) % 32) END AS name,
  ['count','bytes','ms','drop','ratio','celsius','volts','rpm'][(k+i) % 8 + 1] unit,
  (CAST(round(value*100) AS BIGINT) + i) * (CASE WHEN e % 3 = 0 THEN -1 ELSE 1 END) AS value,
  CASE WHEN (e+i) % 5 <> 0 THEN ((k+i*13) % 100) / 100.0::DOUBLE END quality,
  list_transform(range(0, (e+i) % 4), lambda j: 'tag-' || ((e+i+j) % 16)) tags
  FROM ev, range(5) r(i) WHERE i < e % 6)"""

FEED_LANDED = """fl AS (SELECT batch_id, seq event_seq, sensor, coalesce(region, '') region,
  translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') name_upper,
  unit, value, CAST(trunc(value*1000 / (seq+1)) AS BIGINT) value_scaled, quality, tags,
  make_timestamp(batch_ts_ms*1000) batch_ts, make_timestamp(send_ts_us) send_ts
  FROM feed WHERE unit <> 'drop' AND NOT (quality IS NOT NULL AND quality < 0.2))"""


def fp(s: str) -> str:
    """String fingerprint of an ASCII string, byte by byte."""

    def byte(position: str) -> str:
        return f"CASE WHEN {position} BETWEEN 1 AND length({s}) THEN ascii(substr({s}, {position}, 1)) ELSE 0 END::HUGEINT"

    head = " + ".join(f"({byte(str(i + 1))}) * {256**i}::HUGEINT" for i in range(8))
    tail = " + ".join(f"({byte(f'(length({s}) - {i})')}) * {256**i}::HUGEINT" for i in range(8))
    return f"({head} + {tail})"


def sums(source: str) -> str:
    """The ten sums over a frame shaped like ``landed``."""
    tag = "array_to_string(tags, '')"
    parts = {
        "value_sum": "sum(value)",
        "value_scaled_sum": "sum(value_scaled)",
        "sensor_sum": f"sum({fp('sensor')})",
        "region_sum": f"sum({fp('region')})",
        "name_sum": f"sum({fp('name_upper')})",
        "unit_sum": f"sum({fp('unit')})",
        "tag_count_sum": "sum(len(tags))",
        "tag_sum": f"sum({fp('tag_text')})",
        "batch_ts_sum": "sum(batch_ts_ms)",
        "null_quality_rows": "sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)",
    }
    columns = ", ".join(f"CAST({sql} AS VARCHAR) AS {name}" for name, sql in parts.items())
    return f"SELECT {columns} FROM (SELECT *, {tag} tag_text FROM {source})"


LATENCY = """lat AS (SELECT 'run-' || (u % 3) run, us send_us, us + e*7919 % 250000 ingest_us FROM ev)"""

SERIES = """series AS (SELECT 'arm-' || (u % 4) arm, 'c' || (u % 3) container, e line, ms t_ms,
  CASE WHEN t = 'error' THEN -1 ELSE e*1000+k END usage_usec, e*700 user_usec, e*300+k system_usec,
  e*7919 % 1000 nr_throttled, e*10 throttled_usec, CAST(round(value*1000000) AS BIGINT) mem_current,
  e*100 mem_peak, CASE WHEN t = 'error' THEN -1 ELSE CAST(round(value*1000000) AS BIGINT) END anon, t <> 'error' ok
  FROM ev)"""

RUN_WINDOWS = """run_windows AS (SELECT 'w-' || e run, ms from_ms, ms + CAST(pow(4, e // 100 % 12) AS BIGINT) * 250 + k - 1 to_ms
    FROM ev WHERE e % 100 = 0
  UNION ALL SELECT arm, min(a), max(z) FROM (SELECT arm, container, min(t_ms) FILTER (ok) a, max(t_ms) FILTER (ok) z
    FROM series GROUP BY ALL) GROUP BY arm HAVING count(*) = count(a) AND min(a) < max(z))"""

DECLARED = """declared AS (SELECT DISTINCT 'arm-' || (c_custkey % 5) arm, 'c' || (c_custkey % 3) container,
  CASE WHEN c_custkey % 3 = 0 THEN 'data-plane' ELSE 'coordinator' END AS role FROM customer)"""

COSTS = """ends AS (SELECT arm, container,
    count(*) FILTER (ok) samples, count(*) FILTER (NOT ok) unreadable,
    max(anon) FILTER (ok) peak_anon, max(mem_current) FILTER (ok) peak_current,
    min(line) FILTER (ok) a, max(line) FILTER (ok) z FROM series GROUP BY ALL),
  costs0 AS (SELECT n.*, l.t_ms - f.t_ms win,
    greatest(l.usage_usec - f.usage_usec, 0) cpu_us, greatest(l.user_usec - f.user_usec, 0) user_us,
    greatest(l.system_usec - f.system_usec, 0) system_us, greatest(l.throttled_usec - f.throttled_usec, 0) throttled_us,
    greatest(l.nr_throttled - f.nr_throttled, 0) nr_throttled, l.mem_peak peak_charged
    FROM ends n LEFT JOIN series f ON f.line = n.a LEFT JOIN series l ON l.line = n.z),
  costs AS (SELECT arm, container, samples, unreadable,
    CASE WHEN g THEN win END window_ms, CASE WHEN g THEN cpu_us END cpu_us, CASE WHEN g THEN user_us END user_us,
    CASE WHEN g THEN system_us END system_us, CASE WHEN g THEN throttled_us END throttled_us,
    CASE WHEN g THEN nr_throttled END nr_throttled, CASE WHEN g THEN peak_anon END peak_anon,
    CASE WHEN g THEN peak_charged END peak_charged, CASE WHEN g THEN peak_current END peak_current,
    CASE WHEN g THEN nr_throttled > 0 END throttled
    FROM (SELECT *, samples >= 2 AND win > 0 g FROM costs0))"""

POLLS = """raw_polls AS (SELECT 'run-' || (u % 16) run, us // 3600000000 - 1704067200000000 // 3600000000 tick,
    CASE WHEN t = 'purchase' THEN e // 40 END AS n, u % 16 * 10 expected_rows FROM ev),
  per_tick AS (SELECT run, tick, max(n) n, max(expected_rows) expected_rows FROM raw_polls GROUP BY ALL),
  polls AS (SELECT *, tick - min(tick) OVER (PARTITION BY run) since FROM per_tick)"""

SENDS = """sends AS (SELECT 'run-' || (u % 4) run, e*1000000 // 37 due_us, e*1000000 // 37 + e*7919 % 5000 actual_us,
  t = 'error' AND u % 4 = 1 failed, CASE WHEN u % 4 = 2 THEN 37 ELSE 5 END rate FROM ev)"""

SINK_ROWS = """sink_rows AS (SELECT CASE WHEN e % 2 = 0 THEN 'shard-hot' ELSE 'shard-' || (u % 5) END shard,
    CASE WHEN e % 50 < 40 THEN ms - ms % 3600000 ELSE ms END at_ms, e, CASE WHEN k % 17 = 0 THEN k * 40 ELSE k END + 1 bytes FROM ev)"""

OFFSETS = """offsets AS (SELECT 'topic-' || (u % 2) topic, e % 8 AS part, e // 8 AS off FROM ev)"""

RUNS = """runs AS (SELECT 'run-' || u run, "rows", window_ms, cpu_us, peak_anon_bytes,
    CASE WHEN u % 3 <> 0 THEN peak_anon_bytes + 1 END peak_charged_bytes, duplicate_rows,
    CASE WHEN u % 2 = 0 THEN 'sustained' ELSE 'drain' END AS mode,
    CASE WHEN u % 7 = 0 THEN 'failed' WHEN u % 5 = 0 THEN 'infra_bound' ELSE 'ok' END status,
    u % 5 offered_msgs_per_s, 735 expected_rows, 10000000 batches, u*31 % 1000 max_schedule_lag_us,
    u*3 p50_us, u*5 p99_us, u*7 p999_us, u*11 max_us
  FROM (SELECT u, count(*)*1000 "rows", max(ms) - min(ms) window_ms, CAST(sum(k)*1000 AS BIGINT) cpu_us,
    max(CAST(round(value*1000000) AS BIGINT)) peak_anon_bytes, count(*) FILTER (t = 'error') duplicate_rows
    FROM ev GROUP BY u))"""

QUERY_LOG = """qlog AS (SELECT e, 'run-' || (u % 12) run, ts, CAST(ts AS DATE) event_date,
    CASE t WHEN 'signup' THEN 'QueryStart' WHEN 'error' THEN 'ExceptionWhileProcessing' ELSE 'QueryFinish' END AS kind,
    k % 10 <> 9 is_insert, u % 5 <> 0 is_initial, CASE WHEN u % 2 = 0 THEN ['db.sensor_events'] ELSE ['db.other','db.landing'] END AS tabs,
    e % 1000 + 1 written_rows, k*7+1 duration_ms,
    CASE WHEN u % 12 <> 7 THEN k*100 END c_user, CASE WHEN u % 12 <> 7 AND k % 7 <> 0 THEN k*10 END c_sys,
    CASE WHEN k % 3 = 0 THEN k*1000 END c_bytes, CASE WHEN u % 12 = 5 THEN 1 END c_async, k*11 c_net FROM ev)"""

RECORDS = """records AS (SELECT e pos, u, k, t, value raw, CASE WHEN e % 97 = 0 THEN 3 ELSE 2 END AS schema_v,
    CASE WHEN t = 'signup' THEN 'failed' WHEN t = 'error' AND k % 2 = 0 THEN 'infra_bound'
         WHEN t = 'error' AND k % 9 = 1 THEN 'mystery' ELSE 'ok' END status,
    'r-' || (CASE WHEN e % 50 = 49 THEN e-1 ELSE e END) run_id, k % 5 rep, 3 reps,
    'sys-' || (u % 25) entrant, 'v' || (u % 6) variant_id,
    CASE WHEN u % 7 <> 0 THEN '1.' || (u % 2) END AS version, CASE WHEN u % 14 <> 0 THEN 'c' || (u % 3) END AS commit_id,
    CASE WHEN k = 50 THEN '' WHEN k = 51 THEN 'md5:1' ELSE 'sha256:' || e END image_digest,
    ms // 3600000 * 3600000 ts_ms,
    CASE WHEN u % 5 = 0 THEN '' WHEN u % 5 = 1 THEN NULL ELSE 'inv-' || strftime(ts, '%Y%m%d') END invocation_id,
    'env-' || (u % 2) env_id, CASE WHEN k = 52 THEN ' ' ELSE 'd' END env_digest,
    CASE WHEN u % 3 = 0 THEN 2 ELSE 1 END harness_version, CASE WHEN u % 25 = 4 THEN 'd1' ELSE 'd2' END dataset_version,
    CASE WHEN k = 60 THEN 'pr' WHEN k = 61 THEN 'tuning' ELSE 'manual' END AS trig, 'i' || (u % 2) infra,
    CASE WHEN u % 9 <> 8 THEN CASE WHEN u % 2 = 0 THEN 'drain' ELSE 'sustained' END END AS mode,
    CASE WHEN u % 8 <> 7 THEN CASE WHEN u % 4 = 1 THEN 'stripped' ELSE 'realistic' END END approach,
    CASE WHEN u % 2 = 0 THEN 'rowbinary' ELSE 'native' END wire_format,
    CASE WHEN k % 6 <> 5 THEN CAST(u % 3 AS VARCHAR) END knob_a,
    CASE WHEN u % 13 = 0 THEN 'auto' ELSE CAST(u % 2 AS VARCHAR) END knob_b,
    CASE WHEN k % 4 = 0 THEN ['cpu_cap_throttled'] WHEN k = 81 THEN ['unpublishable_environment','headroom_unproven'] ELSE [] END flags,
    'note ' || e note FROM ev),
  marked AS (SELECT *, status IN ('ok','infra_bound') carries FROM records),
  filled AS (SELECT *, (carries AND k <> 70) OR (NOT carries AND k = 71) has_metrics FROM marked),
  keyed AS (SELECT *, env_id || '|' || harness_version || '|' || dataset_version || '|' || infra || '|mode-' || coalesce(mode, '?') grp,
    CASE WHEN coalesce(invocation_id, '') <> '' THEN invocation_id ELSE strftime(make_timestamp(ts_ms*1000), '%Y-%m-%d') END sitting
    FROM filled),
  armed AS (SELECT *, grp || '|' || entrant || '|' || variant_id arm FROM keyed),
  rowed AS (SELECT *, arm || '|' || coalesce(version, commit_id, '?') || '|{' ||
      CASE WHEN approach IS NOT NULL THEN '"approach":"' || approach || '",' ELSE '' END ||
      CASE WHEN knob_a IS NOT NULL THEN '"knob_a":"' || knob_a || '",' ELSE '' END ||
      '"knob_b":"' || knob_b || '",' ||
      CASE WHEN mode IS NOT NULL THEN '"mode":"' || mode || '",' ELSE '' END ||
      '"wire_format":"' || wire_format || '"}|' || sitting row_key FROM armed)"""

METRICS = """long_metrics AS (
    SELECT row_key, pos, 'rows_per_s' metric, round(raw*100) AS value, 'records/s' unit, true up FROM rowed WHERE carries AND has_metrics
    UNION ALL SELECT row_key, pos, 'cpu_us_per_row', CASE WHEN k % 10 <> 4 THEN k END::DOUBLE,
      CASE WHEN pos % 29 = 0 THEN 'furlongs' ELSE 'us' END, false FROM rowed WHERE carries AND has_metrics AND k % 2 = 0
    UNION ALL SELECT row_key, pos, 'duplicate_rows', 0.0::DOUBLE, 'rows', false FROM rowed WHERE carries AND has_metrics),
  summed AS (SELECT *, CASE WHEN n < 2 THEN 0.0 WHEN median = 0 THEN NULL ELSE (hi - lo) / median END::DOUBLE spread FROM (
    SELECT row_key, metric, arg_min(unit, pos) unit, arg_min(up, pos) higher_is_better, count(value) n, min(value) lo,
      max(value) hi, median(value) AS median FROM long_metrics GROUP BY ALL) WHERE n > 0)"""

ROWS = """heads AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY ts_ms DESC, pos) rn FROM rowed WHERE carries),
  totals AS (SELECT row_key, max(CASE WHEN status = 'infra_bound' THEN 1 ELSE 0 END) bad, count(*) reps_counted,
    array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') flags FROM rowed WHERE carries GROUP BY row_key),
  summary AS (SELECT h.row_key, arm, grp, sitting, entrant, variant_id, version, commit_id, image_digest, env_id,
    harness_version, dataset_version, mode, coalesce(approach, 'undeclared') approach, wire_format, ts_ms,
    CASE WHEN bad = 1 THEN 'infra_bound' ELSE 'ok' END status, reps_counted, s.flags
    FROM heads h JOIN totals s USING (row_key) WHERE rn = 1),
  tries AS (SELECT arm, sitting, grp, entrant, variant_id, env_id, harness_version, dataset_version, status, note, ts_ms,
    count(*) OVER (PARTITION BY arm, sitting) reps_counted,
    row_number() OVER (PARTITION BY arm, sitting ORDER BY ts_ms DESC, pos DESC) rn FROM rowed WHERE NOT carries),
  attempted AS (SELECT * EXCLUDE rn FROM tries WHERE rn = 1),
  both_kinds AS (SELECT arm, ts_ms, sitting FROM summary UNION ALL SELECT arm, ts_ms, sitting FROM attempted),
  newest AS (SELECT arm, sitting FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY ts_ms DESC, sitting DESC) rn
    FROM both_kinds) WHERE rn = 1),
  pub_rows AS (SELECT s.* FROM summary s JOIN newest n USING (arm, sitting)),
  pub_tries AS (SELECT a.* FROM attempted a JOIN newest n USING (arm, sitting))"""

VARIANTS = """custs AS (SELECT 'sys-' || c_nationkey entrant, c_custkey FROM customer),
  variants AS (SELECT DISTINCT entrant, 'v' || (c_custkey % 5) variant_id, CAST(c_custkey % 5 AS INTEGER) variant_index,
    CAST(display_order AS INTEGER) display_order FROM custs JOIN (SELECT entrant, min(c_custkey) display_order FROM custs GROUP BY 1) USING (entrant))"""

LANES = """lanes0 AS (SELECT p.*, m.unit, m.higher_is_better, m.n, m.lo, m.median, m.hi, m.spread,
    CASE WHEN status = 'infra_bound' THEN 'infra-bound' WHEN approach <> 'realistic' THEN approach ELSE '' END unranked_because,
    coalesce(d.display_order, 1000000000) display_order, coalesce(v.variant_index, d.declared, 0) variant_index
    FROM pub_rows p LEFT JOIN (SELECT * FROM summed WHERE metric = 'rows_per_s') m USING (row_key)
    LEFT JOIN (SELECT entrant, min(display_order) display_order, count(*) declared FROM variants GROUP BY 1) d USING (entrant)
    LEFT JOIN variants v ON v.entrant = p.entrant AND v.variant_id = p.variant_id),
  lanes1 AS (SELECT *, unranked_because = '' AND median IS NOT NULL rankable FROM lanes0),
  lanes AS (SELECT *, CASE WHEN rankable THEN row_number() OVER (PARTITION BY grp, rankable ORDER BY
      CASE WHEN higher_is_better THEN -median ELSE median END, display_order, variant_index, variant_id, row_key) END ranked,
    row_number() OVER (PARTITION BY grp ORDER BY rankable DESC,
      CASE WHEN rankable THEN CASE WHEN higher_is_better THEN -median ELSE median END ELSE 0 END,
      display_order, variant_index, variant_id, row_key) AS position FROM lanes1)"""


def digest(n: str) -> str:
    return f"substr(sha256('broker|' || ({n} % 3 + 1) || '|8g|16|16g|8'), 1, 12)"


CONSUME = f"""consume AS (SELECT 'env-' || s_suppkey env, CASE WHEN s_suppkey % 10 <> 9 THEN CAST(round(s_acctbal*100) AS BIGINT) END msgs_per_s,
    CAST(round(s_acctbal*100) AS BIGINT) / 1000.0::DOUBLE mb_per_s, 3700 + s_nationkey*30 message_bytes,
    CASE WHEN s_suppkey % 4 = 3 THEN 'outside' ELSE 'inside' END client,
    CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE {digest('s_suppkey')} END infra_digest,
    {digest('(CASE WHEN s_suppkey % 8 = 7 THEN s_suppkey+1 ELSE s_suppkey END)')} env_digest FROM supplier),
  consume_gate AS (SELECT *, CASE WHEN msgs_per_s IS NULL THEN ['not measured'] ELSE list_filter([
      CASE WHEN message_bytes / 4056.0::DOUBLE BETWEEN 0.95 AND 1.05 THEN NULL ELSE 'message size differs' END,
      CASE WHEN client <> 'inside' THEN 'measured from outside' END,
      CASE WHEN infra_digest = '' THEN 'records no envelope' WHEN infra_digest <> env_digest THEN 'other envelope' END],
      lambda x: x IS NOT NULL) END refusals FROM consume)"""

INGEST = f"""ingest AS (SELECT 'env-' || n env, n, format, rows_per_s, (n + rows_per_s) % 6 mixed FROM (
    SELECT p_partkey % 8 n, 'fmt-' || (p_size % 5) format, max(CAST(round(p_retailprice*1000) AS BIGINT)) rows_per_s FROM part GROUP BY ALL)),
  ingest_gate AS (SELECT *, CASE WHEN infra_digest = '' OR infra_digest <> env_digest THEN 'other envelope'
      WHEN client <> 'inside' THEN 'measured from outside' END refusal
    FROM (SELECT *, CASE WHEN mixed = 1 THEN 'outside' ELSE 'inside' END client,
      CASE WHEN mixed = 2 THEN '' ELSE {digest('n')} END infra_digest,
      {digest('(CASE WHEN mixed = 3 THEN n+1 ELSE n END)')} env_digest FROM ingest))"""

ACHIEVED = """achieved AS (SELECT 'arm-' || c_custkey arm, 'env-' || (c_custkey % 12) env, 'fmt-' || (c_nationkey % 6) wire_format,
    CAST(round(c_acctbal*100) AS BIGINT) / 2.0::DOUBLE msgs_per_s, CAST(round(c_acctbal*100) AS BIGINT) * 2.0::DOUBLE rows_per_s,
    c_custkey % 9 = 0 sst FROM customer),
  refused AS (SELECT env, sum(n) refusals FROM (SELECT env, len(refusals) n FROM consume_gate
    UNION ALL SELECT env, CASE WHEN refusal IS NULL THEN 0 ELSE 1 END FROM ingest_gate) GROUP BY env),
  shares AS (SELECT arm, env, wire_format, sst,
    greatest(a.msgs_per_s / c.msgs_per_s, a.msgs_per_s * 4056 / round(c.mb_per_s*1000000)) consume_share,
    CASE WHEN NOT sst THEN a.rows_per_s / i.rows_per_s END ingest_share,
    CASE WHEN NOT sst THEN i.rows_per_s END applied_ingest_rows_per_s,
    CASE WHEN sst THEN 'server-side transform' WHEN i.rows_per_s IS NULL THEN 'format not measured' END unproven_ingest,
    CASE WHEN c.msgs_per_s IS NULL THEN 'no usable consume ceiling' END unproven_consume,
    CAST(coalesce(r.refusals, 0) AS BIGINT) refusals
    FROM achieved a LEFT JOIN (SELECT * FROM consume_gate WHERE len(refusals) = 0 AND msgs_per_s > 0 AND mb_per_s > 0) c USING (env)
    LEFT JOIN (SELECT env, format wire_format, rows_per_s FROM ingest_gate WHERE refusal IS NULL) i USING (env, wire_format)
    LEFT JOIN refused r USING (env))"""

GC = """gc AS (SELECT e, u, k, t, value, 'run-' || (u % 4) run, 'jvm-' || (u % 5) container,
    t = 'signup' is_init, t = 'error' is_noise, t NOT IN ('signup','error') is_pause_line FROM ev),
  shapes AS (SELECT *, CASE WHEN is_init THEN CASE WHEN u % 5 = 4 THEN 'blank' ELSE 'gc' END
      WHEN is_noise THEN CASE k % 3 WHEN 0 THEN 'foreign' WHEN 1 THEN 'gc' ELSE 'other' END ELSE 'gc' END AS kind FROM gc),
  pauses AS (SELECT run, container, e line_no, e gc_id, e / 1000.0::DOUBLE uptime_s, CASE WHEN k % 4 = 3 THEN 'Y' END generation,
    k % 4 <> 3 AND u % 5 = 3 AND k = 77 broken, k % 4 <> 3 heap, k,
    CASE WHEN k % 4 = 3 THEN 'Mark Start (Major)' WHEN k % 2 = 0 THEN 'Young (Normal) (G1 Evacuation Pause)' ELSE 'Full (System.gc())' END AS label,
    CAST(round(value*1000000) AS BIGINT) pause_ns FROM gc WHERE is_pause_line)"""


def with_views(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n"
