"""Archive queries: scan, validate, summarise, select, rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanout.operators import archive, windows
from fanout.plans import inputs, logplans
from fanout.plans.logplans import ORACLES as LOG_SQL
from fanout.plans.measurement import ORACLES as MEASURED_SQL
from fanout.plans.oracle import EV, LANES, METRICS, RECORDS, ROWS, RUNS, VARIANTS, with_views
from fanout.schemas import PRIMARY_METRIC


def _keyed(spark, sf):
    return archive.keyed(inputs.records(spark, sf))


def _published(spark, sf):
    keyed = _keyed(spark, sf)
    return archive.publish(archive.summarise_rows(keyed), archive.attempts(keyed))


def _lanes(spark, sf, *also: str):
    """Lanes of the newest sittings, and the chosen metrics behind them."""
    keyed = _keyed(spark, sf)
    rows, _ = archive.publish(archive.summarise_rows(keyed), archive.attempts(keyed))
    newest = keyed.join(rows.select("row_key"), "row_key", "left_semi")
    metrics = archive.summarise_metrics(newest, [PRIMARY_METRIC, *also])
    return archive.lanes(rows, metrics, inputs.variants(spark, sf)), metrics


def archive_scan_counts(spark, sf):
    return archive.scan_counts(archive.parse_lines(inputs.archive_text(spark, sf)))


def archive_kept(spark, sf):
    """The records a scan keeps, with a parsed metric and variant."""
    kept = archive.kept_records(archive.parse_lines(inputs.archive_text(spark, sf)))
    return kept.select(
        "run_id",
        F.col("pos.path").alias("path"),
        F.try_element_at("variant", F.lit("batches")).alias("batches"),
        F.try_element_at("metrics", F.lit("rows_per_s"))["value"].alias("rows_per_s"),
    )


def archive_month_partition(spark, sf):
    filed = archive.month_path(inputs.records(spark, sf))
    return filed.groupBy(
        "root", F.col("run.env_id").alias("env_id"), F.col("sut.entrant").alias("entrant"), "month"
    ).agg(F.count("*").alias("records"))


def validate_duplicates(spark, sf):
    return archive.duplicates(inputs.records(spark, sf))


def validate_records(spark, sf):
    return archive.problems(inputs.records(spark, sf))


def group_key(spark, sf):
    return _keyed(spark, sf).select("pos", "group", "sitting", "row_key")


def summarise_metrics(spark, sf):
    return archive.summarise_metrics(_keyed(spark, sf))


def metric_values(spark, sf):
    return archive.metric_values(_keyed(spark, sf))


def summarise_rows(spark, sf):
    return archive.summarise_rows(_keyed(spark, sf)).withColumn("flags", F.array_join("flags", ","))


def attempts(spark, sf):
    return archive.attempts(_keyed(spark, sf))


def latest_sitting(spark, sf):
    rows, tried = _published(spark, sf)
    return rows.select("row_key", F.lit("row").alias("kind")).unionByName(
        tried.select(F.concat_ws("|", "arm", "sitting").alias("row_key"), F.lit("attempt").alias("kind"))
    )


def groups(spark, sf):
    return archive.groups(*_published(spark, sf))


def generated_at(spark, sf):
    return archive.generated_at(inputs.records(spark, sf))


def rank_eligibility(spark, sf):
    rows, _ = _published(spark, sf)
    return archive.eligibility(rows).select("row_key", "unranked_because", "plotted")


def lane_rank(spark, sf):
    lanes, _ = _lanes(spark, sf)
    return archive.lane_rank(lanes).select(
        "row_key", "group", "display_order", "variant_index", "ranked", "position"
    )


def sort_lanes(spark, sf):
    lanes, metrics = _lanes(spark, sf, "cpu_us_per_row")
    return archive.sort_lanes(archive.lane_rank(lanes), metrics, "cpu_us_per_row").select("row_key", "group", "tier", "place")


def tied_with_leader(spark, sf):
    rows, _ = _published(spark, sf)
    return archive.tied_with_leader(rows, archive.summarise_metrics(_keyed(spark, sf)))


def facets(spark, sf):
    return archive.facets(inputs.entrants(spark, sf), ["runtime", "kind", "licence", "delivery"])


def orphan_variants(spark, sf):
    return archive.orphan_variants(archive.summarise_rows(_keyed(spark, sf)), inputs.variants(spark, sf))


def _arms(spark, sf):
    return inputs.variants(spark, sf).select("entrant", "variant_id")


def stale_arms(spark, sf):
    return archive.stale_arms(_arms(spark, sf), inputs.records(spark, sf), harness_version=1, dataset_version="d2").select(
        "entrant", "variant_id", "why"
    )


def arm_last_measured(spark, sf):
    return archive.last_measured(_arms(spark, sf), inputs.records(spark, sf)).select("entrant", "variant_id", "ts_ms")


def knob_violations(spark, sf):
    return archive.knob_violations(inputs.records(spark, sf), inputs.constraints(spark, sf)).drop("at_least")


def _assembled(spark, sf):
    """Runs with their window's rates, mode metrics, server cost and collectors' figures."""
    runs = windows.mode_metrics(windows.kept_up(windows.run_rates(inputs.runs(spark, sf))))
    cost = logplans.server_metrics_of(spark, sf).withColumnsRenamed(
        {"cpu_us": "server_cpu_us", "written_rows": "server_written_rows"}
    )
    pauses = logplans.gc_summary(spark, sf).filter("refusal is null")
    plane = archive.collector_metrics(pauses.filter("container = 'jvm-0'"))
    control = archive.collector_metrics(pauses.filter("container = 'jvm-1'"), archive.CONTROL_PLANE)
    server = [c for c in cost.columns if c.startswith("server_")]
    joined = runs.join(cost.select("run", *server), "run", "left").join(plane, "run", "left").join(control, "run", "left")
    return archive.assemble_records(
        joined.withColumn("variant", F.create_map(F.lit("mode"), F.col("mode")))
        .withColumn("flags", F.array_compact(F.array(F.when(F.col("saturated"), F.lit("saturated")))))
        .withColumn("note", F.when(F.col("status") != "ok", F.concat(F.lit("run was "), F.col("status"))))
    )


def assemble_record(spark, sf):
    made = _assembled(spark, sf)
    return made.select("run", F.explode("metrics").alias("metric", "m")).select("run", "metric", "m.*")


def assemble_header(spark, sf):
    """What a record says beside its metrics."""
    return _assembled(spark, sf).select(
        "run",
        "status",
        F.col("variant")["mode"].alias("mode"),
        F.array_join("flags", ",").alias("flags"),
        "note",
        F.size("metrics").alias("n_metrics"),
    )


QUERIES = {
    "archive_scan_counts": archive_scan_counts,
    "archive_kept": archive_kept,
    "archive_month_partition": archive_month_partition,
    "validate_duplicates": validate_duplicates,
    "validate_records": validate_records,
    "group_key": group_key,
    "summarise_metrics": summarise_metrics,
    "metric_values": metric_values,
    "summarise_rows": summarise_rows,
    "attempts": attempts,
    "latest_sitting": latest_sitting,
    "groups": groups,
    "generated_at": generated_at,
    "rank_eligibility": rank_eligibility,
    "lane_rank": lane_rank,
    "sort_lanes": sort_lanes,
    "tied_with_leader": tied_with_leader,
    "facets": facets,
    "orphan_variants": orphan_variants,
    "stale_arms": stale_arms,
    "arm_last_measured": arm_last_measured,
    "knob_violations": knob_violations,
    "assemble_record": assemble_record,
    "assemble_header": assemble_header,
}

_REC = (EV, RECORDS)
_PUB = (EV, RECORDS, ROWS)
_LANE = (EV, RECORDS, ROWS, METRICS, VARIANTS, LANES)

_RULES = [
    ("schema too new", "schema_v > 2"),
    ("invocation id missing", "harness_version >= 2 AND coalesce(trim(invocation_id), '') = ''"),
    ("trigger bars publication", "trig IN ('pr', 'tuning')"),
    ("fixture environment", "list_contains(flags, 'unpublishable_environment')"),
    ("image digest empty", "image_digest = ''"),
    ("image digest not sha256", "image_digest <> '' AND NOT starts_with(image_digest, 'sha256:')"),
    ("no version or commit", "version IS NULL AND commit_id IS NULL"),
    ("env_digest empty", "trim(env_digest) = ''"),
    ("status without metrics", "carries AND NOT has_metrics"),
    ("metrics without status", "NOT carries AND has_metrics"),
    ("rep out of range", "rep = 0 OR rep > reps"),
    ("unit of cpu_us_per_row", "has_metrics AND k % 2 = 0 AND pos % 29 = 0"),
]
_NEWEST = """newest_rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entrant, variant_id ORDER BY ts_ms DESC, pos DESC) rn
  FROM records) WHERE rn = 1),
  aged AS (SELECT v.entrant, v.variant_id, n.ts_ms, n.harness_version hv, n.dataset_version dv FROM variants v
    LEFT JOIN newest_rec n ON v.entrant = n.entrant AND v.variant_id = n.variant_id)"""
_SPECS = [
    ("rows_per_s", "CASE WHEN window_ms > 0 THEN r / s ELSE 0 END", "records/s", "true"),
    ("cpu_us_per_row", "CASE WHEN r > 0 THEN cpu_us / r END", "us", "false"),
    ("cores_used", "CASE WHEN window_ms > 0 THEN cpu_us / (s * 1e6) END", "cores", "false"),
    (
        "rows_per_s_per_core",
        "CASE WHEN window_ms > 0 AND cpu_us > 0 THEN (r / s) / (cpu_us / (s * 1e6)) ELSE 0 END",
        "records/s",
        "true",
    ),
    ("peak_anon_bytes", "peak_anon_bytes", "bytes", "false"),
    ("peak_charged_bytes", "peak_charged_bytes", "bytes", "false"),
    ("duplicate_rows", "duplicate_rows", "rows", "false"),
]

_GC = {
    "gc_pause_total_us": "total_ns / 1000.0::DOUBLE",
    "gc_pause_max_us": "max_ns / 1000.0::DOUBLE",
    "gc_pause_p99_us": "p99_ns / 1000.0::DOUBLE",
    "gc_pause_p999_us": "p999_ns / 1000.0::DOUBLE",
    "jvm_heap_configured_bytes": "max_bytes",
    "jvm_heap_committed_peak_bytes": "peak_committed_bytes",
    "jvm_heap_live_peak_bytes": "peak_live_bytes",
}
_SERVED = {
    "server_cpu_us_per_row": ("us", False),
    "server_cpu_us_per_written_row": ("us", False),
    "server_cpu_us": ("us", False),
    "server_written_rows": ("rows", False),
    "server_rows_per_insert": ("rows", True),
    "server_cpu_wait_us": ("us", False),
    "server_inserted_bytes": ("bytes", False),
}


def _entries() -> str:
    line = "SELECT run, '{}' metric, CAST({} AS DOUBLE) AS value, '{}' unit, {} higher_is_better FROM {}"
    parts = [line.format(name, sql, unit, up, "good") for name, sql, unit, up in _SPECS]
    parts += [line.format(n, n, unit, up, "good JOIN served USING (run)") for n, (unit, up) in _SERVED.items()]
    for prefix, container in (("", "jvm-0"), ("control_plane_", "jvm-1")):
        source = f"good JOIN (SELECT * FROM paused WHERE container = '{container}' AND refusal IS NULL) USING (run)"
        parts += [line.format(prefix + n, sql, n.rsplit("_", 1)[1], False, source) for n, sql in _GC.items()]
    parts.append(
        """SELECT run, metric, value, CASE WHEN metric = 'kept_up_share' THEN 'ratio' WHEN metric = 'offered_rows_per_s' THEN 'records/s'
          WHEN metric LIKE '%\\_us' ESCAPE '\\' THEN 'us' ELSE 'rows' END unit, metric NOT LIKE '%\\_us' ESCAPE '\\' higher_is_better
          FROM moded SEMI JOIN good USING (run)"""
    )
    return "entries AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL)"


_ASSEMBLED = with_views(
    EV,
    RUNS,
    """good AS (SELECT *, CAST("rows" AS DOUBLE) r, window_ms / 1000.0::DOUBLE s FROM runs WHERE status <> 'failed')""",
    f"""served AS (SELECT m.*, c.cpu_us server_cpu_us, c.written_rows server_written_rows FROM ({LOG_SQL['server_metrics']}) m
      JOIN ({LOG_SQL['server_cost']}) c USING (run))""",
    f"paused AS ({LOG_SQL['gc_summary']})",
    f"moded AS ({MEASURED_SQL['mode_metrics']})",
    f"kept AS ({MEASURED_SQL['kept_up']})",
    _entries(),
)

ORACLES = {
    "archive_scan_counts": with_views(EV)
    + """SELECT count(DISTINCT u % 9) FILTER (k % 23 <> 1) files, count(*) FILTER (k % 23 <> 1) lines,
      count(*) FILTER (k % 23 > 2 AND k % 10 <> 0) kept, count(*) FILTER (k % 23 = 2 OR (k % 23 > 2 AND k % 10 = 0)) skipped_schema,
      count(*) FILTER (k % 23 = 0) skipped_parse FROM ev""",
    "archive_kept": with_views(EV)
    + """SELECT 'r-' || e run_id, 'file-' || (u % 9) path, CAST(k AS VARCHAR) batches, CAST(k AS DOUBLE) rows_per_s
      FROM ev WHERE k % 23 > 2 AND k % 10 <> 0""",
    "archive_month_partition": with_views(*_REC)
    + """SELECT CASE WHEN trig = 'manual' THEN 'results' ELSE 'tuning' END root, env_id, entrant,
      strftime(make_timestamp(ts_ms*1000), '%Y-%m') AS month, count(*) records FROM records GROUP BY ALL""",
    "validate_duplicates": with_views(*_REC)
    + """SELECT run_id, pos, first_pos FROM (SELECT run_id, pos, min(pos) OVER (PARTITION BY run_id) first_pos,
      row_number() OVER (PARTITION BY run_id ORDER BY pos) rn FROM records) WHERE rn > 1""",
    "validate_records": with_views(*_REC)
    + " UNION ALL ".join(f"SELECT run_id, pos, '{name}' AS rule FROM filled WHERE {sql}" for name, sql in _RULES),
    "group_key": with_views(*_REC) + 'SELECT pos, grp "group", sitting, row_key FROM rowed',
    "summarise_metrics": with_views(*_REC, METRICS) + "SELECT * FROM summed",
    "metric_values": with_views(*_REC, METRICS)
    + "SELECT row_key, metric, value, count(*) copies FROM long_metrics WHERE value IS NOT NULL GROUP BY ALL",
    "summarise_rows": with_views(*_PUB)
    + """SELECT row_key, arm, grp "group", sitting, entrant, variant_id, version, commit_id AS "commit", image_digest, env_id,
      harness_version, dataset_version, mode, approach, wire_format, ts_ms, status, reps_counted, flags FROM summary""",
    "attempts": with_views(*_PUB)
    + """SELECT arm, grp "group", sitting, entrant, variant_id, status, note, ts_ms, reps_counted, env_id, harness_version,
      dataset_version FROM attempted""",
    "latest_sitting": with_views(*_PUB)
    + """SELECT row_key, 'row' kind FROM pub_rows UNION ALL SELECT arm || '|' || sitting, 'attempt' FROM pub_tries""",
    "groups": with_views(*_PUB)
    + """SELECT DISTINCT grp "group", env_id, harness_version, dataset_version FROM (SELECT grp, env_id, harness_version, dataset_version
      FROM pub_rows UNION ALL SELECT grp, env_id, harness_version, dataset_version FROM pub_tries)""",
    "generated_at": with_views(*_REC) + "SELECT max(ts_ms) generated_ms FROM records",
    "rank_eligibility": with_views(*_PUB)
    + """SELECT row_key, CASE WHEN status = 'infra_bound' THEN 'infra-bound' WHEN approach <> 'realistic' THEN approach ELSE '' END
      unranked_because, status <> 'infra_bound' plotted FROM pub_rows""",
    "lane_rank": with_views(*_LANE)
    + """SELECT row_key, grp "group", CAST(display_order AS INTEGER) display_order, CAST(variant_index AS BIGINT) variant_index, ranked, position FROM lanes""",
    "sort_lanes": with_views(*_LANE)
    + """, tiers AS (SELECT l.row_key, l.grp, l.position, m.median mm, m.higher_is_better up,
        CASE WHEN l.ranked IS NOT NULL THEN 0 ELSE 2 END + CASE WHEN m.median IS NULL THEN 1 ELSE 0 END tier
      FROM lanes l LEFT JOIN (SELECT * FROM summed WHERE metric = 'cpu_us_per_row') m USING (row_key))
      SELECT row_key, grp "group", CAST(tier AS INTEGER) tier, row_number() OVER (PARTITION BY grp, tier ORDER BY
        CASE WHEN mm IS NULL THEN 0 WHEN up THEN -mm ELSE mm END, position) place FROM tiers""",
    "tied_with_leader": with_views(*_PUB, METRICS)
    + """, fit AS (SELECT p.grp, p.ts_ms, s.* FROM pub_rows p JOIN summed s USING (row_key) WHERE status = 'ok' AND approach = 'realistic'),
      led AS (SELECT *, first_value(row_key) OVER w leader, first_value(lo) OVER w llo, first_value(hi) OVER w lhi FROM fit
        WINDOW w AS (PARTITION BY grp, metric ORDER BY CASE WHEN higher_is_better THEN -median ELSE median END, ts_ms DESC, row_key))
      SELECT grp "group", metric, row_key, leader, row_key = leader leads, row_key <> leader AND lo <= lhi AND llo <= hi tied FROM led""",
    "facets": """SELECT field, value, count(*) entrants FROM (SELECT 'runtime' field, 'rt-' || (s_nationkey % 3) AS value FROM supplier
      UNION ALL SELECT 'licence', CASE WHEN s_nationkey % 4 <> 3 THEN 'lic-' || (s_nationkey % 4) END FROM supplier)
      WHERE value IS NOT NULL AND field IN (SELECT f FROM (SELECT 'runtime' f, count(DISTINCT s_nationkey % 3) c FROM supplier
        UNION ALL SELECT 'licence', count(DISTINCT s_nationkey % 4) FILTER (s_nationkey % 4 <> 3) FROM supplier) WHERE c > 1) GROUP BY ALL""",
    "orphan_variants": with_views(*_PUB, VARIANTS)
    + """SELECT DISTINCT entrant, variant_id FROM summary s WHERE NOT EXISTS (SELECT 1 FROM variants v
      WHERE v.entrant = s.entrant AND v.variant_id = s.variant_id)""",
    "stale_arms": with_views(*_REC, VARIANTS, _NEWEST)
    + """SELECT * FROM (SELECT entrant, variant_id, CASE WHEN ts_ms IS NULL THEN 'never measured' WHEN hv <> 1 THEN 'harness differs'
      WHEN dv <> 'd2' THEN 'dataset differs' END why FROM aged) WHERE why IS NOT NULL""",
    "arm_last_measured": with_views(*_REC, VARIANTS, _NEWEST) + "SELECT entrant, variant_id, ts_ms FROM aged",
    "knob_violations": with_views(*_REC)
    + """SELECT * FROM (SELECT run_id, entrant, 'knob_a' knob, CASE WHEN n_nationkey % 3 <> 1 THEN 'knob_b' END exceeds,
        CASE WHEN n_nationkey % 3 = 2 THEN 'misstated'
          WHEN n_nationkey % 3 = 0 THEN CASE WHEN knob_a IS NULL OR knob_b = 'auto' THEN 'cannot be checked'
            WHEN CAST(knob_a AS INT) <= TRY_CAST(knob_b AS INT) THEN 'must exceed' END
          ELSE CASE WHEN knob_a IS NULL THEN 'cannot be checked' WHEN CAST(knob_a AS INT) < 1 THEN 'must be at least' END END problem
      FROM records JOIN nation ON u % 25 = n_nationkey) WHERE problem IS NOT NULL""",
    "assemble_record": _ASSEMBLED + "SELECT * FROM entries",
    "assemble_header": _ASSEMBLED
    + """SELECT run, status, mode, CASE WHEN share < 0.98 THEN 'saturated' ELSE '' END flags,
      CASE WHEN status <> 'ok' THEN 'run was ' || status END note, CAST(coalesce(n, 0) AS INTEGER) n_metrics
      FROM (SELECT run, status, mode, kept_up_share share FROM runs JOIN kept USING (run))
        LEFT JOIN (SELECT run, count(*) n FROM entries GROUP BY run) USING (run)""",
}
