"""The results archive: scan, validate, group, summarise, select and rank run records.

Records follow ``schemas.RECORD`` plus ``pos``, an orderable input position (a path and a line, or
any number that orders like them). Every tie rule below is stated in terms of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.functions.text import blank
from fanout.operators.ordering import lower_middle, rank_within, select_ranks, upper_middle
from fanout.session import kept

# Statuses that carry numbers, triggers that bar publication, the fixture flag.
CARRIES_METRICS = ["ok", "infra_bound"]
BARRED_TRIGGERS = ["pr", "tuning"]
FIXTURE_FLAG = "unpublishable_environment"


# --- scan ---------------------------------------------------------------------------------------


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse ``(path, line_no, line)`` into records with an outcome per line.

    ``outcome`` is ``kept``, ``parse`` for text that is not JSON, or ``schema`` for JSON that is not
    a record of the current schema. Blank lines are not lines.
    """
    text = lines.filter(F.trim("line") != "")
    valid = F.try_parse_json("line").isNotNull()
    record = F.from_json("line", S.RECORD)
    parsed = text.withColumn("record", record).withColumn("_valid", valid)
    return parsed.select(
        "path",
        "line_no",
        F.when(~F.col("_valid"), F.lit("parse"))
        .when(F.coalesce(F.col("record.schema") == S.SCHEMA_VERSION, F.lit(False)), F.lit("kept"))
        .otherwise(F.lit("schema"))
        .alias("outcome"),
        "record",
    )


def scan_counts(parsed: DataFrame) -> DataFrame:
    per_file = parsed.groupBy("path").agg(
        F.count("*").alias("lines"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "schema", "parse")],
    )
    return per_file.agg(
        F.count("*").alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("kept").alias("kept"),
        F.sum("schema").alias("skipped_schema"),
        F.sum("parse").alias("skipped_parse"),
    )


def kept_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("outcome = 'kept'").select("record.*", F.struct("path", "line_no").alias("pos"))


def month_path(records: DataFrame) -> DataFrame:
    """Where each record is filed: root by trigger, then environment, system and month."""
    return records.withColumn(
        "root", F.when(F.col("run.trigger").isin(BARRED_TRIGGERS), F.lit("tuning")).otherwise(F.lit("results"))
    ).withColumn("month", F.date_format(F.timestamp_millis("run.ts_ms"), "yyyy-MM"))


# --- validate -----------------------------------------------------------------------------------


def duplicates(records: DataFrame) -> DataFrame:
    """Every record but the first that repeats a run id, with the position of the first.

    Counted before joining, so only repeated ids take part in the join.
    """
    first = records.groupBy("run_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("_n"))
    repeated = first.filter("_n > 1").drop("_n")
    return (
        records.select("run_id", "pos").join(repeated, "run_id").filter(F.col("pos") > F.col("first_pos"))
    )


def problems(records: DataFrame) -> DataFrame:
    """One row per record and broken rule. Nothing stops at the first."""
    carries = F.col("status").isin(CARRIES_METRICS)
    empty = F.coalesce(F.size("metrics"), F.lit(0)) <= 0
    digest = F.col("sut.image_digest")
    rules = [
        ("schema too new", F.col("schema") > S.SCHEMA_VERSION),
        ("invocation id missing", (F.col("run.harness_version") >= 2) & blank(F.col("run.invocation_id"))),
        ("trigger bars publication", F.col("run.trigger").isin(BARRED_TRIGGERS)),
        ("fixture environment", F.array_contains("flags", FIXTURE_FLAG)),
        ("image digest empty", blank(digest)),
        ("image digest not sha256", ~blank(digest) & ~digest.startswith("sha256:")),
        ("no version or commit", blank(F.col("sut.version")) & blank(F.col("sut.commit"))),
        ("env_id empty", blank(F.col("run.env_id"))),
        ("env_digest empty", blank(F.col("run.env_digest"))),
        ("dataset_version empty", blank(F.col("run.dataset_version"))),
        ("status without metrics", carries & empty),
        ("metrics without status", ~carries & ~empty),
        ("rep out of range", (F.col("rep") == 0) | (F.col("rep") > F.col("reps"))),
    ]
    of_record = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    bad_units = F.map_filter("metrics", lambda _, m: ~F.coalesce(m["unit"].isin(S.METRIC_UNITS), F.lit(False)))
    not_finite = F.map_filter("metrics", lambda _, m: F.isnan(m["value"]) | (F.abs(m["value"]) == float("inf")))
    of_units = F.transform(F.map_keys(bad_units), lambda name: F.concat(F.lit("unit of "), name))
    of_values = F.transform(F.map_keys(not_finite), lambda name: F.concat(F.lit("value of "), name))
    none = F.array().cast("array<string>")
    every = F.concat(of_record, F.coalesce(of_units, none), F.coalesce(of_values, none))
    return records.select("run_id", "pos", F.explode(every).alias("rule"))


# --- keys ---------------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _piped(*columns: Column) -> Column:
    return F.concat_ws("|", *[_text(c) for c in columns])


def group_key() -> Column:
    """Records may share an axis only if these agree."""
    mode = F.coalesce(F.try_element_at("variant", F.lit("mode")), F.lit("?"))
    return _piped(
        F.col("run.env_id"),
        F.col("run.harness_version"),
        F.col("run.dataset_version"),
        F.col("run.infra.digest"),
        F.concat(F.lit("mode-"), mode),
    )


def config_key() -> Column:
    """The variant map as text, keys sorted: records that differ here are different experiments."""
    entries = F.array_sort(F.map_entries("variant"))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def sitting_key() -> Column:
    """The invocation, or the UTC day for records written before invocations had ids."""
    day = F.date_format(F.timestamp_millis(F.coalesce("run.ts_ms", F.lit(0).cast("long"))), "yyyy-MM-dd")
    return F.coalesce(F.nullif(F.col("run.invocation_id"), F.lit("")), day)


def keyed(records: DataFrame) -> DataFrame:
    """Add the group, sitting, arm and row keys, computed once for everything downstream."""
    version = F.coalesce("sut.version", "sut.commit", F.lit("?"))
    with_keys = records.withColumn("group", group_key()).withColumn("sitting", sitting_key())
    return with_keys.withColumn(
        "arm", _piped(F.col("group"), F.col("sut.entrant"), F.col("sut.variant_id"))
    ).withColumn(
        "row_key",
        _piped(F.col("arm"), version, config_key(), F.col("sitting")),
    )


# --- summarise ----------------------------------------------------------------------------------


def severity(status: Column) -> Column:
    """How bad a status is; one this build does not know outranks every known one."""
    return F.when(status == "ok", 0).when(status == "infra_bound", 1).otherwise(2)


def _long_metrics(keyed_records: DataFrame) -> DataFrame:
    return keyed_records.filter(F.col("status").isin(CARRIES_METRICS)).select(
        "row_key", "pos", F.explode("metrics").alias("metric", "m")
    )


def summarise_metrics(keyed_records: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Median, extremes and spread of every metric of every row, or of the named ``metrics`` alone.

    Unit and direction come from the first record carrying the metric. The median is the mean of the
    two middle measurements, found without gathering a row's repetitions in one place.
    """
    keys = ["row_key", "metric"]
    carried = _long_metrics(keyed_records)
    if metrics is not None:
        carried = carried.filter(F.col("metric").isin(list(metrics)))
    stats = carried.groupBy(*keys).agg(
        F.min_by("m.unit", "pos").alias("unit"),
        F.min_by("m.higher_is_better", "pos").alias("higher_is_better"),
        F.count("m.value").alias("n"),
        F.min("m.value").alias("lo"),
        F.max("m.value").alias("hi"),
    )
    numbers = carried.select(*keys, F.col("m.value").alias("value")).filter("value is not null")
    middles = select_ranks(numbers, keys, "value", {"_low": lower_middle, "_high": upper_middle})
    median = (F.col("_low") + F.col("_high")) / 2
    spread = (
        F.when(F.col("n") < 2, F.lit(0.0))
        .when(F.col("median") != 0, (F.col("hi") - F.col("lo")) / F.when(F.col("median") != 0, F.col("median")))
    )
    return (
        stats.join(middles, keys)
        .withColumn("median", median)
        .select(*keys, "unit", "higher_is_better", "n", "lo", "median", "hi", spread.alias("spread"))
    )


def metric_values(keyed_records: DataFrame) -> DataFrame:
    """Every distinct measurement behind a summarised metric, with how many records measured it."""
    return (
        _long_metrics(keyed_records)
        .select("row_key", "metric", F.col("m.value").alias("value"))
        .filter("value is not null")
        .groupBy("row_key", "metric", "value")
        .agg(F.count("*").alias("copies"))
    )


HEADER = ["version", "commit", "image_digest", "env_id", "harness_version", "dataset_version"]


def summarise_rows(keyed_records: DataFrame) -> DataFrame:
    """One row per arm, version, configuration and sitting, headed by its newest record.

    Of equally new records the earlier in the input heads the row. The status is the worst of them,
    the flags are all of theirs: a caveat on one repetition is a caveat on the number.
    """
    carrying = keyed_records.filter(F.col("status").isin(CARRIES_METRICS))
    header = F.struct(
        F.col("sut.version").alias("version"),
        F.col("sut.commit").alias("commit"),
        F.col("sut.image_digest").alias("image_digest"),
        F.col("run.env_id").alias("env_id"),
        F.col("run.harness_version").alias("harness_version"),
        F.col("run.dataset_version").alias("dataset_version"),
        F.try_element_at("variant", F.lit("mode")).alias("mode"),
        F.coalesce(F.try_element_at("variant", F.lit("approach")), F.lit("undeclared")).alias("approach"),
        F.try_element_at("variant", F.lit("wire_format")).alias("wire_format"),
    )
    ts = F.col("run.ts_ms")
    # told apart before they are gathered: a row holds each flag once, however many records carry it
    flags = (
        carrying.select("row_key", F.explode("flags").alias("flag"))
        .distinct()
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list("flag")).alias("flags"))
    )
    return (
        carrying.groupBy("row_key")
        .agg(
            F.min("group").alias("group"),
            F.min("arm").alias("arm"),
            F.min("sitting").alias("sitting"),
            F.min("sut.entrant").alias("entrant"),
            F.min("sut.variant_id").alias("variant_id"),
            F.min_by(header, F.struct(-ts, F.col("pos"))).alias("h"),
            F.max(ts).alias("ts_ms"),
            F.max_by("status", severity(F.col("status"))).alias("status"),
            F.count("*").alias("reps_counted"),
        )
        .join(flags, "row_key", "left")
        .withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
        .select(
            "row_key",
            "arm",
            "group",
            "sitting",
            "entrant",
            "variant_id",
            "h.*",
            "ts_ms",
            "status",
            "reps_counted",
            "flags",
        )
    )


def attempts(keyed_records: DataFrame) -> DataFrame:
    """Records without publishable numbers, one per arm and sitting.

    Status and note come together from the newest; of equally new ones, from the later in the input.
    """
    failed = keyed_records.filter(~F.coalesce(F.col("status").isin(CARRIES_METRICS), F.lit(False)))
    first = F.struct(
        F.col("run.env_id").alias("env_id"),
        F.col("run.harness_version").alias("harness_version"),
        F.col("run.dataset_version").alias("dataset_version"),
    )
    ts = F.coalesce(F.col("run.ts_ms"), F.lit(0).cast("long"))
    return (
        failed.groupBy("arm", "sitting")
        .agg(
            F.min("group").alias("group"),
            F.min("sut.entrant").alias("entrant"),
            F.min("sut.variant_id").alias("variant_id"),
            F.max_by(F.struct("status", "note"), F.struct(ts, F.col("pos"))).alias("newest"),
            F.max(ts).alias("ts_ms"),
            F.count("*").alias("reps_counted"),
            F.min_by(first, "pos").alias("first"),
        )
        .select(
            "arm",
            "group",
            "sitting",
            "entrant",
            "variant_id",
            "newest.*",
            "ts_ms",
            "reps_counted",
            "first.*",
        )
    )


def latest_sittings(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """Each arm's newest sitting over rows and attempts; of equal times the greater sitting id."""
    both = rows.select("arm", "ts_ms", "sitting").unionByName(tried.select("arm", "ts_ms", "sitting"))
    return both.groupBy("arm").agg(F.max(F.struct("ts_ms", "sitting")).alias("newest")).select(
        "arm", F.col("newest.sitting").alias("sitting")
    )


def publish(rows: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and attempts of each arm's newest sitting; superseded ones drop out."""
    newest = latest_sittings(rows, tried)
    return rows.join(newest, ["arm", "sitting"], "left_semi"), tried.join(newest, ["arm", "sitting"], "left_semi")


def groups(rows: DataFrame, tried: DataFrame) -> DataFrame:
    columns = ["group", "env_id", "harness_version", "dataset_version"]
    return rows.select(*columns).unionByName(tried.select(*columns)).distinct()


def generated_at(records: DataFrame) -> DataFrame:
    return records.agg(F.max("run.ts_ms").alias("generated_ms"))


# --- rank ---------------------------------------------------------------------------------------


def unranked_because() -> Column:
    """Empty for an arm that may be ranked."""
    return (
        F.when(F.col("status") == "infra_bound", F.lit("infra-bound"))
        .when(F.col("status") != "ok", F.lit("unknown status"))
        .when(F.col("approach") != "realistic", F.col("approach"))
        .otherwise(F.lit(""))
    )


def eligibility(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unranked_because", unranked_because()).withColumn(
        "plotted", F.col("status") != "infra_bound"
    )


def lanes(rows: DataFrame, metrics: DataFrame, variants: DataFrame, metric: str = S.PRIMARY_METRIC) -> DataFrame:
    """Rows with the chosen metric and their descriptor order.

    ``variants`` is ``(entrant, variant_id, display_order, variant_index)``. An undeclared variant
    sorts after its system's declared ones, an undeclared system after all.
    """
    chosen = metrics.filter(F.col("metric") == metric).drop("metric")
    per_entrant = variants.groupBy("entrant").agg(
        F.min("display_order").alias("display_order"), F.count("*").alias("declared")
    )
    index = variants.select("entrant", "variant_id", "variant_index")
    return (
        eligibility(rows)
        .join(chosen, "row_key", "left")
        .join(per_entrant, "entrant", "left")
        .join(index, ["entrant", "variant_id"], "left")
        .withColumn("display_order", F.coalesce("display_order", F.lit(1_000_000_000)))
        .withColumn("variant_index", F.coalesce("variant_index", "declared", F.lit(0)))
        .drop("declared")
    )


def lane_rank(lane_rows: DataFrame) -> DataFrame:
    """Position of every lane in its group: ranked ones by the metric, then the rest as declared.

    Adds ``ranked`` (null where not ranked) and ``position``.
    """
    rankable = (F.col("unranked_because") == "") & F.col("median").isNotNull()
    direction = F.when(F.col("higher_is_better"), -F.col("median")).otherwise(F.col("median"))
    declared = [F.col("display_order"), F.col("variant_index"), F.col("variant_id"), F.col("row_key")]
    # the dealing by ranges samples its input first; lanes are few columns of long plans, so they are written once
    marked = kept(lane_rows.withColumn("_rankable", rankable))
    major = F.when(F.col("_rankable"), direction).otherwise(F.col("display_order").cast("double"))
    placed = rank_within(marked, ["group", "_rankable"], major, declared, "_place")
    sizes = marked.groupBy("group").agg(F.count_if(F.col("_rankable")).alias("_ranked_lanes"))
    return (
        placed.join(sizes, "group")
        .withColumn("ranked", F.when(F.col("_rankable"), F.col("_place")))
        .withColumn(
            "position", F.col("_place") + F.when(F.col("_rankable"), F.lit(0)).otherwise(F.col("_ranked_lanes"))
        )
        .drop("_rankable", "_place", "_ranked_lanes")
    )


def sort_lanes(ranked_lanes: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Lanes ordered by a chosen metric: ranked before unranked, unmeasured last, then lane order.

    ``tier`` orders before ``place``; direction comes from the metric itself.
    """
    chosen = metrics.filter(F.col("metric") == metric).select(
        "row_key", F.col("median").alias("sort_value"), F.col("higher_is_better").alias("sort_up")
    )
    tier = F.when(F.col("ranked").isNotNull(), 0).otherwise(2) + F.when(F.col("sort_value").isNull(), 1).otherwise(0)
    major = F.coalesce(
        F.when(F.col("sort_up"), -F.col("sort_value")).otherwise(F.col("sort_value")),
        F.col("position").cast("double"),
    )
    joined = ranked_lanes.join(chosen, "row_key", "left").withColumn("tier", tier)
    return rank_within(joined, ["group", "tier"], major, [F.col("position")], "place")


def tied_with_leader(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """For every group and metric: its leader, and the lanes whose measured range touches the leader's."""
    fit = eligibility(rows).filter((F.col("unranked_because") == "") & F.col("plotted"))
    measured = fit.select("row_key", "group", "ts_ms").join(metrics, "row_key")
    merit = F.when(F.col("higher_is_better"), -F.col("median")).otherwise(F.col("median"))
    leaders = measured.groupBy("group", "metric").agg(
        F.min_by(
            F.struct(F.col("row_key").alias("leader"), F.col("lo").alias("leader_lo"), F.col("hi").alias("leader_hi")),
            F.struct(merit, -F.col("ts_ms"), F.col("row_key")),
        ).alias("l")
    )
    near = (F.col("lo") <= F.col("leader_hi")) & (F.col("leader_lo") <= F.col("hi"))
    return (
        measured.join(leaders.select("group", "metric", "l.*"), ["group", "metric"])
        .withColumn("leads", F.col("row_key") == F.col("leader"))
        .withColumn("tied", ~F.col("leads") & near)
        .select("group", "metric", "row_key", "leader", "leads", "tied")
    )


def facets(entrants: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts per value of every field that has at least two values."""
    pairs = [part for f in fields for part in (F.lit(f), F.col(f))]
    counted = (
        entrants.select(F.stack(F.lit(len(fields)), *pairs).alias("field", "value"))
        .filter(~blank(F.col("value")))
        .groupBy("field", "value")
        .agg(F.count("*").alias("entrants"))
    )
    several = counted.groupBy("field").agg(F.count("*").alias("_values")).filter("_values >= 2")
    return counted.join(several, "field", "left_semi")


# --- declared against measured ------------------------------------------------------------------


def orphan_variants(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Published variants no descriptor declares."""
    return rows.select("entrant", "variant_id").distinct().join(variants, ["entrant", "variant_id"], "left_anti")


def last_measured(arms: DataFrame, records: DataFrame) -> DataFrame:
    """Every declared arm with its newest record, if it has one; equal times take the later record."""
    newest = (
        records.groupBy(F.col("sut.entrant").alias("entrant"), F.col("sut.variant_id").alias("variant_id"))
        .agg(
            F.max_by(
                F.struct("run.ts_ms", "run.harness_version", "run.dataset_version"),
                F.struct(F.col("run.ts_ms"), F.col("pos")),
            ).alias("r")
        )
        .select("entrant", "variant_id", "r.*")
    )
    return arms.join(newest, ["entrant", "variant_id"], "left")


def stale_arms(arms: DataFrame, records: DataFrame, *, harness_version: int, dataset_version: str) -> DataFrame:
    """Declared arms whose newest record cannot stand beside a current one, and why."""
    why = (
        F.when(F.col("ts_ms").isNull(), F.lit("never measured"))
        .when(~F.col("harness_version").eqNullSafe(F.lit(harness_version)), F.lit("harness differs"))
        .when(~F.col("dataset_version").eqNullSafe(F.lit(dataset_version)), F.lit("dataset differs"))
    )
    return last_measured(arms, records).withColumn("why", why).filter("why is not null")


def knob_violations(records: DataFrame, constraints: DataFrame) -> DataFrame:
    """Records whose knobs break a declared constraint of their system.

    ``constraints`` is ``(entrant, knob, exceeds, at_least)`` with exactly one relation. A knob that
    is unset or not an integer is a violation, because it cannot be checked.
    """
    facts = records.select("run_id", F.col("sut.entrant").alias("entrant"), "variant")
    value = F.try_element_at("variant", F.col("knob")).try_cast("long")
    other = F.try_element_at("variant", F.col("exceeds")).try_cast("long")
    misstated = F.col("exceeds").isNull() == F.col("at_least").isNull()
    by_other = F.when(value.isNull() | other.isNull(), F.lit("cannot be checked")).when(
        value <= other, F.lit("must exceed")
    )
    by_floor = F.when(value.isNull(), F.lit("cannot be checked")).when(
        value < F.col("at_least"), F.lit("must be at least")
    )
    problem = (
        F.when(misstated, F.lit("misstated")).when(F.col("exceeds").isNotNull(), by_other).otherwise(by_floor)
    )
    return (
        facts.join(constraints, "entrant")
        .select("run_id", "entrant", "knob", "exceeds", "at_least", problem.alias("problem"))
        .filter("problem is not null")
    )


# --- assemble -----------------------------------------------------------------------------------

# Unit and direction of every metric a run may publish.
METRIC_SPECS = {
    "rows_per_s": ("records/s", True),
    "cpu_us_per_row": ("us", False),
    "cores_used": ("cores", False),
    "rows_per_s_per_core": ("records/s", True),
    "peak_anon_bytes": ("bytes", False),
    "peak_charged_bytes": ("bytes", False),
    "throttled_us": ("us", False),
    "duplicate_rows": ("rows", False),
    "data_plane_cores_used": ("cores", False),
    "data_plane_peak_anon_bytes": ("bytes", False),
    "server_cpu_us_per_row": ("us", False),
    "server_cpu_us_per_written_row": ("us", False),
    "server_cpu_us": ("us", False),
    "server_written_rows": ("rows", False),
    "server_rows_per_insert": ("rows", True),
    "server_cpu_wait_us": ("us", False),
    "server_inserted_bytes": ("bytes", False),
    "gc_pause_total_us": ("us", False),
    "gc_pause_max_us": ("us", False),
    "gc_pause_p99_us": ("us", False),
    "gc_pause_p999_us": ("us", False),
    "jvm_heap_configured_bytes": ("bytes", False),
    "jvm_heap_committed_peak_bytes": ("bytes", False),
    "jvm_heap_live_peak_bytes": ("bytes", False),
}
CONTROL_PLANE = "control_plane_"  # prefix of the collector metrics of a run's control plane


def collector_metrics(summary: DataFrame, prefix: str = "") -> DataFrame:
    """One row per run of ``gc_summary``'s figures under their published names, in microseconds and bytes."""
    figures = {
        "gc_pause_total_us": F.col("total_ns") / 1000.0,
        "gc_pause_max_us": F.col("max_ns") / 1000.0,
        "gc_pause_p99_us": F.col("p99_ns") / 1000.0,
        "gc_pause_p999_us": F.col("p999_ns") / 1000.0,
        "jvm_heap_configured_bytes": F.col("max_bytes"),
        "jvm_heap_committed_peak_bytes": F.col("peak_committed_bytes"),
        "jvm_heap_live_peak_bytes": F.col("peak_live_bytes"),
    }
    return summary.select("run", *[c.alias(prefix + name) for name, c in figures.items()])


def _entry(name: Column, value: Column, unit: Column, up: Column) -> Column:
    metric = F.struct(value.cast("double").alias("value"), unit.alias("unit"), up.alias("higher_is_better"))
    return F.struct(name.alias("key"), metric.alias("value"))


def _mode_entry(e: Column) -> Column:
    """Unit and direction of a mode metric, told by its name."""
    name = e["key"]
    unit = (
        F.when(name == "kept_up_share", F.lit("ratio"))
        .when(name == "offered_rows_per_s", F.lit("records/s"))
        .when(name.endswith("_us"), F.lit("us"))
        .otherwise(F.lit("rows"))
    )
    return _entry(name, e["value"], unit, ~name.endswith("_us"))


def assemble_records(runs: DataFrame) -> DataFrame:
    """Attach each run's metrics as a map; a run whose status carries none has an empty one.

    A column of ``METRIC_SPECS``, with or without the control plane's prefix, that is absent or null contributes
    no entry; the map ``mode_metrics``, where there is one, contributes all of its own. ``variant``, ``flags`` and
    ``note`` are kept, and empty where the runs have none.
    """
    specs = METRIC_SPECS | {CONTROL_PLANE + n: s for n, s in METRIC_SPECS.items() if n.startswith(("gc_", "jvm_"))}
    entries = F.array(
        *[
            F.when(F.col(name).isNotNull(), _entry(F.lit(name), F.col(name), F.lit(unit), F.lit(up)))
            for name, (unit, up) in specs.items()
            if name in runs.columns
        ]
    )
    if "mode_metrics" in runs.columns:
        entries = F.concat(entries, F.transform(F.map_entries("mode_metrics"), _mode_entry))
    present = F.filter(entries, lambda e: e.isNotNull() & F.col("status").isin(CARRIES_METRICS))
    empty = {"variant": "map<string,string>", "flags": "array<string>", "note": "string"}
    blank_of = {
        "variant": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        "flags": F.array().cast("array<string>"),
        "note": F.lit(None).cast("string"),
    }
    rest = {n: F.coalesce(n, blank_of[n]) if n in runs.columns else blank_of[n].cast(kind) for n, kind in empty.items()}
    return runs.withColumns({"metrics": F.map_from_entries(present), **rest})
