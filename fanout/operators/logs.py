"""Server query logs, part logs and garbage-collector logs of many runs at once.

Refusals are rows, not exceptions: one bad run must not stop the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.operators.intervals import in_windows, window_sums
from fanout.functions.numeric import jvm_size
from fanout.operators.ordering import nearest_rank, select_ranks
from fanout.session import cut

# --- server query log -------------------------------------------------------------------------


def parse_profile_events(df: DataFrame, field: str = "profile_events", out: str = "counters") -> DataFrame:
    """Parse ``{'Key':123,...}`` text into a map of the known counters.

    Adds ``out`` and ``malformed``. An entry that is not a quoted key and an unsigned integer spoils
    the field; an unknown key is only ignored.
    """
    body = F.trim(F.regexp_extract(F.trim(field), r"^\{(.*)\}$", 1))
    braced = F.coalesce(F.trim(field).rlike(r"^\{.*\}$"), F.lit(False))
    entries = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))
    good = r"^\s*'([^']*)'\s*:\s*\+?([0-9]+)\s*$"
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e, good, 1).alias("key"),
            F.regexp_extract(e, good, 2).try_cast("long").alias("value"),
        ),
    )
    whole = braced & F.forall(entries, lambda e: e.rlike(good)) & F.forall(pairs, lambda p: p["value"].isNotNull())
    known = F.array(*[F.lit(c) for c in S.PROFILE_COUNTERS])
    kept = F.filter(pairs, lambda p: F.array_contains(known, p["key"]))
    # a repeated key keeps its last value
    folded = F.aggregate(
        kept,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))
        ),
    )
    return df.withColumn("malformed", ~whole).withColumn(out, F.when(whole, folded))


def wanted_inserts(log: DataFrame, tables: Sequence[str], *, forwarded: bool = False) -> DataFrame:
    """Inserts into ``tables``, projected to the known counters. Forwarded ones are *not* the initial query."""
    wanted = F.array(*[F.lit(t) for t in tables])
    initial = ~F.col("is_initial_query") if forwarded else F.col("is_initial_query")
    return log.filter((F.col("query_kind") == "Insert") & initial & F.arrays_overlap("tables", wanted)).withColumn(
        "counters", F.map_filter("profile_events", lambda k, _: k.isin(S.PROFILE_COUNTERS))
    )


def attribute_inserts(
    log: DataFrame, tables: Sequence[str], from_ms: int, to_ms: int, *, forwarded: bool = False
) -> DataFrame:
    """Inserts into ``tables`` started in ``[from, to)``, projected to the known counters.

    The date predicate is redundant and one day wide on both sides: it prunes a log partitioned by date.
    """
    start = F.col("query_start_time")
    first_day = F.date_sub(F.to_date(F.timestamp_millis(F.lit(from_ms))), 1)
    last_day = F.date_add(F.to_date(F.timestamp_millis(F.lit(to_ms))), 1)
    in_time = log.filter(F.col("event_date").between(first_day, last_day)).filter(
        (start >= F.timestamp_millis(F.lit(from_ms))) & (start < F.timestamp_millis(F.lit(to_ms)))
    )
    return wanted_inserts(in_time, tables, forwarded=forwarded)


def window_days(windows: DataFrame) -> DataFrame:
    """The days that any of the windows (from_ms, to_ms) touches, and one more on both sides, each once."""
    first = F.date_sub(F.to_date(F.timestamp_millis("from_ms")), 1)
    last = F.date_add(F.to_date(F.timestamp_millis("to_ms")), 1)
    spans = windows.filter("from_ms < to_ms").select(first.alias("first"), last.alias("last"))
    return spans.distinct().select(F.explode(F.sequence("first", "last")).alias("event_date")).distinct()


def attribute_to_runs(
    log: DataFrame, windows: DataFrame, tables: Sequence[str], *, forwarded: bool = False
) -> DataFrame:
    """Each insert once for every run, of ``windows`` (run, from_ms, to_ms), in whose window it started.

    Only days that a window touches are read of a log partitioned by date: the join with those days
    prunes the partitions when the query runs. The log must have no columns of the windows' names.
    """
    dated = log.join(window_days(windows), "event_date", "left_semi")
    inserts = wanted_inserts(dated, tables, forwarded=forwarded)
    return in_windows(inserts, F.unix_millis("query_start_time"), windows.select("run", "from_ms", "to_ms"), "from_ms", "to_ms")


def _counter(name: str) -> Column:
    """A counter's value, null where the server never mentioned it."""
    return F.try_element_at("counters", F.lit(name))


def query_cpu() -> Column:
    """User plus system time; null only if both are absent."""
    user, system = _counter("UserTimeMicroseconds"), _counter("SystemTimeMicroseconds")
    zero = F.lit(0).cast("long")
    return F.when(user.isNotNull() | system.isNotNull(), F.coalesce(user, zero) + F.coalesce(system, zero))


def _cost_terms() -> dict[str, Column]:
    """What is added up over inserts; the counts are never null."""
    finish = F.col("type") == "QueryFinish"

    def when(holds: Column) -> Column:
        return F.when(holds, 1).otherwise(0)

    def total(name: str) -> Column:
        return F.when(finish, _counter(name))

    return {
        "queries": when(finish),
        "started": when(F.col("type") == "QueryStart"),
        "failed": when(F.col("type").startswith("Exception")),
        "written_rows": F.when(finish, F.col("written_rows")),
        "cpu_us": F.when(finish, query_cpu()),
        "user_us": total("UserTimeMicroseconds"),
        "system_us": total("SystemTimeMicroseconds"),
        "real_us": total("RealTimeMicroseconds"),
        "os_cpu_virtual_us": total("OSCPUVirtualTimeMicroseconds"),
        "os_cpu_wait_us": total("OSCPUWaitMicroseconds"),
        "inserted_rows": total("InsertedRows"),
        "inserted_bytes": total("InsertedBytes"),
        "queries_without_cpu": when(finish & query_cpu().isNull()),
        "async_queries": when(finish & (_counter("AsyncInsertQuery") > 0)),
    }


COSTS = [
    "written_rows",
    "cpu_us",
    "user_us",
    "system_us",
    "real_us",
    "os_cpu_virtual_us",
    "os_cpu_wait_us",
    "inserted_rows",
    "inserted_bytes",
]


def server_cost(inserts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, what the attributed inserts cost the server; figures are null where refused."""
    return _priced(inserts.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _cost_terms().items()]), keys)


def run_costs(log: DataFrame, windows: DataFrame, tables: Sequence[str], *, forwarded: bool = False) -> DataFrame:
    """``server_cost`` by run of ``attribute_to_runs``, as sums over windows: no insert is copied for a run."""
    dated = log.join(window_days(windows), "event_date", "left_semi")
    inserts = wanted_inserts(dated, tables, forwarded=forwarded)
    terms = _cost_terms()
    # a sum over nothing but nulls is null
    told = {f"_with_{n}": F.when(terms[n].isNotNull(), 1) for n in COSTS}
    found = window_sums(
        inserts, F.unix_millis("query_start_time"), {"_inserts": F.lit(1), **terms, **told}, windows, "from_ms", "to_ms", ["run"]
    ).filter("_inserts > 0")
    shown = [F.when(F.col(f"_with_{n}") > 0, F.col(n)).alias(n) if n in COSTS else F.col(n) for n in terms]
    return _priced(found.select("run", *shown), ["run"])


def _priced(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    refusal = (
        F.when(F.col("queries") == 0, F.lit("no attributed inserts"))
        .when(F.col("async_queries") > 0, F.lit("async inserts"))
        .when(F.col("queries_without_cpu") == F.col("queries"), F.lit("no cpu counters"))
    )
    refused = found.withColumn("refusal", refusal)
    # the two CPU halves read as zero when only the other one was reported
    shown = {c: F.col(c) for c in COSTS}
    shown["user_us"] = F.coalesce("user_us", F.lit(0))
    shown["system_us"] = F.coalesce("system_us", F.lit(0))
    return refused.select(
        *keys,
        "queries",
        "started",
        "failed",
        F.greatest(F.col("started") - F.col("queries") - F.col("failed"), F.lit(0)).alias("in_flight"),
        "queries_without_cpu",
        *[F.when(F.col("refusal").isNull(), c).alias(name) for name, c in shown.items()],
        "refusal",
    )


def server_metrics(costs: DataFrame, rows: str = "rows") -> DataFrame:
    """Per landed row, per written row, per insert; what the server never reported stays null."""
    landed, written = F.col(rows), F.col("written_rows")
    return costs.select(
        "*",
        F.when(landed > 0, F.col("cpu_us") / landed).alias("server_cpu_us_per_row"),
        F.when(written > 0, F.col("cpu_us") / written).alias("server_cpu_us_per_written_row"),
        F.when(F.col("queries") > 0, written / F.col("queries"))
        .otherwise(F.lit(0.0))
        .alias("server_rows_per_insert"),
        F.col("os_cpu_wait_us").alias("server_cpu_wait_us"),
        F.col("inserted_bytes").alias("server_inserted_bytes"),
    )


def _logged(windows: DataFrame) -> DataFrame:
    """Windows (run, from_ms, to_ms) in microseconds; ``event_time`` counts after the start."""
    return windows.select("run", (F.col("from_ms") * 1000 + 1).alias("_from"), (F.col("to_ms") * 1000).alias("_to"))


def logged_in_windows(log: DataFrame, windows: DataFrame) -> DataFrame:
    """Each log row once for every run, of ``windows`` (run, from_ms, to_ms), with its ``event_time`` after the start."""
    return in_windows(log, F.unix_micros("event_time"), _logged(windows), "_from", "_to").drop("_from", "_to")


def part_log_summary(parts: DataFrame, keys: Sequence[str], since: Column) -> DataFrame:
    """Per key since a time: new parts and merges with their rows; keys without a new part drop out."""
    return part_totals(parts.filter(F.col("event_time") > since), keys)


def part_totals(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: new parts and merges with their rows; keys without a new part drop out."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _part_terms().items()]).filter("parts_written > 0")


def _part_terms() -> dict[str, Column]:
    new, merged = F.col("event_type") == "NewPart", F.col("event_type") == "MergeParts"
    zero, rows = F.lit(0).cast("long"), F.coalesce("rows", F.lit(0).cast("long"))
    return {
        "parts_written": F.when(new, 1).otherwise(0),
        "rows_written": F.when(new, rows).otherwise(zero),
        "merges": F.when(merged, 1).otherwise(0),
        "rows_merged": F.when(merged, rows).otherwise(zero),
    }


def run_part_totals(parts: DataFrame, windows: DataFrame) -> DataFrame:
    """``part_totals`` by run and table of ``logged_in_windows``, as sums over windows. Every window asks for every table."""
    spans = _logged(windows).crossJoin(parts.select("table").distinct())
    found = window_sums(parts, F.unix_micros("event_time"), _part_terms(), spans, "_from", "_to", ["run"], ["table"])
    return found.filter("parts_written > 0").select("run", "table", *_part_terms())


def network_wait(log: DataFrame, keys: Sequence[str], since: Column) -> DataFrame:
    """Per key since a time: finished inserts, their duration and the time spent receiving."""
    return network_totals(log.filter(F.col("event_time") > since), keys)


def network_totals(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: finished inserts, their duration and the time spent receiving."""
    finished = _finished_inserts(log)
    return finished.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _network_terms().items()]).filter("duration_ms > 0")


def _finished_inserts(log: DataFrame) -> DataFrame:
    return log.filter((F.col("type") == "QueryFinish") & (F.col("query_kind") == "Insert"))


def _network_terms() -> dict[str, Column]:
    received = F.coalesce(F.try_element_at("profile_events", F.lit("NetworkReceiveElapsedMicroseconds")), F.lit(0))
    return {"inserts": F.lit(1), "duration_ms": F.col("duration_ms"), "waiting_us": received}


def run_network_totals(log: DataFrame, windows: DataFrame) -> DataFrame:
    """``network_totals`` by run of ``logged_in_windows``, as sums over windows: no row is copied for a run."""
    found = window_sums(
        _finished_inserts(log), F.unix_micros("event_time"), _network_terms(), _logged(windows), "_from", "_to", ["run"]
    )
    return found.filter("duration_ms > 0")


def settle_reading(rungs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, the rung that waited longest; of equal waits the later rung."""
    return rungs.groupBy(*keys).agg(
        F.max("wait_us").alias("max_wait_us"),
        F.max_by("concurrency", F.struct("wait_us", "concurrency")).alias("at_concurrency"),
    )


# --- garbage-collector log --------------------------------------------------------------------

# The decorations are leading [..] groups: the last one holds the tags, one before it may hold the
# uptime. A '[' that is never closed makes a line foreign.
_TAGS = r"^(?:\[[^\]]*\])*\[([^\]]*)\](?!\[)"
_MESSAGE = r"^(?:\[[^\]]*\])+(?!\[)(.*)$"
_UPTIME = r"^(?:\[[^\]]*\])*?\[\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)s\s*\]\["
# Optional cycle id, optional short generation marker, the word, the rest.
_PAUSE = r"^(?:GC\(([^)]*)\)\s*)?(?:([A-Za-z0-9]{1,2}): \s*)?Pause(.*)$"
_HEAP = r"^[^>(]*->[^>(]*\([^)]*\)$"


def gc_lines(lines: DataFrame) -> DataFrame:
    """Split unified-logging lines into uptime, tags and message.

    ``lines`` is ``(run, container, line_no, line)``. Adds ``kind``: ``blank``, ``foreign`` for a
    line without decorations, ``other`` without the gc tag, else ``gc``. ``tags`` is comma-joined.
    Padding inside the tag field varies within a file, so it is trimmed away.
    """
    tags = F.regexp_replace(F.trim(F.regexp_extract("line", _TAGS, 1)), r"\s*,\s*", ",")
    split = lines.select(
        "run",
        "container",
        "line_no",
        "line",
        F.regexp_extract("line", _UPTIME, 1).try_cast("double").alias("uptime_s"),
        tags.alias("tags"),
        F.trim(F.regexp_extract("line", _MESSAGE, 1)).alias("message"),
    )
    kind = (
        F.when(F.trim("line") == "", F.lit("blank"))
        .when(~(F.col("line").startswith("[") & F.col("line").rlike(_TAGS)), F.lit("foreign"))
        .when(_tagged("gc"), F.lit("gc"))
        .otherwise(F.lit("other"))
    )
    return split.withColumn("kind", kind)


def _tagged(tag: str) -> Column:
    return F.concat(F.lit(","), F.col("tags"), F.lit(",")).contains(f",{tag},")


# What a gc line can say besides being one. Capacities are matched by the end of their key, because
# collectors prefix them differently.
CAPACITIES = {"max": "Max Capacity", "initial": "Initial Capacity", "min": "Min Capacity"}


def _facts(split: DataFrame, inside: Column | None = None) -> DataFrame:
    """Every line with the one thing it says, in ``fact``, and that thing's columns.

    ``fact`` is the line's kind, or for a gc line ``collector``, ``version``, a capacity, ``bad
    size``, ``pause``, ``bad pause``, or ``pause outside`` when ``inside`` does not hold. ``text``
    is the collector, version or pause label; ``num`` a capacity; the rest belong to pauses.
    """
    message = F.col("message")
    gc = F.col("kind") == "gc"
    names = message.startswith("Using ") | message.startswith("Initializing ")
    named = gc & names
    stated = gc & ~names & _tagged("init") & message.contains(":")
    said = gc & ~_tagged("start") & message.rlike(_PAUSE)
    marked = split.select(
        "*",
        F.when(stated, F.trim(F.substring_index(message, ":", 1))).alias("key"),
        F.when(stated, F.trim(F.substring(message, F.instr(message, ":") + 1, F.length(message))))
        .when(named, F.trim(F.substring(message, F.instr(message, " ") + 1, F.length(message))))
        .alias("stated"),
        F.when(said, F.filter(F.split(F.regexp_extract(message, _PAUSE, 3), r"\s+"), lambda t: t != "")).alias("tokens"),
    )
    heap = F.get("tokens", F.size("tokens") - 2)
    parsed = marked.select(
        "*",
        jvm_size(F.col("stated")).alias("num"),
        F.regexp_extract(F.get("tokens", F.size("tokens") - 1), r"^(\d+(?:\.\d+)?)ms$", 1).try_cast("double").alias("ms"),
        F.when(heap.contains("->"), heap).alias("heap"),
    )
    words = F.size("tokens") - F.when(F.col("heap").isNotNull(), 2).otherwise(1)
    sizes = F.transform(F.split(F.when(F.col("heap").rlike(_HEAP), F.col("heap")), r"->|\(|\)"), jvm_size)
    measured = parsed.withColumn("sizes", sizes)
    sized = measured.select(
        "*",
        F.coalesce(F.array_join(F.slice("tokens", 1, words), " "), F.col("stated")).alias("text"),
        # whole nanoseconds, so that sums and ranks are exact
        F.round(F.col("ms") * 1e6).cast("long").alias("pause_ns"),
        F.get("sizes", F.lit(0)).alias("before_bytes"),
        F.get("sizes", F.lit(1)).alias("after_bytes"),
        F.get("sizes", F.lit(2)).alias("capacity_bytes"),
    )
    unreadable = F.col("heap").isNotNull() & (
        F.col("before_bytes").isNull() | F.col("after_bytes").isNull() | F.col("capacity_bytes").isNull()
    )
    error = F.when(F.col("tokens").isNotNull(), F.when(F.col("ms").isNull(), F.lit("no duration")).when(unreadable, F.lit("unreadable size")))
    judged = sized.withColumn("error", error)
    fact = F.when(F.col("error").isNotNull(), F.lit("bad pause"))
    if inside is not None:
        fact = fact.when(F.col("tokens").isNotNull() & ~F.coalesce(inside, F.lit(False)), F.lit("pause outside"))
    fact = fact.when(F.col("tokens").isNotNull(), F.lit("pause"))
    for name, ending in CAPACITIES.items():
        sized_ok = F.when(F.col("num").isNull(), F.lit("bad size")).otherwise(F.lit(name))
        fact = fact.when(F.col("key").endswith(ending), sized_ok)
    fact = fact.when(F.col("key") == "Version", F.lit("version"))
    fact = fact.when(F.col("stated").isNotNull() & F.col("key").isNull(), F.lit("collector"))
    return judged.withColumn("fact", fact.otherwise(F.col("kind")))


def _said(fact: str, column: str) -> Column:
    """From the per-fact aggregate: the latest value of one fact."""
    return F.max(F.when(F.col("fact") == fact, F.col(column)))


def gc_heap_config(split: DataFrame) -> DataFrame:
    """Per container: collector, version and configured capacities; a later line overwrites."""
    latest = (
        _facts(split.filter("kind = 'gc'"))
        .groupBy("run", "container", "fact")
        .agg(F.max(F.struct("line_no", "text", "num")).alias("l"), F.count("*").alias("n"))
        .select("run", "container", "fact", "l.text", "l.num", "n")
    )
    return latest.groupBy("run", "container").agg(
        _said("collector", "text").alias("collector"),
        _said("version", "text").alias("version"),
        *[_said(c, "num").alias(f"{c}_bytes") for c in CAPACITIES],
        F.coalesce(_said("bad size", "n"), F.lit(0)).alias("bad_sizes"),
    )


def gc_pauses(split: DataFrame) -> DataFrame:
    """One row per announced pause that is not a start line.

    A pause without a duration, or with an unreadable heap triple, has ``error`` set: a change of
    format must not read as fewer or shorter pauses.
    """
    announced = (F.col("kind") == "gc") & ~_tagged("start") & F.col("message").rlike(_PAUSE)
    return _facts(split.filter(announced)).select(
        "run",
        "container",
        "line_no",
        F.regexp_extract("message", _PAUSE, 1).try_cast("long").alias("gc_id"),
        "uptime_s",
        F.nullif(F.regexp_extract("message", _PAUSE, 2), F.lit("")).alias("generation"),
        F.col("text").alias("label"),
        "pause_ns",
        "before_bytes",
        "after_bytes",
        "capacity_bytes",
        "error",
    )


def gc_by_label(pauses: DataFrame) -> DataFrame:
    """Readable pauses by label. They are told apart while they are counted: a filter ahead would be pushed below the
    parsing and parse every line many times over."""
    good = F.col("error").isNull()
    counted = pauses.groupBy("run", "container", "label").agg(
        F.count_if(good).alias("pauses"), F.sum(F.when(good, F.col("pause_ns"))).alias("total_ns")
    )
    return counted.filter("pauses > 0")


GC_QUANTILES = {"p50_ns": 0.5, "p99_ns": 0.99, "p999_ns": 0.999}


def gc_summary(split: DataFrame, uptime_window: tuple[float, float] | None = None) -> DataFrame:
    """Per container: counts, totals, nearest-rank quantiles, heap peaks and configured heap.

    Refused where the file is not unified logging, has no gc lines, begins after its
    initialisation block, holds an unreadable pause or size, or lacks uptimes under a window.
    Lines are first reduced to one row per container, fact and pause length, and checkpointed when
    this is called; the rest works on that.
    """
    keys = ["run", "container"]
    inside = None
    if uptime_window is not None:
        inside = (F.col("uptime_s") >= uptime_window[0]) & (F.col("uptime_s") < uptime_window[1])
    reduced = cut(
        _facts(split, inside)
        .groupBy(*keys, "fact", "pause_ns")
        .agg(
            F.count("*").alias("n"),
            F.count("uptime_s").alias("timed"),
            F.min(F.struct("line_no", "uptime_s")).alias("first"),
            F.max(F.struct("line_no", "uptime_s", "text", "num")).alias("last"),
            F.max("capacity_bytes").alias("capacity_bytes"),
            F.max("before_bytes").alias("before_bytes"),
            F.max("after_bytes").alias("after_bytes"),
        )
    )
    paused = F.col("fact") == "pause"

    def count(*facts: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("fact").isin(*facts), F.col("n"))), F.lit(0))

    def latest(fact: str, column: str) -> Column:
        return F.max(F.when(F.col("fact") == fact, F.struct("last.line_no", f"last.{column}")))[column]

    unlogged = ["blank", "foreign"]
    facts = reduced.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~F.col("fact").isin(*unlogged), F.col("n"))), F.lit(0)).alias("decorated"),
        F.coalesce(F.sum(F.when(~F.col("fact").isin(*unlogged, "other"), F.col("n"))), F.lit(0)).alias("gc_lines"),
        count("foreign").alias("foreign"),
        count("bad size").alias("bad_sizes"),
        count("bad pause").alias("bad_pauses"),
        F.sum(F.when(F.col("fact").isin("pause", "pause outside"), F.col("n") - F.col("timed"))).alias("no_uptime"),
        latest("collector", "text").alias("collector"),
        latest("max", "num").alias("max_bytes"),
        count("pause").alias("pauses"),
        F.sum(F.when(paused, F.col("n") * F.col("pause_ns"))).alias("total_ns"),
        # of equally long pauses, the last one's label
        F.max(F.when(paused, F.struct("pause_ns", "last.line_no", "last.text"))).alias("worst"),
        F.min(F.when(paused, F.col("first"))).alias("first"),
        F.max(F.when(paused, F.col("last"))).alias("last"),
        F.max(F.when(paused, F.col("capacity_bytes"))).alias("peak_committed_bytes"),
        F.max(F.when(paused, F.col("before_bytes"))).alias("peak_occupancy_bytes"),
        F.max(F.when(paused, F.col("after_bytes"))).alias("peak_live_bytes"),
    )
    # other facts weigh nothing; filtering them out would push the whole parse into the filter
    weighed = reduced.select(
        *keys,
        F.coalesce("pause_ns", F.lit(0).cast("long")).alias("pause_ns"),
        F.when(paused, F.col("n")).otherwise(F.lit(0)).alias("n"),
    )
    quantiles = {n: nearest_rank(q) for n, q in GC_QUANTILES.items()}
    ranked = select_ranks(weighed, keys, "pause_ns", quantiles, weight="n")
    refusal = (
        F.when(F.col("decorated") == 0, F.lit("not unified logging"))
        .when(F.col("bad_sizes") > 0, F.lit("unreadable size"))
        .when(F.col("bad_pauses") > 0, F.lit("unreadable pause"))
        .when(F.col("gc_lines") == 0, F.lit("no gc lines"))
        .when(F.col("collector").isNull() & F.col("max_bytes").isNull(), F.lit("no collector initialised"))
    )
    if uptime_window is not None:
        refusal = refusal.when(F.col("no_uptime") > 0, F.lit("no uptime"))
    refused = facts.join(ranked, keys, "left").withColumn("refusal", refusal)
    fine = F.col("refusal").isNull()
    zero = F.lit(0).cast("long")
    figures = {
        "pauses": F.col("pauses"),
        "total_ns": F.coalesce("total_ns", zero),
        "max_ns": F.coalesce("worst.pause_ns", zero),
        **{n: F.coalesce(n, zero) for n in GC_QUANTILES},
        "max_label": F.coalesce("worst.text", F.lit("")),
        "mean_ns": F.coalesce(F.when(F.col("pauses") > 0, F.col("total_ns") / F.col("pauses")), F.lit(0.0)),
        "from_uptime_s": F.col("first.uptime_s"),
        "to_uptime_s": F.col("last.uptime_s"),
        **{c: F.col(c) for c in ["peak_committed_bytes", "peak_occupancy_bytes", "peak_live_bytes"]},
        "collector": F.col("collector"),
        "max_bytes": F.col("max_bytes"),
        "committed_share": F.when(F.col("max_bytes") > 0, F.col("peak_committed_bytes") / F.col("max_bytes")),
    }
    return refused.select(
        *keys,
        "decorated",
        "gc_lines",
        "foreign",
        *[F.when(fine, c).alias(name) for name, c in figures.items()],
        "refusal",
    )
