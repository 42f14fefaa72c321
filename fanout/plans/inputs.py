"""Operator inputs derived from the given tables, one row or more per table row.

Each function has a view of the same name in ``oracle.py``, spelled independently in SQL. The
arithmetic is chosen so that every edge row the operators care about occurs.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.operators import corpus
from fanout.operators.resources import sampler_window
from fanout.operators.transform import land, land_flat
from fanout.session import staged, staged_folder
from fanout.sources.tables import spread, table, utc


def _written(make):
    """Derive once per application, as a written table."""

    @wraps(make)
    def read(spark: SparkSession, sf: str) -> DataFrame:
        return staged(spark, f"{make.__name__} of {sf}", lambda: make(spark, sf))

    return read


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        utc("ts").alias("ts"),
        F.unix_micros(utc("ts")).alias("us"),
        F.unix_millis(utc("ts")).alias("ms"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def _div(a, b):
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _s(c):
    return c.cast("string")


def _tag(prefix, c):
    return F.concat(F.lit(prefix), _s(c))


def document_ids(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("batch_id")))


def event_ids(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "events").select(F.col("event_id").alias("batch_id")))


@_written
def feed(spark, sf) -> DataFrame:
    """Nested batches with null regions, empty events, negative values, sentinels and odd names."""
    e = F.col("event_id")
    k, base = F.col("k"), F.round(F.col("value") * 100).cast("long")

    def event(i):
        at = (e + i).cast("long")
        return F.struct(
            i.cast("int").alias("seq"),
            F.when(at % 7 == 0, _tag("ı_ß_a", k)).otherwise(_tag("metric_", (k + i) % 32)).alias("name"),
            F.element_at(F.array(*[F.lit(u) for u in S.UNITS]), ((k + i) % 8 + 1).cast("int")).alias("unit"),
            ((base + i) * F.when(e % 3 == 0, -1).otherwise(1)).cast("long").alias("value"),
            F.when(at % 5 != 0, ((k + i * 13) % 100).cast("double") / 100.0).alias("quality"),
            F.slice(
                F.array(*[_tag("tag-", (at + j) % 16) for j in range(3)]), 1, (at % 4).cast("int")
            ).alias("tags"),
        )

    size = (e % 6).cast("int")
    events = F.slice(F.transform(F.sequence(F.lit(0), F.lit(4)), event), 1, size)
    return _events(spark, sf).select(
        e.alias("batch_id"),
        _tag("sensor-", F.col("user_id")).alias("sensor"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("region"),
        F.col("ms").alias("batch_ts_ms"),
        F.col("us").alias("send_ts_us"),
        events.alias("events"),
    )


@_written
def nested_corpus(spark, sf) -> DataFrame:
    return corpus.batches(document_ids(spark, sf))


def _landing(ids: DataFrame) -> DataFrame:
    """A hundred rows a batch, made where they are read: no table of them is stored."""
    return land_flat(corpus.flat_messages(ids))


def landed_corpus(spark, sf) -> DataFrame:
    """The corpus over every event id, landed, with every thirteenth batch replayed."""
    ids = event_ids(spark, sf)
    return _landing(ids).unionByName(_landing(ids.filter(F.col("batch_id") % 13 == 0)))


def broken_corpus(spark, sf) -> DataFrame:
    """The landed corpus with a lost interior batch, an uncoalesced region and seconds for millis."""
    rows = _landing(event_ids(spark, sf).filter(F.col("batch_id") != 7))
    return (
        rows.withColumn("region", F.when(F.col("region") == "", F.lit("none")).otherwise(F.col("region")))
        .withColumn("batch_ts", F.timestamp_millis(_div(F.unix_millis("batch_ts"), 1000)))
    )


def whole_landing(spark, sf) -> DataFrame:
    """What the corpus over every event id must have landed as, each row once."""
    return _landing(event_ids(spark, sf))


def altered_corpus(spark, sf) -> DataFrame:
    """That landing with batches lost, rows changed, rows landed three times, and batches nobody sent."""
    b, s = F.col("batch_id"), F.col("event_seq")
    ids = event_ids(spark, sf).filter(b % 97 != 7)
    changed = (b % 101 == 3) & (s == 5)
    there = _landing(ids).withColumn("value", F.when(changed, F.col("value") + 1).otherwise(F.col("value")))
    again = _landing(ids.filter(b % 13 == 0)).filter(s % 50 == 1)
    strange = _landing(ids.filter(b % 89 == 4)).withColumn("batch_id", b + 1_000_000_000)
    return there.unionByName(again).unionByName(again).unionByName(strange)


@_written
def tampered_corpus(spark, sf) -> DataFrame:
    """The nested corpus over every event id with a wrong sensor, a wrong value or a lost event at times."""
    b = F.col("batch_id")
    nested = corpus.batches(event_ids(spark, sf))
    poked = F.transform("events", lambda e: e.withField("value", F.when(e["seq"] == 3, -1).otherwise(e["value"])))
    events = F.when(b % 97 == 6, poked).when(b % 97 == 7, F.slice("events", 1, 99)).otherwise(F.col("events"))
    sensor = F.when(b % 97 == 5, F.lit("sensor-x")).otherwise(F.col("sensor"))
    return nested.withColumn("sensor", sensor).withColumn("events", events)


def conflicted(spark, sf) -> DataFrame:
    """The flattened feed landed twice, the second time with some values changed."""
    rows = land(feed(spark, sf))
    changed = rows.filter(F.col("batch_id") % 11 == 0).withColumn(
        "value", F.col("value") + F.when(F.col("batch_id") % 2 == 0, 1).otherwise(0)
    )
    return rows.unionByName(changed)


def latency_rows(spark, sf) -> DataFrame:
    delay = F.col("event_id") * 7919 % 250000
    return _events(spark, sf).select(
        _tag("run-", F.col("user_id") % 3).alias("run"),
        F.timestamp_micros("us").alias("send_ts"),
        F.timestamp_micros(F.col("us") + delay).alias("ingest_ts"),
    )


def series(spark, sf) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    unread = F.col("event_type") == "error"
    micro = F.round(F.col("value") * 1000000).cast("long")

    def counter(c):
        return F.when(unread, F.lit(-1)).otherwise(c).cast("long")

    return _events(spark, sf).select(
        _tag("arm-", F.col("user_id") % 4).alias("arm"),
        _tag("c", F.col("user_id") % 3).alias("container"),
        e.alias("line"),
        F.col("ms").alias("t_ms"),
        counter(e * 1000 + k).alias("usage_usec"),
        (e * 700).alias("user_usec"),
        (e * 300 + k).alias("system_usec"),
        (e * 7919 % 1000).alias("nr_throttled"),
        (e * 10).alias("throttled_usec"),
        micro.alias("mem_current"),
        (e * 100).alias("mem_peak"),
        counter(micro).alias("anon"),
        k.alias("file"),
        k.alias("slab"),
        k.alias("kernel_stack"),
        k.alias("sock"),
    )


def run_windows(spark, sf) -> DataFrame:
    """A window for every hundredth event, from a quarter second to twelve days long, and those of the samplers."""
    e = F.col("event_id")
    length = F.pow(F.lit(4), _div(e, 100) % 12).cast("long") * 250 + F.col("k") - 1
    own = _events(spark, sf).filter(e % 100 == 0).select(
        _tag("w-", e).alias("run"), F.col("ms").alias("from_ms"), (F.col("ms") + length).alias("to_ms")
    )
    arms = sampler_window(series(spark, sf)).filter("from_ms is not null")
    return own.unionByName(arms.withColumnRenamed("arm", "run"))


def declared_containers(spark, sf) -> DataFrame:
    """Five arms of three containers; the series knows only four of the arms."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        _tag("arm-", c % 5).alias("arm"),
        _tag("c", c % 3).alias("container"),
        F.when(c % 3 == 0, F.lit("data-plane")).otherwise(F.lit("coordinator")).alias("role"),
    ).distinct()


def polls(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf).select(
        _tag("run-", F.col("user_id") % 16).alias("run"),
        (_div(F.col("us"), 3600000000) - _div(F.lit(1704067200000000), 3600000000)).alias("tick"),
        F.when(F.col("event_type") == "purchase", _div(e, 40)).alias("rows"),
        (F.col("user_id") % 16 * 10).alias("expected_rows"),
    )


def sends(spark, sf) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    due = _div(e * 1000000, 37)
    return _events(spark, sf).select(
        _tag("run-", u % 4).alias("run"),
        due.alias("due_us"),
        (due + e * 7919 % 5000).alias("actual_us"),
        ((F.col("event_type") == "error") & (u % 4 == 1)).alias("failed"),
        F.when(u % 4 == 2, 37).otherwise(5).cast("long").alias("rate"),
    )


def sink_rows(spark, sf) -> DataFrame:
    """Rows on their way to a sink: half of them for one shard, of very unequal size, in bursts."""
    e, k = F.col("event_id"), F.col("k")
    return _events(spark, sf).select(
        F.when(e % 2 == 0, F.lit("shard-hot")).otherwise(_tag("shard-", F.col("user_id") % 5)).alias("shard"),
        (F.col("ms") + F.when(e % 50 < 40, -(F.col("ms") % 3_600_000)).otherwise(0)).alias("at_ms"),
        "event_id",
        (F.when(k % 17 == 0, k * 40).otherwise(k) + 1).alias("bytes"),
    )


def offsets(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf).select(
        _tag("topic-", F.col("user_id") % 2).alias("topic"),
        (e % 8).cast("int").alias("partition"),
        _div(e, 8).alias("offset"),
    )


def runs(spark, sf) -> DataFrame:
    """One run per user: rows, window and CPU of everything that user did."""
    per_user = _events(spark, sf).groupBy("user_id").agg(
        (F.count("*") * 1000).alias("rows"),
        (F.max("ms") - F.min("ms")).alias("window_ms"),
        (F.sum("k") * 1000).alias("cpu_us"),
        F.max(F.round(F.col("value") * 1000000).cast("long")).alias("peak_anon_bytes"),
        F.count_if(F.col("event_type") == "error").alias("duplicate_rows"),
        F.max("event_id").alias("last_id"),
    )
    u = F.col("user_id")
    return per_user.select(
        _tag("run-", u).alias("run"),
        "rows",
        "window_ms",
        "cpu_us",
        "peak_anon_bytes",
        F.when(u % 3 != 0, F.col("peak_anon_bytes") + 1).alias("peak_charged_bytes"),
        "duplicate_rows",
        F.when(u % 2 == 0, F.lit("sustained")).otherwise(F.lit("drain")).alias("mode"),
        F.when(u % 7 == 0, F.lit("failed")).when(u % 5 == 0, F.lit("infra_bound")).otherwise(F.lit("ok")).alias("status"),
        (u % 5).alias("offered_msgs_per_s"),
        F.lit(735).cast("long").alias("expected_rows"),
        F.lit(10000000).cast("long").alias("batches"),
        (u * 31 % 1000).alias("max_schedule_lag_us"),
        (u * 3).alias("p50_us"),
        (u * 5).alias("p99_us"),
        (u * 7).alias("p999_us"),
        (u * 11).alias("max_us"),
    )


@_written
def query_log(spark, sf) -> DataFrame:
    e, u, k, t = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("event_type")
    entries = F.array_compact(
        F.array(
            F.struct(F.lit("UserTimeMicroseconds").alias("key"), (k * 100).alias("value")),
            F.when(k % 7 != 0, F.struct(F.lit("SystemTimeMicroseconds").alias("key"), (k * 10).alias("value"))),
            F.when(k % 3 == 0, F.struct(F.lit("InsertedBytes").alias("key"), (k * 1000).alias("value"))),
            F.when(u % 12 == 5, F.struct(F.lit("AsyncInsertQuery").alias("key"), F.lit(1).cast("long").alias("value"))),
            F.struct(F.lit("NetworkReceiveElapsedMicroseconds").alias("key"), (k * 11).alias("value")),
        )
    )
    # every twelfth run's server reports no CPU time at all
    entries = F.filter(entries, lambda x: ~((u % 12 == 7) & x["key"].endswith("TimeMicroseconds")))
    return _events(spark, sf).select(
        _tag("run-", u % 12).alias("run"),
        F.to_date("ts").alias("event_date"),
        F.col("ts").alias("query_start_time"),
        F.col("ts").alias("event_time"),
        F.when(t == "signup", F.lit("QueryStart"))
        .when(t == "error", F.lit("ExceptionWhileProcessing"))
        .otherwise(F.lit("QueryFinish"))
        .alias("type"),
        F.when(k % 10 == 9, F.lit("Select")).otherwise(F.lit("Insert")).alias("query_kind"),
        (u % 5 != 0).alias("is_initial_query"),
        F.when(u % 2 == 0, F.array(F.lit("db.sensor_events")))
        .otherwise(F.array(F.lit("db.other"), F.lit("db.landing")))
        .alias("tables"),
        (e % 1000 + 1).alias("written_rows"),
        (k * 7 + 1).alias("duration_ms"),
        F.map_from_entries(entries).alias("profile_events"),
        e.alias("event_id"),
    )


def dated_query_log(spark, sf) -> str:
    """Folder of the query log written by date, once per application."""
    return staged_folder(spark, f"dated query log of {sf}", lambda: query_log(spark, sf), "event_date")


def profile_text(spark, sf) -> DataFrame:
    """Counter maps as the text a log prints, some of them spoiled."""
    k = F.col("k")
    text = (
        F.when(k % 11 == 0, F.lit("{}"))
        .when(k % 11 == 1, F.concat(F.lit("{'UserTimeMicroseconds':"), _s(k), F.lit("x}")))
        .when(k % 11 == 2, F.concat(F.lit("'UserTimeMicroseconds':"), _s(k)))
        .when(k % 11 == 3, F.concat(F.lit("{UserTimeMicroseconds:"), _s(k), F.lit("}")))
        .when(k % 11 == 4, F.concat(F.lit("{'Unknown':"), _s(k), F.lit(", 'InsertedRows':"), _s(k * 2), F.lit("}")))
        .otherwise(
            F.concat(F.lit(" {'UserTimeMicroseconds':"), _s(k), F.lit(",'SystemTimeMicroseconds':"), _s(k * 3), F.lit("} "))
        )
    )
    return _events(spark, sf).select("event_id", text.alias("profile_events"))


def part_log(spark, sf) -> DataFrame:
    flag = F.col("l_returnflag")
    return _lineitem(spark, sf).select(
        _tag("t", F.col("l_suppkey") % 3).alias("table"),
        utc("l_shipdate").alias("event_time"),
        F.when(flag == "A", F.lit("NewPart"))
        .when(flag == "N", F.lit("MergeParts"))
        .otherwise(F.lit("RemovePart"))
        .alias("event_type"),
        F.col("l_quantity").cast("long").alias("rows"),
    )


def part_windows(spark, sf) -> DataFrame:
    """Windows of days over the time that parts were shipped in, one for each of some orders."""
    day = F.unix_millis(utc("l_shipdate"))
    chosen = (F.col("l_orderkey") % 400 == 0) & (F.col("l_linenumber") == 1)
    return _lineitem(spark, sf).filter(chosen).select(
        _tag("p-", F.col("l_orderkey")).alias("run"),
        (day - 1).alias("from_ms"),
        (day + F.col("l_quantity").cast("long") * 86_400_000).alias("to_ms"),
    )


def settle_rungs(spark, sf) -> DataFrame:
    return _lineitem(spark, sf).select(
        _tag("fmt-", F.col("l_suppkey") % 7).alias("format"),
        F.col("l_linenumber").cast("long").alias("concurrency"),
        (F.col("l_partkey") % 500).alias("wait_us"),
    )


@_written
def gc_text(spark, sf) -> DataFrame:
    """Collector log lines of many containers, formatted from table values."""
    e, k, t = F.col("event_id"), F.col("k"), F.col("event_type")
    uptime = F.concat(F.lit("["), F.format_string("%.3f", e / 1000.0), F.lit("s][info][gc"))
    ms = F.concat(F.format_string("%.3f", "value"), F.lit("ms"))

    def line(tag, *rest):
        return F.concat(uptime, F.lit(tag), *rest)

    init = (
        F.when(F.col("user_id") % 5 == 4, F.lit(""))
        .when(k % 5 == 0, line("     ] Using G1"))
        .when(k % 5 == 1, line(",init] Heap Max Capacity: ", _s(k + 100), F.lit("M")))
        .when(k % 5 == 2, line(",init] Version: 25.0.", _s(k)))
        .when(k % 5 == 3, line(",init] Heap Initial Capacity: ", _s(k), F.lit("M")))
        .otherwise(line(",init] Heap Min Capacity: 8M"))
    )
    noise = (
        F.when(k % 3 == 0, _tag("Exception in thread main ", e))
        .when(k % 3 == 1, line(",start    ] GC(", _s(e), F.lit(") Pause Young (Normal) (G1 Evacuation Pause)")))
        .otherwise(F.concat(F.lit("[1.0s][info][safepoint] Entering "), _s(e)))
    )
    zgc = line(",phases   ] GC(", _s(e), F.lit(") Y: Pause Mark Start (Major) "), ms)
    no_duration = line("          ] GC(", _s(e), F.lit(") Pause Remark"))
    g1 = line(
        "          ] GC(",
        _s(e),
        F.lit(") Pause "),
        F.when(k % 2 == 0, F.lit("Young (Normal) (G1 Evacuation Pause)")).otherwise(F.lit("Full (System.gc())")),
        F.lit(" "),
        _s(k + 40),
        F.lit("M->"),
        _s(k),
        F.lit("K("),
        _s(k + 60),
        F.lit("M) "),
        ms,
    )
    pause = F.when(k % 4 == 3, zgc).when((F.col("user_id") % 5 == 3) & (k == 77), no_duration).otherwise(g1)
    return _events(spark, sf).select(
        _tag("run-", F.col("user_id") % 4).alias("run"),
        _tag("jvm-", F.col("user_id") % 5).alias("container"),
        e.alias("line_no"),
        F.when(t == "signup", init).when(t == "error", noise).otherwise(pause).alias("line"),
    )


@_written
def records(spark, sf) -> DataFrame:
    """One archive record per event, with failures, ties, duplicates and every kind of defect."""
    e, u, k, t = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("event_type")
    status = (
        F.when(t == "signup", F.lit("failed"))
        .when((t == "error") & (k % 2 == 0), F.lit("infra_bound"))
        .when((t == "error") & (k % 9 == 1), F.lit("mystery"))
        .otherwise(F.lit("ok"))
    )
    carries = status.isin("ok", "infra_bound")

    def metric(value, unit, up):
        return F.struct(
            value.cast("double").alias("value"),
            F.lit(unit).alias("unit") if isinstance(unit, str) else unit.alias("unit"),
            F.lit(up).alias("higher_is_better"),
            F.lit(None).cast("array<double>").alias("ci95"),
            F.lit(None).cast("bigint").alias("n"),
        )

    def entry(name, value):
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    filled = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("rows_per_s", metric(F.round(F.col("value") * 100), "records/s", True)),
                F.when(
                    k % 2 == 0,
                    entry(
                        "cpu_us_per_row",
                        metric(
                            F.when(k % 10 != 4, k),
                            F.when(e % 29 == 0, F.lit("furlongs")).otherwise(F.lit("us")),
                            False,
                        ),
                    ),
                ),
                entry("duplicate_rows", metric(F.lit(0), "rows", False)),
            )
        )
    )
    none = F.map_from_entries(F.filter(F.array(entry("x", metric(F.lit(0), "us", False))), lambda _: F.lit(False)))
    variant = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("wire_format", F.when(u % 2 == 0, F.lit("rowbinary")).otherwise(F.lit("native"))),
                F.when(u % 9 != 8, entry("mode", F.when(u % 2 == 0, F.lit("drain")).otherwise(F.lit("sustained")))),
                F.when(u % 8 != 7, entry("approach", F.when(u % 4 == 1, F.lit("stripped")).otherwise(F.lit("realistic")))),
                F.when(k % 6 != 5, entry("knob_a", _s(u % 3))),
                entry("knob_b", F.when(u % 13 == 0, F.lit("auto")).otherwise(_s(u % 2))),
            )
        )
    )
    hour = _div(F.col("ms"), 3600000) * 3600000
    invocation = (
        F.when(u % 5 == 0, F.lit(""))
        .when(u % 5 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("inv-"), F.date_format("ts", "yyyyMMdd")))
    )
    return _events(spark, sf).select(
        F.when(e % 97 == 0, 3).otherwise(2).cast("int").alias("schema"),
        F.lit("bench").alias("bench"),
        F.lit("measurement").alias("kind"),
        status.alias("status"),
        _tag("r-", F.when(e % 50 == 49, e - 1).otherwise(e)).alias("run_id"),
        (k % 5).cast("int").alias("rep"),
        F.lit(3).alias("reps"),
        F.struct(
            _tag("sys-", u % 25).alias("entrant"),
            _tag("v", u % 6).alias("variant_id"),
            F.when(u % 7 != 0, _tag("1.", u % 2)).alias("version"),
            F.when(u % 14 != 0, _tag("c", u % 3)).alias("commit"),
            F.when(k == 50, F.lit("")).when(k == 51, F.lit("md5:1")).otherwise(_tag("sha256:", e)).alias("image_digest"),
            F.lit("image").alias("image"),
            F.lit("toolchain").alias("toolchain"),
        ).alias("sut"),
        F.struct(
            hour.alias("ts_ms"),
            invocation.alias("invocation_id"),
            _tag("env-", u % 2).alias("env_id"),
            F.when(k == 52, F.lit(" ")).otherwise(F.lit("d")).alias("env_digest"),
            F.when(u % 3 == 0, 2).otherwise(1).cast("int").alias("harness_version"),
            _tag("d", F.when(u % 25 == 4, F.lit(1)).otherwise(F.lit(2))).alias("dataset_version"),
            F.lit("abc").alias("commit"),
            F.when(k == 60, F.lit("pr")).when(k == 61, F.lit("tuning")).otherwise(F.lit("manual")).alias("trigger"),
            F.struct(
                _tag("i", u % 2).alias("digest"),
                F.lit(8).alias("partitions"),
                F.lit(None).cast("bigint").alias("ceiling_msgs_per_s"),
                F.lit(None).cast("bigint").alias("ceiling_bytes_per_s"),
                F.lit(None).cast("bigint").alias("ceiling_rows_per_s"),
            ).alias("infra"),
        ).alias("run"),
        variant.alias("variant"),
        F.when(carries & (k != 70), filled).when(~carries & (k == 71), filled).otherwise(none).alias("metrics"),
        _tag("note ", e).alias("note"),
        F.when(k % 4 == 0, F.array(F.lit("cpu_cap_throttled")))
        .when(k == 81, F.array(F.lit("unpublishable_environment"), F.lit("headroom_unproven")))
        .otherwise(F.array().cast("array<string>"))
        .alias("flags"),
        e.alias("pos"),
    )


def variants(spark, sf) -> DataFrame:
    """Declared variants; records also name a sixth variant nobody declares."""
    c = table(spark, sf, "customer").withColumn("entrant", _tag("sys-", F.col("c_nationkey")))
    first = c.groupBy("entrant").agg(F.min("c_custkey").cast("int").alias("display_order"))
    index = (F.col("c_custkey") % 5).cast("int")
    declared = c.select("entrant", _tag("v", index).alias("variant_id"), index.alias("variant_index")).distinct()
    return declared.join(first, "entrant")


def entrants(spark, sf) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        _tag("rt-", n % 3).alias("runtime"),
        F.lit("engine").alias("kind"),
        F.when(n % 4 != 3, _tag("lic-", n % 4)).otherwise(F.lit("")).alias("licence"),
        F.when(n % 2 == 0, F.lit("at-least-once")).alias("delivery"),
    )


def constraints(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        _tag("sys-", n).alias("entrant"),
        F.lit("knob_a").alias("knob"),
        F.when(n % 3 != 1, F.lit("knob_b")).alias("exceeds"),
        F.when(n % 3 != 0, F.lit(1).cast("long")).alias("at_least"),
    )


def archive_text(spark, sf) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    good = F.concat(
        F.lit('{"schema":'),
        F.when(k % 10 == 0, F.lit("1")).otherwise(F.lit("2")),
        F.lit(',"run_id":"r-'),
        _s(e),
        F.lit('","status":"ok","variant":{"batches":'),
        _s(k),
        F.lit(',"mode":"drain"},"metrics":{"rows_per_s":{"value":'),
        _s(k),
        F.lit(',"unit":"records/s","higher_is_better":true}}}'),
    )
    line = (
        F.when(k % 23 == 0, F.lit('{"schema":2,'))
        .when(k % 23 == 1, F.lit("   "))
        .when(k % 23 == 2, F.lit("[2]"))
        .otherwise(good)
    )
    return _events(spark, sf).select(
        _tag("file-", F.col("user_id") % 9).alias("path"), e.alias("line_no"), line.alias("line")
    )


def cap_readings(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    meta = F.concat(
        F.lit("# "),
        F.when(c % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("cpu.max="), F.when(c % 7 == 1, F.lit("max")).otherwise(_s((c % 4 + 1) * 100000)), F.lit("/100000"))),
        F.when(c % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" memory.max="), _s((c % 3 + 1) * 1073741824))),
    )
    return table(spark, sf, "customer").select(_tag("c-", c).alias("container"), meta.alias("meta"))


def cap_declared(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        _tag("c-", c).alias("container"),
        _s(c % 4 + F.when(c % 11 == 0, 2).otherwise(1)).alias("cpus"),
        F.when(c % 13 == 0, F.lit("lots"))
        .when(c % 2 == 0, F.concat(_s(c % 3 + 1), F.lit("g")))
        .otherwise(F.concat(_s((c % 3 + 1) * 1024), F.lit("M")))
        .alias("memory"),
    )


def _digest(n):
    from fanout.operators.ceilings import infra_digest

    return infra_digest(F.lit("broker"), _s(n % 3 + 1), F.lit("8g"), F.lit("16"), F.lit("16g"), F.lit("8"))


def consume_ceilings(spark, sf) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    return table(spark, sf, "supplier").select(
        _tag("env-", s).alias("env"),
        F.when(s % 10 != 9, F.round(F.col("s_acctbal") * 100).cast("long")).alias("msgs_per_s"),
        (F.round(F.col("s_acctbal") * 100).cast("long") / 1000.0).alias("mb_per_s"),
        (F.lit(3700) + n * 30).alias("message_bytes"),
        F.when(s % 4 == 3, F.lit("outside")).otherwise(F.lit("inside")).alias("client"),
        F.when(s % 9 == 0, F.lit("")).otherwise(_digest(s)).alias("infra_digest"),
        _digest(F.when(s % 8 == 7, s + 1).otherwise(s)).alias("env_digest"),
        F.lit(4056).cast("long").alias("corpus_message_bytes"),
    )


def ingest_ceilings(spark, sf) -> DataFrame:
    """One ceiling per environment and format."""
    p = F.col("p_partkey")
    best = (
        table(spark, sf, "part")
        .groupBy((p % 8).alias("n"), _tag("fmt-", F.col("p_size") % 5).alias("format"))
        .agg(F.max(F.round(F.col("p_retailprice") * 1000).cast("long")).alias("rows_per_s"))
    )
    n = F.col("n")
    mixed = (n + F.col("rows_per_s")) % 6
    return best.select(
        _tag("env-", n).alias("env"),
        "format",
        "rows_per_s",
        F.when(mixed == 1, F.lit("outside")).otherwise(F.lit("inside")).alias("client"),
        F.when(mixed == 2, F.lit("")).otherwise(_digest(n)).alias("infra_digest"),
        _digest(F.when(mixed == 3, n + 1).otherwise(n)).alias("env_digest"),
    )


def achieved(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return table(spark, sf, "customer").select(
        _tag("arm-", c).alias("arm"),
        _tag("env-", c % 12).alias("env"),
        _tag("fmt-", F.col("c_nationkey") % 6).alias("wire_format"),
        (cents / 2.0).alias("msgs_per_s"),
        (cents * 2.0).alias("rows_per_s"),
        (c % 9 == 0).alias("server_side_transform"),
    )


def ladders(spark, sf) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey") % 7
    steps = F.least(n, s + 1) * 100000 + F.when(n > s + 1, F.col("l_partkey") % 1000).otherwise(0)
    return _lineitem(spark, sf).select(
        _tag("fmt-", s).alias("format"),
        F.pow(F.lit(2.0), n - 1).cast("long").alias("concurrency"),
        steps.cast("long").alias("rows_per_s"),
    )


def bursts(spark, sf) -> DataFrame:
    return _lineitem(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").cast("long").alias("rows"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
        (F.col("l_partkey") * 1000 + 500000).alias("elapsed_us"),
    )


def frames(spark, sf) -> DataFrame:
    """Whole document texts as datums, framed; every seventeenth frame is spoiled."""
    from fanout.functions.wire import build_frame

    d = F.col("doc_id")
    framed = build_frame(d % 3, F.col("text").cast("binary"))
    spoiled = (
        F.when(d % 51 == 0, F.concat(F.lit(b"\x01"), F.substring(framed, F.lit(2), F.octet_length(framed))))
        .when(d % 51 == 17, F.substring(framed, 1, 5))
        .when(d % 51 == 34, build_frame(d % 3 + 1, F.col("text").cast("binary")))
        .otherwise(framed)
    )
    return table(spark, sf, "documents").select("doc_id", "text", spoiled.alias("value"))
