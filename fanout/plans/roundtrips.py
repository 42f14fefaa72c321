"""Writers and readers: rows from the tables go to files of each kind, and come back through their reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanout import schemas as S
from fanout.functions.text import string_fingerprint
from fanout.operators import archive, gates, logs
from fanout.operators.expectation import SUMS
from fanout.operators.transform import land
from fanout.plans import inputs
from fanout.plans.ingest import ORACLES as INGEST_SQL
from fanout.plans.logplans import ORACLES as LOG_SQL
from fanout.plans.oracle import EV, FEED, FEED_LANDED, INGEST, QUERY_LOG, RECORDS, SERIES, with_views
from fanout.session import kept, scratch_path
from fanout.sources import files, sinks
from fanout.sources.tables import table


ENVIRONMENTS_A_TASK = 250
ENVIRONMENTS_A_FOLDER = 10_000  # whose files' paths the driver holds at once


def _file_each(documents, key: str):
    """Documents dealt to as many tasks as they need, each of which is about to write one small file a row."""
    return documents.repartition(max(4, -(-documents.count() // ENVIRONMENTS_A_TASK)), key)


def _place(name: str):
    """A partition's value in a file's path."""
    return F.regexp_extract("path", f"/{name}=([^/]+)/", 1)


def archive_append(spark, sf):
    """Records appended to the archive and scanned back, by the folder that holds them."""
    folder = scratch_path(spark, "archive")
    sinks.append_archive(archive.month_path(inputs.records(spark, sf)), folder)
    kept = archive.kept_records(archive.parse_lines(files.archive_lines(spark, folder, "*.json")))
    own = archive.month_path(kept).withColumn("path", F.col("pos.path"))
    filed = [_place(n) for n in ("root", "env_id", "entrant", "month")]
    told = [F.col("root"), F.col("run.env_id"), F.col("sut.entrant"), F.col("month")]
    right = F.forall(F.array(*[a == b for a, b in zip(filed, told, strict=True)]), lambda x: x)
    return own.groupBy("root", F.col("run.env_id").alias("env_id"), F.col("sut.entrant").alias("entrant"), "month").agg(
        F.count("*").alias("records"), F.count_if(~right).alias("misfiled")
    )


def sampler_files(spark, sf):
    """The counter series as CSV files per arm and container, read back."""
    folder = scratch_path(spark, "sampler")
    series = inputs.series(spark, sf).select("arm", "container", *S.SAMPLE.fieldNames())
    series.repartition("arm", "container").write.partitionBy("arm", "container").option("header", "true").csv(folder)
    back = files.sampler_series(spark, folder, _place("arm"), _place("container"))
    return back.groupBy("arm", "container").agg(
        F.count("*").alias("samples"),
        *[F.sum(c).alias(c) for c in ("t_ms", "usage_usec", "mem_current", "anon", "sock")],
    )


def query_log_files(spark, sf):
    """The query log as tab-separated files, read back and its counters parsed."""
    folder = scratch_path(spark, "query-log")
    log = inputs.query_log(spark, sf).select("event_id", "type", "written_rows", "duration_ms")
    printed = log.join(inputs.profile_text(spark, sf), "event_id").select(*S.QUERY_LOG_TSV.fieldNames())
    printed.write.option("sep", "\t").option("quote", "").csv(folder)
    back = logs.parse_profile_events(files.query_log_tsv(spark, folder))
    return back.groupBy("type").agg(
        F.count("*").alias("queries"),
        F.sum("written_rows").alias("written_rows"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if("malformed").alias("malformed"),
        F.sum(F.try_element_at("counters", F.lit("UserTimeMicroseconds"))).alias("user_us"),
    )


def gc_log_files(spark, sf):
    """Collector logs as one text file a container, read back and summed by label."""
    folder = scratch_path(spark, "gc")
    text = inputs.gc_text(spark, sf).filter("line <> ''")
    placed = text.repartition("run", "container").sortWithinPartitions("run", "container", "line_no")
    placed.select("run", "container", "line").write.partitionBy("run", "container").text(folder)
    back = files.gc_log_lines(spark, folder, _place("run"), _place("container"), "*.txt")
    return logs.gc_by_label(logs.gc_pauses(logs.gc_lines(back)))


def ceiling_files(spark, sf):
    """Ceilings as one JSON document an environment, read back."""
    folder = scratch_path(spark, "ceilings")
    proof = F.struct(F.col("infra_digest")).alias("provenance")
    best = inputs.ingest_ceilings(spark, sf).groupBy("env").agg(
        F.collect_list(F.struct("format", "rows_per_s", "client", proof)).alias("ingest")
    )
    used = inputs.consume_ceilings(spark, sf).select("env", F.struct("msgs_per_s", "mb_per_s", "message_bytes", "client", proof).alias("consume"))
    _file_each(best.join(used, "env", "left"), "env").write.partitionBy("env").json(folder)
    _, ingest = files.ceilings(spark, folder, r"/env=([^/]+)/")
    return ingest.select("env", "format", "rows_per_s", "client", "infra_digest")


def ceiling_unknown_keys(spark, sf):
    """Keys in ceilings' files that nobody reads, by environment."""
    folder = scratch_path(spark, "ceilings")
    used = inputs.consume_ceilings(spark, sf)
    n = F.regexp_extract("env", r"(\d+)$", 1).cast("long")
    proof = F.struct("infra_digest", F.when(n % 7 == 2, F.lit("by hand")).alias("noted")).alias("provenance")
    rung = F.struct(F.lit(4).cast("long").alias("concurrency"), n.alias("rows_per_s"), F.when(n % 11 == 3, n).alias("rowz"))
    ingest = F.array(*[F.struct(F.lit(name).alias("format"), F.array(rung, rung).alias("sweep")) for name in ("a", "b")])
    files_of = used.select(
        "env",
        F.struct("msgs_per_s", "client", proof).alias("consume"),
        F.when(n % 5 == 1, n).alias("consume_msgs_per_s"),
        ingest.alias("ingest"),
    )
    files_of = kept(files_of)
    parts = max(1, -(-files_of.count() // ENVIRONMENTS_A_FOLDER))
    folders = [f"{folder}/part={part}" for part in range(parts)]
    for part, own in enumerate(folders):
        _file_each(files_of.filter(F.pmod(F.xxhash64("env"), F.lit(parts)) == part), "env").write.partitionBy("env").json(own)
    found = files.document_problems(files.documents_in(spark, folders), S.CEILINGS).withColumnRenamed("path", "key")
    return found.select(F.regexp_extract("file", "/env=([^/]+)/", 1).alias("env"), "key", "problem")


def dimension_load(spark, sf):
    """Environments as one JSON document each, read back typed."""
    folder = scratch_path(spark, "environments")
    n = F.col("n_nationkey").cast("long")
    host = F.struct(F.col("n_name").alias("cpu"), (n + 1).alias("cores"), F.lit("8 GiB").alias("memory"), F.when(n % 2 == 0, F.lit("linux")).alias("os"))
    made = table(spark, sf, "nation").select(
        F.concat(F.lit("env-"), n.cast("string")).alias("id"),
        F.when(n % 3 == 0, F.lit("authoritative")).otherwise(F.lit("indicative")).alias("class"),
        host.alias("host"),
        F.struct((n % 8 + 1).alias("partitions")).alias("infra"),
        F.concat(F.lit("env-"), n.cast("string")).alias("place"),
    )
    made.write.partitionBy("place").json(folder)
    return files.dimension(spark, folder, S.ENVIRONMENT).select(
        "id", "class", "host.cpu", "host.cores", "host.os", "infra.partitions"
    )


def ingest_stamps(spark, sf):
    """One insert clock a write: rows, stamped rows and distinct stamps of two appends."""
    folder = scratch_path(spark, "target")
    rows = land(inputs.feed(spark, sf))
    for _ in range(2):
        sinks.insert(rows, folder)
    return spark.read.parquet(folder).agg(
        F.count("*").alias("rows"), F.count("ingest_ts").alias("stamped"), F.countDistinct("ingest_ts").alias("stamps")
    )


def forward_unstamped(spark, sf):
    """Rows forwarded without an insert clock: the target's own columns and no more."""
    folder = scratch_path(spark, "target")
    sinks.insert(land(inputs.feed(spark, sf)), folder, stamped=False)
    return spark.read.parquet(folder).withColumn("tags", F.array_join("tags", "+"))


def truncate_target(spark, sf):
    """Rows and columns of the target before and after it is emptied."""
    folder = scratch_path(spark, "target")
    sinks.insert(land(inputs.feed(spark, sf)), folder)
    before = spark.read.parquet(folder)
    counted = before.agg(F.count("*").alias("rows"), F.lit(len(before.columns)).alias("columns")).first()
    sinks.truncate(spark, folder)
    after = spark.read.parquet(folder)
    return after.agg(F.count("*").alias("rows_after")).select(
        F.lit(counted["rows"]).cast("long").alias("rows_before"),
        "rows_after",
        F.lit(counted["columns"]).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
    )


def document_fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", string_fingerprint(F.col("text")).cast("string").alias("fingerprint"))


def feed_sums(spark, sf):
    """The ten sums over the landed feed, whose every value comes from the table."""
    found = gates.sums(land(inputs.feed(spark, sf)))
    return found.select(*[F.col(c).cast("string").alias(c) for c in SUMS])


QUERIES = {
    f.__name__: f
    for f in (
        archive_append,
        sampler_files,
        query_log_files,
        gc_log_files,
        ceiling_files,
        ceiling_unknown_keys,
        dimension_load,
        ingest_stamps,
        forward_unstamped,
        truncate_target,
        document_fingerprints,
        feed_sums,
    )
}


def _bytes_fp(text: str) -> str:
    """The string fingerprint from the hex digits of the text's bytes."""
    digits = f"hex(encode({text}))"
    head = " || ".join(f"substr(rpad(substr({digits}, 1, 16), 16, '0'), {i}, 2)" for i in range(15, 0, -2))
    return f"(('0x' || {head})::UBIGINT::HUGEINT + ('0x0' || right({digits}, 16))::UBIGINT::HUGEINT)"


_FED = f"""fed AS (SELECT DISTINCT batch_id, event_seq, sensor, region, name_upper, unit, value, value_scaled, quality IS NULL no_quality,
  array_to_string(tags, '') tag_text, len(tags) tag_count, epoch_ms(batch_ts) batch_ms FROM fl)"""

ORACLES = {
    "ceiling_unknown_keys": """SELECT 'env-' || s_suppkey env, key, 'unknown key' problem FROM supplier, (VALUES
      ('consume_msgs_per_s', 5, 1), ('consume.provenance.noted', 7, 2), ('ingest[].sweep[].rowz', 11, 3)) v(key, m, r) WHERE s_suppkey % m = r""",
    "dimension_load": """SELECT 'env-' || n_nationkey id, CASE WHEN n_nationkey % 3 = 0 THEN 'authoritative' ELSE 'indicative' END "class", n_name cpu,
      CAST(n_nationkey + 1 AS BIGINT) cores, CASE WHEN n_nationkey % 2 = 0 THEN 'linux' END os, CAST(n_nationkey % 8 + 1 AS BIGINT) partitions FROM nation""",
    "archive_append": with_views(EV, RECORDS)
    + """SELECT CASE WHEN trig = 'manual' THEN 'results' ELSE 'tuning' END root, env_id, entrant,
      strftime(make_timestamp(ts_ms*1000), '%Y-%m') AS month, count(*) records, 0::BIGINT misfiled FROM records WHERE schema_v = 2
      GROUP BY ALL""",
    "sampler_files": with_views(EV, SERIES)
    + """SELECT arm, container, count(*) samples, CAST(sum(t_ms) AS BIGINT) t_ms, CAST(sum(usage_usec) AS BIGINT) usage_usec,
      CAST(sum(mem_current) AS BIGINT) mem_current, CAST(sum(anon) AS BIGINT) anon, CAST(sum(k) AS BIGINT) sock
      FROM series JOIN (SELECT e line, k FROM ev) USING (line) GROUP BY ALL""",
    "query_log_files": with_views(EV, QUERY_LOG)
    + """SELECT kind AS type, count(*) queries, CAST(sum(written_rows) AS BIGINT) written_rows, CAST(sum(duration_ms) AS BIGINT) duration_ms,
      count(*) FILTER (k % 11 IN (1, 2, 3)) malformed, CAST(sum(k) FILTER (k % 11 > 4) AS BIGINT) user_us
      FROM qlog JOIN (SELECT e, k FROM ev) USING (e) GROUP BY ALL""",
    "gc_log_files": LOG_SQL["gc_by_label"],
    "ceiling_files": with_views(INGEST) + "SELECT env, format, rows_per_s, client, infra_digest FROM ingest_gate",
    "ingest_stamps": with_views(EV, FEED, FEED_LANDED)
    + 'SELECT 2 * count(*) "rows", 2 * count(*) stamped, 2::BIGINT stamps FROM fl',
    "forward_unstamped": INGEST_SQL["land_df"],
    "truncate_target": with_views(EV, FEED, FEED_LANDED)
    + "SELECT count(*) rows_before, 0::BIGINT rows_after, 13::INTEGER columns_before, 13::INTEGER columns_after FROM fl",
    "document_fingerprints": f"SELECT doc_id, CAST({_bytes_fp('text')} AS VARCHAR) fingerprint FROM documents",
    "feed_sums": with_views(EV, FEED, FEED_LANDED, _FED)
    + "SELECT "
    + ", ".join(
        f"CAST(sum({sql}) AS VARCHAR) {name}"
        for name, sql in {
            "value_sum": "value",
            "value_scaled_sum": "value_scaled",
            "sensor_sum": _bytes_fp("sensor"),
            "region_sum": _bytes_fp("region"),
            "name_sum": _bytes_fp("name_upper"),
            "unit_sum": _bytes_fp("unit"),
            "tag_count_sum": "tag_count",
            "tag_sum": _bytes_fp("tag_text"),
            "batch_ts_sum": "batch_ms",
            "null_quality_rows": "CASE WHEN no_quality THEN 1 ELSE 0 END",
        }.items()
    )
    + " FROM fed",
}
