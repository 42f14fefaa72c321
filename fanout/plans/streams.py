"""Queries that write somewhere first: sinks and streaming jobs, read back.

Every run uses fresh folders under the session's shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanout.functions.wire import frame_datum, frame_problem
from fanout.operators.sealing import Budget, sealed_batches
from fanout.operators.transform import land
from fanout.plans import inputs
from fanout.plans.ingest import ORACLES as INGEST
from fanout.plans.measurement import ORACLES as MEASUREMENT
from fanout.plans.oracle import EV, FEED, FEED_LANDED, SINK_ROWS, with_views
from fanout.schemas import BATCH, COLUMNS
from fanout.session import scratch_path
from fanout.sources import sinks
from fanout.sources.messages import envelopes
from fanout.sources.tokens import TokenTable
from fanout.sources.topic import consume
from fanout.streaming import jobs, live

FILES_PER_TRIGGER = 2
BATCHES_PER_FILE = 100_000


def _staged(spark: SparkSession, batches: DataFrame) -> DataFrame:
    """A folder of nested batches, as a stream. A trigger takes a file for every core, and there are two triggers or more."""
    folder, cores = scratch_path(spark, "nested"), spark.sparkContext.defaultParallelism
    per_file = min(BATCHES_PER_FILE, max(1, batches.count() // (2 * cores)))
    batches.write.option("maxRecordsPerFile", per_file).parquet(folder)
    return jobs.nested_stream(spark, folder, max(FILES_PER_TRIGGER, cores))


def _target(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(*COLUMNS).withColumn("tags", F.array_join("tags", "+"))


def sensor_events_insert(spark, sf):
    folder = scratch_path(spark, "target")
    sinks.insert(land(inputs.feed(spark, sf)), folder)
    return _target(spark, folder)


def drain_run(spark, sf):
    """The prefilled corpus drained into the target, one folder per micro-batch."""
    target = scratch_path(spark, "target")
    stream = _staged(spark, inputs.nested_corpus(spark, sf))
    jobs.drain(jobs.start_ingest(stream, jobs.epoch_sink(target), scratch_path(spark, "offsets")))
    return _target(spark, target)


def stream_land(spark, sf):
    """The feed landed by an appending stream."""
    target = scratch_path(spark, "target")
    stream = _staged(spark, inputs.feed(spark, sf))
    jobs.drain(jobs.start_ingest(stream, jobs.append_sink(target), scratch_path(spark, "offsets")))
    return _target(spark, target)


def landing_view_flatten(spark, sf):
    """The feed flattened through a view over each nested micro-batch."""
    target = scratch_path(spark, "target")
    stream = _staged(spark, inputs.feed(spark, sf))
    jobs.drain(jobs.start_landing_view(stream, target, scratch_path(spark, "offsets")))
    return _target(spark, target)


def idempotent_sink(spark, sf):
    """Two drains into one target, every micro-batch written twice, as a replay after a lost commit would.

    Each drain's epochs count from 0; every row lands once.
    """
    target = scratch_path(spark, "target")
    once = jobs.epoch_sink(target)

    def twice(rows, epoch):
        once(rows, epoch)
        once(rows, epoch)

    feed = inputs.feed(spark, sf)
    for half in ("batch_id % 2 = 0", "batch_id % 2 = 1"):
        stream = _staged(spark, feed.filter(half))
        jobs.drain(jobs.start_ingest(stream, twice, scratch_path(spark, "offsets")))
    return _target(spark, target)


def row_ledger(spark, sf):
    """Total of the rows recorded per micro-batch while they were written."""
    ledger = scratch_path(spark, "ledger")
    sink = jobs.ledger_sink(jobs.epoch_sink(scratch_path(spark, "target")), ledger, "run")
    stream = _staged(spark, inputs.feed(spark, sf))
    jobs.drain(jobs.start_ingest(stream, sink, scratch_path(spark, "offsets")))
    return spark.read.parquet(ledger).groupBy("run").agg(F.sum("rows").alias("rows"))


def prefill_corpus(spark, sf):
    """Messages per partition of a topic folder that was filled once and then found complete."""
    folder = scratch_path(spark, "topic")
    batches = inputs.nested_corpus(spark, sf)
    expected = inputs.document_ids(spark, sf).count()

    def make():
        datum = F.to_json(F.struct("batch_id", "events")).cast("binary")
        return envelopes(batches, datum, schema_id=7, topic_name="corpus", partitions=8)

    done = [sinks.prefill(spark, make, folder, expected=expected) for _ in range(2)]
    return (
        spark.read.parquet(folder)
        .groupBy(F.col("partition").cast("int").alias("partition"))
        .agg(F.count("*").alias("messages"), F.max("offset").alias("high"))
        .withColumn("outcome", F.lit("+".join(done)))
    )


def _topic(spark, sf) -> tuple[str, int]:
    """A filled topic folder whose messages hold whole batches, and how many it holds."""
    folder = scratch_path(spark, "topic")
    batches = inputs.nested_corpus(spark, sf)
    datum = F.to_json(F.struct(*batches.columns), {"ignoreNullFields": "false"}).cast("binary")
    expected = inputs.document_ids(spark, sf).count()
    made = envelopes(batches, datum, schema_id=7, topic_name="corpus", partitions=8)
    sinks.prefill(spark, lambda: made, folder, expected=expected)
    return folder, expected


def _consumed(spark, sf, shape, sink) -> int:
    """Consume the topic in triggers of a quarter of it, the query stopped and started again after each."""
    folder, expected = _topic(spark, sf)
    group, offsets = scratch_path(spark, "group"), scratch_path(spark, "offsets")

    def start():
        messages = consume(spark, folder, group, per_trigger=-(-expected // 4))
        return jobs.start_sink(shape(messages), sink, offsets)

    return jobs.drain_by_restarts(start)


def topic_consume(spark, sf):
    """Messages per partition of a topic consumed by offsets across restarts: each lands once."""
    out = scratch_path(spark, "messages")
    _consumed(spark, sf, lambda messages: messages, jobs.folder_sink(out))
    return spark.read.parquet(out).groupBy("partition").agg(
        F.count("*").alias("messages"), F.count_distinct("offset").alias("offsets"), F.max("offset").alias("high")
    )


def topic_land(spark, sf):
    """The corpus consumed from its topic, decoded and landed, once across restarts."""
    target = scratch_path(spark, "target")

    def decoded(messages):
        value = F.col("value")
        checked = F.when(frame_problem(value, F.lit(7)).isNull(), frame_datum(value).cast("string"))
        return land(messages.select(F.from_json(checked, BATCH).alias("b")).select("b.*"))

    _consumed(spark, sf, decoded, jobs.epoch_sink(target))
    return _target(spark, target)


def token_window(spark, sf):
    """Eight inserts, then three replayed: those inside a window of four tokens land once, the one beyond it again."""
    rows = land(inputs.feed(spark, sf))
    table = TokenTable(spark, scratch_path(spark, "tokens"), window=4)
    landed = []
    for part in [*range(8), 7, 4, 0]:
        mine = sinks.target_rows(rows.filter(F.col("batch_id") % 8 == part), stamped=False)
        landed.append(table.insert(mine, f"part-{part}"))
    kept = table.read().groupBy((F.col("batch_id") % 8).alias("part")).agg(F.count("*").alias("rows"))
    return kept.withColumn("inserts", F.lit(sum(landed)))


SEAL = Budget(max_rows=24, max_bytes=3000, linger_ms=7_200_000)


def sealed(spark, sf):
    """Batches of each shard, sealed by rows, bytes or time."""
    rows = inputs.sink_rows(spark, sf)
    return sealed_batches(rows, F.col("shard"), F.col("at_ms"), F.col("bytes"), [F.col("event_id")], SEAL)


PARTS = 6


def _told_live(spark, sf, rule):
    """Polls in the order of their ticks, a file a part of the time; the query is stopped and started again midway."""
    folder, out, offsets = (scratch_path(spark, n) for n in ("polls", "told", "offsets"))
    polls = inputs.polls(spark, sf)
    ends = polls.agg(F.min("tick").alias("a"), F.max("tick").alias("z")).first()
    part = F.call_function("div", (F.col("tick") - ends.a) * PARTS, F.lit(ends.z - ends.a + 1))
    stream = None
    for k in range(PARTS):
        polls.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
        if k in (PARTS // 2 - 1, PARTS - 1):
            stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            jobs.drain(jobs.start_sink(live.told_live(stream, rule), jobs.folder_sink(out), offsets, mode="update"))
    return live.newest(spark, out).drop("late_polls", "decided")


def live_quiesce(spark, sf):
    return _told_live(spark, sf, live.Quiesce())


def live_warmup(spark, sf):
    return _told_live(spark, sf, live.WarmUp())


def live_drain(spark, sf):
    return _told_live(spark, sf, live.Drained())


QUERIES = {
    "sealed_batches": sealed,
    "live_quiesce": live_quiesce,
    "live_warmup": live_warmup,
    "live_drain": live_drain,
    "sensor_events_insert": sensor_events_insert,
    "drain_run": drain_run,
    "stream_land": stream_land,
    "landing_view_flatten": landing_view_flatten,
    "idempotent_sink": idempotent_sink,
    "row_ledger": row_ledger,
    "prefill_corpus": prefill_corpus,
    "topic_consume": topic_consume,
    "topic_land": topic_land,
    "token_window": token_window,
}

_SEALED = f"""ranked AS (SELECT *, row_number() OVER w - 1 i, sum(bytes) OVER w - bytes before, count(*) OVER (PARTITION BY shard) n
      FROM sink_rows WINDOW w AS (PARTITION BY shard ORDER BY at_ms, e ROWS UNBOUNDED PRECEDING)),
    reach AS (SELECT a.shard, a.i, any_value(a.n) n, min(b.i) FILTER (b.before + b.bytes - a.before >= {SEAL.max_bytes}) + 1 by_bytes,
      min(b.i) FILTER (b.at_ms - a.at_ms >= {SEAL.linger_ms}) by_time FROM ranked a JOIN ranked b ON a.shard = b.shard AND b.i BETWEEN a.i AND a.i + {SEAL.max_rows}
      GROUP BY a.shard, a.i),
    jump AS (SELECT shard, i, least(i + {SEAL.max_rows}, n, coalesce(by_bytes, n), coalesce(by_time, n)) z, CASE WHEN i + {SEAL.max_rows} <= least(n, coalesce(by_bytes, n), coalesce(by_time, n)) THEN 'rows'
      WHEN by_bytes <= least(n, coalesce(by_time, n)) THEN 'bytes' WHEN by_time < n THEN 'time' ELSE 'end' END sealed_by FROM reach),
    path AS (SELECT shard, 0::BIGINT batch, 0::BIGINT i FROM ranked WHERE i = 0
      UNION ALL SELECT p.shard, batch + 1, z FROM path p JOIN jump j ON j.shard = p.shard AND j.i = p.i JOIN ranked r ON r.shard = p.shard AND r.i = z)"""

ORACLES = {
    "sealed_batches": with_views(EV, SINK_ROWS, _SEALED)
    + """SELECT p.shard "key", batch, p.i first_row, count(*) "rows", CAST(sum(bytes) AS BIGINT) bytes, min(at_ms) from_ms, max(at_ms) to_ms, any_value(sealed_by) sealed_by
    FROM path p JOIN jump j ON j.shard = p.shard AND j.i = p.i JOIN ranked r ON r.shard = p.shard AND r.i >= p.i AND r.i < z GROUP BY 1, 2, 3""",
    "live_quiesce": MEASUREMENT["quiesce_point"],
    "live_warmup": MEASUREMENT["warmup_point"],
    "live_drain": MEASUREMENT["drain_complete"],
    "sensor_events_insert": INGEST["land_df"],
    "drain_run": INGEST["land_corpus"],
    "stream_land": INGEST["land_df"],
    "landing_view_flatten": INGEST["land_df"],
    "idempotent_sink": INGEST["land_df"],
    "row_ledger": with_views(EV, FEED, FEED_LANDED) + "SELECT 'run' run, count(*) \"rows\" FROM fl",
    "prefill_corpus": """SELECT CAST(doc_id % 8 AS INTEGER) AS partition, count(*) messages, max(doc_id // 8) high, 'written+reused' outcome
      FROM documents GROUP BY 1""",
    "topic_consume": """SELECT CAST(doc_id % 8 AS INTEGER) AS partition, count(*) messages, count(DISTINCT doc_id // 8) offsets,
      max(doc_id // 8) high FROM documents GROUP BY 1""",
    "topic_land": INGEST["land_corpus"],
    "token_window": with_views(EV, FEED, FEED_LANDED)
    + """SELECT batch_id % 8 part, count(*) * CASE WHEN batch_id % 8 = 0 THEN 2 ELSE 1 END AS "rows", 9::INTEGER inserts FROM fl GROUP BY 1""",
}
