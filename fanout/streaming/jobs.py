"""Drain and live ingest as streaming queries.

Offsets are logged before a micro-batch runs and committed after its write returns, so a failed
batch is run again: at-least-once. ``insert_epoch`` turns that into once, because the replayed epoch
overwrites its own folder, named by the query's id and the epoch. The transform keeps no state and needs no watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fanout import schemas as S
from fanout.operators.transform import LAND_SQL, land
from fanout.sources.sinks import insert, insert_epoch, target_rows
from fanout.sources.tokens import TokenTable

COMMIT_INTERVAL = "5 seconds"
Sink = Callable[[DataFrame, int], None]


def nested_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Nested batches from a growing folder, whose files must have the batches' schema."""
    with suppress(AnalysisException):  # nothing there yet
        S.require_schema(spark.read.parquet(path), S.BATCH)
    return spark.readStream.schema(S.BATCH).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_sink(path: str) -> Sink:
    """At-least-once: a replayed micro-batch lands again."""
    return lambda rows, _epoch: insert(rows, path)


def epoch_sink(path: str, drain: str | None = None) -> Sink:
    """Once: a replayed micro-batch replaces itself.

    ``drain`` is the name of the drain, by default the streaming query's id: it stays the same when the query
    is started again from its checkpoint, and differs for another query into the same target.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        insert_epoch(rows, path, _drain_of(rows, drain), epoch)

    return write


def _drain_of(rows: DataFrame, drain: str | None) -> str:
    own = drain or rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not own:
        raise ValueError("a sink that lands once needs the drain's name outside a streaming query")
    return own


def token_sink(table: TokenTable, drain: str | None = None) -> Sink:
    """Once within the table's window of tokens: a micro-batch's token is its drain and epoch."""

    def write(rows: DataFrame, epoch: int) -> None:
        table.insert(target_rows(rows).sortWithinPartitions(*S.SORT_ORDER), f"{_drain_of(rows, drain)}/{epoch}")

    return write


def folder_sink(path: str, drain: str | None = None) -> Sink:
    """Rows of any shape to a folder of their drain and epoch, replacing it."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/drain={_drain_of(rows, drain)}/epoch={epoch}")

    return write


def ledger_sink(inner: Sink, path: str, run: str) -> Sink:
    """Record rows written per micro-batch, counted while they are written: the poll table's source."""

    def write(rows: DataFrame, epoch: int) -> None:
        seen = Observation()
        inner(rows.observe(seen, F.count(F.lit(1)).alias("rows")), epoch)
        line = rows.sparkSession.range(1).select(
            F.lit(run).alias("run"),
            F.lit(epoch).cast("long").alias("epoch"),
            F.lit(seen.get["rows"]).cast("long").alias("rows"),
            F.current_timestamp().alias("at"),
        )
        line.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return write


def landing_view_sink(path: str) -> Sink:
    """Flatten through a view over the nested micro-batch, which is never stored."""

    def write(batches: DataFrame, _epoch: int) -> None:
        session = batches.sparkSession
        batches.createOrReplaceTempView("landing")
        try:
            insert(session.sql(LAND_SQL.format(batches="landing")), path)
        finally:
            session.catalog.dropTempView("landing")

    return write


def _start(frame: DataFrame, sink: Sink, checkpoint: str, *, live: bool, mode: str = "append") -> StreamingQuery:
    writer = frame.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=COMMIT_INTERVAL) if live else writer.trigger(availableNow=True)
    return writer.start()


def start_ingest(batches: DataFrame, sink: Sink, checkpoint: str, *, live: bool = False) -> StreamingQuery:
    """Land a stream of nested batches. Not live: everything there now, then stop."""
    return _start(land(batches), sink, checkpoint, live=live)


def start_sink(
    frame: DataFrame, sink: Sink, checkpoint: str, *, live: bool = False, mode: str = "append"
) -> StreamingQuery:
    """Hand a stream of any shape to a sink. Not live: everything there now, then stop."""
    return _start(frame, sink, checkpoint, live=live, mode=mode)


def start_landing_view(batches: DataFrame, path: str, checkpoint: str, *, live: bool = False) -> StreamingQuery:
    return _start(batches, landing_view_sink(path), checkpoint, live=live)


def drain(query: StreamingQuery) -> None:
    """Wait for a bounded run to end, raising what failed it."""
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


def drain_by_restarts(start: Callable[[], StreamingQuery]) -> int:
    """Start a bounded run from the same checkpoint again and again until one finds nothing; how many found something.

    A source with a limit a trigger gives one trigger a bounded run.
    """
    runs = 0
    while True:
        query = start()
        drain(query)
        if not any(p["numInputRows"] for p in query.recentProgress):
            return runs
        runs += 1
