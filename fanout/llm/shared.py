"""Written intermediate tables in the shared folder, and what every operator needs before it starts.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor costs a re-read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanout.session import scratch_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20  # bytes of rows in an Arrow batch; ten thousand texts would hold more, here and again in the Python worker
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _given(spark: SparkSession, **settings) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def in_batches(spark: SparkSession):
    """What runs inside sends Python workers BATCH bytes at a time, whatever the rows' number; the session stays as it was."""
    return _given(spark, **{BATCH_BYTES: BATCH})


def swept(spark: SparkSession):
    """What runs inside leaves no shuffle files: they go when it has ended, not when the driver happens to collect its garbage.

    For a frame whose result is kept as a table or as a row, so that nothing reads the shuffles again.
    """
    return _given(spark, **{CLEANUP: "true"})


def freed(run: Callable) -> Callable:
    """For ``mapInArrow``: ``run``, at whose end the worker gives back what Arrow holds unused, before it waits for another task."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


_tables: list[list[DataFrame]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, with lineage cut there."""
    spark = df.sparkSession
    folder = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with in_batches(spark), swept(spark):
        df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    for made in _tables[-1:]:
        made.append(table)
    return table


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``written`` of what ``make`` gives, and then the tables that ``make`` wrote go: only that frame may read them."""
    _tables.append([])
    try:
        table = written(make(), label)
        discard(*[t for t in _tables[-1] if t is not table])
    finally:
        _tables.pop()
    for made in _tables[-1:]:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing to come reads, neither a plan still to run nor one to be run again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it stands."""
    here = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (here, paths) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it was; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


FILTER_BITS = 1 << 23
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast while it has no more than BROADCAST_ROWS rows.

    That is some 50 MB in a task's memory. Beyond it the join is left to the planner.
    """
    with swept(table.sparkSession):
        rows = table.count()
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def likely(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose value in ``column`` is not in ``wanted``'s: ahead of a join, to shuffle less.

    A filter of fixed size (FILTER_BITS bits, 131,072 rows) goes to every task. Values collide in it, so
    the join must follow; with very many values it lets all rows pass.
    """
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({column}), {FILTER_BITS}), 64) as int))")
    words = wanted.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = df.withColumns({"__place": word, "__mask": bit}).join(
        F.broadcast(words), F.col("__place") == F.col("__word")
    )
    return marked.filter(F.col("__bits").bitwiseAND(F.col("__mask")) != 0).select(df.columns)


def cells(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of every text in an Arrow column, one at a time; null is empty."""
    data = column.cast(pa.binary()).fill_null(b"")
    if len(data):
        _, places, content = data.buffers()
        at = np.frombuffer(places, np.int32)[data.offset : data.offset + len(data) + 1].tolist()
        view = memoryview(content) if content else memoryview(b"")
        for start, end in zip(at, at[1:], strict=False):
            yield bytes(view[start:end])
