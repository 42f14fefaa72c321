"""Where rows go: the target table, the archive, the prefilled topic, JSON lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanout import schemas as S

ROWS_PER_FILE = 5_000_000
RECORDS_PER_FILE = 100_000


def target_rows(landed: DataFrame, *, stamped: bool = True) -> DataFrame:
    """The target's columns in its order, with one insert clock for the whole write."""
    rows = landed.select(*S.COLUMNS)
    return rows.withColumn("ingest_ts", F.current_timestamp()) if stamped else rows


def insert(landed: DataFrame, path: str, *, mode: str = "append", stamped: bool = True) -> None:
    """Append to the target. Sorted inside each task, so that row groups can be skipped, unshuffled."""
    (
        target_rows(landed, stamped=stamped)
        .sortWithinPartitions(*S.SORT_ORDER)
        .write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(path)
    )


def truncate(spark: SparkSession, path: str) -> None:
    """Leave the target empty, with its schema."""
    empty = spark.createDataFrame([], S.LANDED)
    empty.withColumn("ingest_ts", F.current_timestamp()).write.mode("overwrite").parquet(path)


def insert_epoch(landed: DataFrame, path: str, drain: str, epoch: int) -> None:
    """Write one micro-batch to a folder of its drain and epoch, replacing it: a replayed epoch lands once.

    Epochs count from 0 in every drain, so the drain's own id is part of the folder.
    """
    insert(landed, f"{path.rstrip('/')}/drain={drain}/epoch={epoch}", mode="overwrite")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row, fields in column order, nulls spelled out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def append_archive(filed: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Append records, already carrying ``root`` and ``month``, under root, environment, system, month.

    A place's records meet in as many tasks as they fill files, counted ahead of the write: a small month is one file, and
    a large one does not wait for a few tasks.
    """
    places = ["root", "env_id", "entrant", "month"]
    placed = filed.withColumn("env_id", F.col("run.env_id")).withColumn("entrant", F.col("sut.entrant")).drop("pos")
    sizes = placed.groupBy(*[F.col(p).alias(f"_{p}") for p in places]).agg(
        F.ceil(F.count("*") / records_per_file).alias("_files")
    )
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in places])
    dealt = placed.join(sizes, same).withColumn("_file", F.pmod(F.xxhash64("run_id"), F.col("_files")))
    written = dealt.repartition(*places, "_file").drop("_file", "_files", *[f"_{p}" for p in places])
    written.write.mode("append").partitionBy(*places).json(path)


def prefill(
    spark: SparkSession, make: Callable[[], DataFrame], path: str, *, expected: int
) -> str:
    """Fill a topic folder once: reuse one that is complete, refuse one that is partial.

    Returns ``written`` or ``reused``.
    """
    try:
        depth = spark.read.parquet(path).count()
    except AnalysisException:  # nothing written there yet
        depth = 0
    if depth == expected:
        return "reused"
    if depth:
        raise ValueError(f"{path} holds {depth} of {expected} messages; refusing to add to a partial corpus")
    make().write.mode("overwrite").partitionBy("partition").parquet(path)
    return "written"
