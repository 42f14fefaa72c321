"""Session construction and the one place that decides where durable scratch goes."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "fanout", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may leave it unset; then it is a folder
    in the warehouse, removed when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    made = f"{warehouse.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(shutil.rmtree, made, True)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several later steps read: computed once, and its lineage ends there.

    The files are in the shared folder, so a lost executor costs a re-read and not a recomputation.
    """
    context = df.sparkSession.sparkContext
    root = scratch_root(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, for steps that each read a few of its columns or rows."""
    folder = scratch_path(df.sparkSession, "kept")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_STAGED: dict[tuple[str, str], str] = {}


def staged_folder(spark: SparkSession, name: str, make: Callable[[], DataFrame], *partitioned: str) -> str:
    """Folder of a derived table, written once per application to the shared folder, by the columns given."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STAGED:
        frame = make()
        folder = scratch_path(spark, "staged")
        # rows of one value from several tasks: no value goes through one task
        frame.write.partitionBy(*partitioned).parquet(folder)
        _STAGED[key] = folder
    return _STAGED[key]


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application to the shared folder, then read like any other.

    Reading it back gives plans real scans, with pruned columns and pushed filters, and keeps the
    derivation out of every plan that uses it. ``name`` must say everything the table depends on.
    """
    return spark.read.parquet(staged_folder(spark, name, make))
