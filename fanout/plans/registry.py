"""Every registered query and, where SQL can say it, its independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fanout.plans import capacity, correctness, ingest, logplans, measurement, ranking, roundtrips, streams

MODULES = [ingest, correctness, measurement, logplans, ranking, capacity, streams, roundtrips]

Query = Callable[[SparkSession, str], DataFrame]


def _in_utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
