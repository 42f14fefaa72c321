"""Framed messages: the topic, the frame, the datum.

The topic source and the datum codec live in two optional Spark packages. Both stay behind this
module; everything downstream works on nested batches and runs without them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanout import schemas as S
from fanout.functions.wire import build_frame, frame_datum, frame_problem


def topic(spark: SparkSession, servers: str, name: str, *, streaming: bool, per_trigger: int | None = None) -> DataFrame:
    """A topic from its beginning; a restarted stream continues from its checkpoint.

    Needs the spark-sql-kafka package on the cluster.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name)
    reader = reader.option("startingOffsets", "earliest")
    if streaming and per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(per_trigger))
    return reader.load()


def _avro(dt: T.DataType, name: str, nullable: bool):
    if isinstance(dt, T.StructType):
        optional = {"region", "quality"}
        shape = {
            "type": "record",
            "name": name,
            "fields": [
                {"name": f.name, "type": _avro(f.dataType, f.name.capitalize(), f.name in optional)}
                for f in dt.fields
            ],
        }
    elif isinstance(dt, T.ArrayType):
        shape = {"type": "array", "items": _avro(dt.elementType, name.rstrip("s"), False)}
    else:
        shape = {"bigint": "long", "int": "int", "double": "double", "string": "string"}[dt.simpleString()]
    return ["null", shape] if nullable else shape


def batch_avro_schema() -> str:
    """The datum's schema, written from the declared struct."""
    return json.dumps(_avro(S.BATCH, "Batch", False))


def decode(messages: DataFrame, *, schema_id: int, drop_broken: bool = False) -> DataFrame:
    """Framed values to nested batches. Needs the spark-avro package.

    A broken frame, or one of another schema, fails the job unless ``drop_broken`` is set.
    """
    from pyspark.sql.avro.functions import from_avro

    value = F.col("value")
    problem = frame_problem(value, F.lit(schema_id))
    if drop_broken:
        good = messages.filter(problem.isNull())
    else:
        checked = F.when(problem.isNull(), value).otherwise(F.raise_error(problem))
        good = messages.withColumn("value", checked)
    mode = "PERMISSIVE" if drop_broken else "FAILFAST"
    decoded = good.select(from_avro(frame_datum(F.col("value")), batch_avro_schema(), {"mode": mode}).alias("b"))
    return decoded.filter("b is not null").select("b.*") if drop_broken else decoded.select("b.*")


def envelopes(batches: DataFrame, datum: Column, *, schema_id: int, topic_name: str, partitions: int) -> DataFrame:
    """Messages for ``batches``: keyed by sensor, dealt to partitions by batch id."""
    b = F.col("batch_id")
    return batches.select(
        F.col("sensor").alias("key"),
        build_frame(F.lit(schema_id), datum).alias("value"),
        F.lit(topic_name).alias("topic"),
        F.pmod(b, F.lit(partitions)).cast("int").alias("partition"),
        F.call_function("div", b, F.lit(partitions)).alias("offset"),
    )


def split_broken(messages: DataFrame, schema_id: Column | int) -> tuple[DataFrame, DataFrame]:
    """Good messages and rejected ones with the rule each broke, for callers that must not fail."""
    judged = messages.withColumn("problem", frame_problem(F.col("value"), schema_id))
    return judged.filter("problem is null").drop("problem"), judged.filter("problem is not null")
