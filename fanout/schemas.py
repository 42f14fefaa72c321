"""Every schema and every fixed value of the workload, declared once.

Readers always pass one of these schemas; nothing in the package infers one.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The workload's contract. Results depend on them being exactly these.
EVENTS_PER_BATCH = 100
SENSORS = 1024
REGIONS = 7
NAMES = 32
TAGS = 16
UNITS = ["count", "bytes", "ms", "drop", "ratio", "celsius", "volts", "rpm"]
DROP_UNIT = "drop"
QUALITY_FLOOR = 0.2
BASE_TS_MS = 1_772_000_000_000
VALUE_MODULUS = 2_147_483_647
SCHEMA_VERSION = 2
METRIC_UNITS = ["MB/s", "bytes", "cores", "ratio", "records/s", "rows", "us"]
PRIMARY_METRIC = "rows_per_s"
HEADROOM_LIMIT = 0.70
MESSAGE_BYTES_TOLERANCE = 0.05
SATURATED_BELOW = 0.98
OFFERED_RATE_MIN_SHARE = 0.99
QUIESCE_MAX_S = 900
DRAIN_MAX_S = 600
WARMUP_MAX_S = 120
PROBE_MAX_FAILURES = 5
SWEEP_MARGIN = 0.03
SWEEP_PATIENCE = 2
PROFILE_COUNTERS = [
    "UserTimeMicroseconds",
    "SystemTimeMicroseconds",
    "RealTimeMicroseconds",
    "OSCPUVirtualTimeMicroseconds",
    "OSCPUWaitMicroseconds",
    "InsertedRows",
    "InsertedBytes",
    "AsyncInsertQuery",
    "AsyncInsertRows",
]

EVENT = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

BATCH = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("batch_ts_ms", T.LongType()),
        T.StructField("send_ts_us", T.LongType()),
        T.StructField("events", T.ArrayType(EVENT)),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

LANDED = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("event_seq", T.IntegerType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("name_upper", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("value_scaled", T.LongType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("batch_ts", T.TimestampType()),
        T.StructField("send_ts", T.TimestampType()),
    ]
)
COLUMNS = LANDED.fieldNames()
SORT_ORDER = ["sensor", "batch_ts", "batch_id", "event_seq"]

SAMPLE_COUNTERS = [
    "usage_usec",
    "user_usec",
    "system_usec",
    "nr_throttled",
    "throttled_usec",
    "mem_current",
    "mem_peak",
    "anon",
    "file",
    "slab",
    "kernel_stack",
    "sock",
]
SAMPLE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ["t_ms", *SAMPLE_COUNTERS]]
)

QUERY_LOG_TSV = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("written_rows", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("profile_events", T.StringType()),
    ]
)

METRIC = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("higher_is_better", T.BooleanType()),
        T.StructField("ci95", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType()),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("schema", T.IntegerType()),
        T.StructField("bench", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("rep", T.IntegerType()),
        T.StructField("reps", T.IntegerType()),
        T.StructField(
            "sut",
            T.StructType(
                [
                    T.StructField(n, T.StringType())
                    for n in [
                        "entrant",
                        "variant_id",
                        "version",
                        "commit",
                        "image_digest",
                        "image",
                        "toolchain",
                    ]
                ]
            ),
        ),
        T.StructField(
            "run",
            T.StructType(
                [
                    T.StructField("ts_ms", T.LongType()),
                    T.StructField("invocation_id", T.StringType()),
                    T.StructField("env_id", T.StringType()),
                    T.StructField("env_digest", T.StringType()),
                    T.StructField("harness_version", T.IntegerType()),
                    T.StructField("dataset_version", T.StringType()),
                    T.StructField("commit", T.StringType()),
                    T.StructField("trigger", T.StringType()),
                    T.StructField(
                        "infra",
                        T.StructType(
                            [
                                T.StructField("digest", T.StringType()),
                                T.StructField("partitions", T.IntegerType()),
                                T.StructField("ceiling_msgs_per_s", T.LongType()),
                                T.StructField("ceiling_bytes_per_s", T.LongType()),
                                T.StructField("ceiling_rows_per_s", T.LongType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("variant", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), METRIC)),
        T.StructField("note", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
    ]
)

_PROVENANCE = T.StructType([T.StructField("infra_digest", T.StringType())])
CEILINGS = T.StructType(
    [
        T.StructField(
            "consume",
            T.StructType(
                [
                    T.StructField("msgs_per_s", T.LongType()),
                    T.StructField("mb_per_s", T.DoubleType()),
                    T.StructField("message_bytes", T.LongType()),
                    T.StructField("client", T.StringType()),
                    T.StructField("provenance", _PROVENANCE),
                ]
            ),
        ),
        T.StructField(
            "ingest",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("format", T.StringType()),
                        T.StructField("rows_per_s", T.LongType()),
                        T.StructField("mb_per_s", T.DoubleType()),
                        T.StructField("row_bytes", T.LongType()),
                        T.StructField("client", T.StringType()),
                        T.StructField(
                            "sweep",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("concurrency", T.LongType()),
                                        T.StructField("rows_per_s", T.LongType()),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("provenance", _PROVENANCE),
                    ]
                )
            ),
        ),
    ]
)


def require_schema(df, schema: T.StructType) -> None:
    """Refuse a frame whose field names, order or types differ from ``schema``."""

    def shape(s):
        return [(f.name, f.dataType.simpleString()) for f in s.fields]

    if shape(df.schema) != shape(schema):
        raise ValueError(
            f"schema mismatch: got {df.schema.simpleString()}, "
            f"declared {schema.simpleString()}"
        )


def _record(**fields) -> T.StructType:
    """A struct of required fields, and optional ones whose names end in ``_``."""
    return T.StructType(
        [T.StructField(n.removesuffix("_"), t, n.endswith("_")) for n, t in fields.items()]
    )


_TEXT, _LONG, _TEXTS = T.StringType(), T.LongType(), T.ArrayType(T.StringType())

# a descriptor as far as summaries and checks read it: one document a system
DESCRIPTOR = _record(
    schema=_LONG,
    id=_TEXT,
    name=_TEXT,
    status=_TEXT,
    language_=_TEXTS,
    display_=_record(order=_LONG, hue=_LONG, short=_TEXT),
    containers_=T.ArrayType(_record(role=_TEXT, name=_TEXT, cpus=_TEXT, memory=_TEXT)),
    variants_=T.ArrayType(_record(id=_TEXT, label=_TEXT, approach=_TEXT, default_=T.BooleanType())),
)

# an environment: one document each
ENVIRONMENT = _record(
    id=_TEXT,
    **{"class": _TEXT},
    host=_record(cpu=_TEXT, cores=_LONG, memory=_TEXT, os_=_TEXT),
    infra=_record(partitions=_LONG, digest_=_TEXT),
)
