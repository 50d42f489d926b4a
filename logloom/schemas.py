"""Column layouts used at the boundaries between stages."""

from pyspark.sql import types as T

STRING_LIST = T.ArrayType(T.StringType())

CONTEXT = T.StructType(
    [
        T.StructField("before", STRING_LIST),
        T.StructField("match", T.StringType()),
        T.StructField("after", STRING_LIST),
    ]
)

TEMPLATE = T.StructType(
    [
        T.StructField("template", T.StringType()),
        T.StructField("values", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("context", CONTEXT),
        T.StructField("severity", T.StringType()),
        T.StructField("causality", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

SME = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("template", "severity", "causality", "summary", "resolution")
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("template", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("causality", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("record_kind", T.StringType()),
    ]
)

TIPS = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("analysis", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("run_id", T.StringType()),
    ]
)

RUN_HISTORY = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("test_status", T.StringType()),
        T.StructField("report", T.StringType()),
    ]
)

TICKETS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("ticket_id", "summary", "description", "testcase", "status")
    ]
)
