"""Typed readers for the JSON feeds (SRC-1, SRC-6).

Schemas are explicit (never inferred) and parsing is PERMISSIVE with the raw
text kept in ``_corrupt_record``, so a bad record becomes a row to
quarantine, not a failed job.  The same schema serves batch files, streams
and JSON held in a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .fixtures import ticket_requests

CORRUPT = "_corrupt_record"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

REQUEST_FIELDS = [
    T.StructField("ticket_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampNTZType()),
]
REQUEST_SCHEMA = T.StructType(REQUEST_FIELDS)
REQUEST_SCHEMA_PERMISSIVE = T.StructType(REQUEST_FIELDS + [T.StructField(CORRUPT, T.StringType())])

FAILURE_SCHEMA = T.StructType(
    [
        T.StructField(
            "execution",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField(
                        "error",
                        T.StructType([T.StructField("message", T.StringType()), T.StructField("stack", T.StringType())]),
                    ),
                ]
            ),
        ),
        T.StructField("workflow", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField(CORRUPT, T.StringType()),
    ]
)


def request_json(events: DataFrame) -> DataFrame:
    """The F1 requests as JSON text, one document per event; every 47th is malformed."""
    req = ticket_requests(events)
    doc = F.to_json(
        F.struct("ticket_id", "customer_id", "subject", "body", "idempotency_key", "created_at")
    )
    bad = F.col("event_id") % 47 == 0
    return req.select("event_id", F.when(bad, F.concat(F.lit("x"), doc)).otherwise(doc).alias("value"))


def parse_requests(df: DataFrame, col: str = "value") -> DataFrame:
    """SRC-1: JSON text -> typed request columns + ``is_corrupt``."""
    parsed = F.from_json(F.col(col), REQUEST_SCHEMA_PERMISSIVE, PERMISSIVE)
    out = df.withColumn("_r", parsed)
    return out.select(
        *[c for c in df.columns if c != col],
        *[F.col(f"_r.{f.name}").alias(f.name) for f in REQUEST_FIELDS],
        F.col(f"_r.{CORRUPT}").isNotNull().alias("is_corrupt"),
    )


def request_lines(events: DataFrame) -> DataFrame:
    """The F1 requests as JSON lines with metadata; every 47th line is malformed, of every 53rd the metadata is a text."""
    eid = F.col("event_id")
    channel = F.when(eid % 3 == 0, F.lit("email")).otherwise(F.lit("portal"))
    extra = F.struct(F.create_map(F.lit("channel"), channel, F.lit("event"), eid.cast("string")).alias("metadata"))
    fields = ["ticket_id", "customer_id", "customer_email", "subject", "body", "idempotency_key", "created_at"]
    whole = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    doc = F.to_json(F.struct(*fields, extra["metadata"].alias("metadata")), whole)
    odd = F.to_json(F.struct(*fields, F.lit("none").alias("metadata")), whole)
    value = F.when(eid % 47 == 0, F.concat(F.lit("x"), doc)).when(eid % 53 == 0, odd).otherwise(doc)
    return ticket_requests(events).select(value.alias("value"))


def write_lines(lines: DataFrame, path: str, files: int) -> str:
    """The lines as text files under ``path``, dealt by their hash."""
    lines.repartition(files, F.xxhash64("value")).write.text(path)
    return path


def feed_report(read: DataFrame) -> DataFrame:
    """Requests as read from files: the service's fields, two metadata entries, and the raw line of a broken one."""
    return read.select(
        "ticket_id", "customer_id", "customer_email", "subject", "idempotency_key",
        F.col("metadata")["channel"].alias("channel"), F.col("metadata")["event"].alias("event"), "created_at",
        F.col(CORRUPT).isNotNull().alias("is_corrupt"), F.md5(CORRUPT).alias("corrupt_md5"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 batch: JSON-lines files with the request schema (PERMISSIVE)."""
    return spark.read.schema(REQUEST_SCHEMA_PERMISSIVE).options(**PERMISSIVE).json(path)


def stream_requests(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """SRC-1 stream: the same schema over a directory of JSON-lines files."""
    r = spark.readStream.schema(REQUEST_SCHEMA_PERMISSIVE).options(**PERMISSIVE)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.json(path)


def parse_failures(df: DataFrame, col: str = "failure_json", ts: str = "failed_at") -> DataFrame:
    """SRC-6: pick nested fields; message defaults to a fixed text, stack to ''."""
    f = F.from_json(F.col(col), FAILURE_SCHEMA, PERMISSIVE)
    err = f["execution"]["error"]
    return df.select(
        f["execution"]["id"].alias("execution_id"),
        f["workflow"]["name"].alias("workflow_name"),
        F.when(err.isNotNull(), err["message"]).otherwise(F.lit(C.UNKNOWN_FAILURE)).alias("error_message"),
        F.when(err.isNotNull(), err["stack"]).otherwise(F.lit("")).alias("error_stack"),
        F.col(ts).alias("failed_at"),
        F.lit(C.STEP_WORKFLOW_FAILURE).alias("step_name"),
    )


def iso_millis(ts: str | Column) -> Column:
    """ISO-8601 text with milliseconds and a Z suffix (UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
