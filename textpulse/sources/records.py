"""Record sources: JSON envelopes from Kafka or files, parsing with a quarantine, word lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse import fixed

# Envelope of a message-bus record; file sources produce the same columns.
CORRUPT = "_corrupt_record"
ENVELOPE_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp"]


def kafka_options(
    topic: str,
    servers: str,
    start: str = "committed",
    group_id: str | None = None,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options for Spark's Kafka source.

    ``start="committed"`` resumes where the query's checkpoint left off (the checkpoint plays
    the role of committed group offsets; a fresh checkpoint starts at the latest offsets);
    ``start="earliest"`` replays the topic from the beginning on a fresh checkpoint.
    """
    if start not in ("committed", "earliest", "latest"):
        raise ValueError(f"start must be committed, earliest or latest, got {start!r}")
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    opts["startingOffsets"] = "earliest" if start == "earliest" else "latest"
    if group_id:
        opts["kafka.group.id"] = group_id
    opts.update(extra or {})
    return opts


def kafka_source(spark: SparkSession, topic: str, servers: str, start: str = "committed", stream: bool = True,
                 **extra: str) -> DataFrame:
    """Kafka records with the envelope columns and ``value`` decoded as UTF-8 text."""
    options = kafka_options(topic, servers, start, extra=extra)
    if not stream:  # a batch read has no checkpoint to resume from, and no latest start
        options["startingOffsets"] = "earliest"
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").options(**options).load()
    return raw.select(
        F.col("key").cast("string").alias("key"),
        F.decode(F.col("value"), "UTF-8").alias("value"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def file_source(spark: SparkSession, path: str, stream: bool = True, max_files_per_trigger: int | None = None
                ) -> DataFrame:
    """Newline-delimited JSON text files as an envelope stream (``value`` = one line)."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.format("text").load(path)
    return raw.select(
        F.lit(None).cast("string").alias("key"),
        F.col("value"),
        F.input_file_name().alias("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )


def parse_records(df: DataFrame, schema: T.StructType, value_col: str = "value", key_field: str = "av",
                  mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """Parse JSON text into typed records; return ``(good, quarantine)``.

    Malformed text, fields of another type and empty objects (no ``key_field``) go to the quarantine with a reason
    instead of failing the job. ``mode="FAILFAST"`` raises on malformed input instead.
    """
    if mode.upper() == "FAILFAST":
        # every row is parsed (a malformed one fails the job); nothing is quarantined
        parsed = df.withColumn("_rec", F.from_json(F.col(value_col), schema, {"mode": mode}))
        good = parsed.where(F.col(f"_rec.{key_field}").isNotNull()).select(*[c for c in df.columns if c != value_col], "_rec.*")
        return good, parsed.where(F.lit(False)).select(*df.columns, F.lit("").alias("reason"))
    # one parse: a text that is no object, or a field of another type, fills the corrupt column
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = df.withColumn("_rec", F.from_json(F.col(value_col), with_corrupt, options))
    corrupt = F.col("_rec").isNull() | F.col(f"_rec.{CORRUPT}").isNotNull()
    has_key = F.col(f"_rec.{key_field}").isNotNull()
    good = parsed.where(~corrupt & has_key).select(
        *[c for c in df.columns if c != value_col], *[F.col(f"_rec.{f.name}") for f in schema.fields]
    )
    quarantine = parsed.where(corrupt | ~has_key).select(
        *df.columns,
        F.when(corrupt, F.lit("malformed")).otherwise(F.lit("empty")).alias("reason"),
    )
    return good, quarantine


def word_list(spark: SparkSession, path: str | None) -> DataFrame:
    """Words of a UTF-8 file, one per line, deduplicated; a missing file gives an empty list."""
    empty = spark.createDataFrame([], "word STRING")
    if not path:
        return empty
    try:
        df = spark.read.text(path)
    except Exception as exc:  # missing path -> empty set, as the original's null stream
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return empty
        raise
    return df.select(F.col("value").alias("word")).where(F.col("word") != "").distinct()


def word_values(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    """A word list given inline (a fixed list, or a small list from a parameter)."""
    return spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word STRING")


def blacklist(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The blacklist from ``path``, or the application's own list when no path is given."""
    return word_list(spark, path) if path else word_values(spark, fixed.BLACKLIST_WORDS)


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, num_partitions: int | None = None,
                 properties: dict[str, str] | None = None) -> dict[str, str]:
    """Options for Spark's JDBC source: a partitioned read (one query per stride of
    ``partition_column``) with aggregate and limit pushdown enabled."""
    opts = {"url": url, "dbtable": table, "pushDownAggregate": "true", "pushDownLimit": "true"}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned JDBC read needs lower and upper bounds")
        opts.update({
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(num_partitions or 8),
        })
    opts.update(properties or {})
    return opts


def jdbc_scan(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
              properties: dict[str, str] | None = None) -> DataFrame:
    """Partitioned JDBC scan; filters, projections, limits and aggregates on the result are
    pushed to the database by Spark's JDBC source."""
    opts = jdbc_options(url, table, partition_column, lower, upper, num_partitions, properties)
    return spark.read.format("jdbc").options(**opts).load()
