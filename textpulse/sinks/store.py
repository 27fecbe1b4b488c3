"""Result tables and the document store as plain Spark tables, partitioned by day.

Tables live in the session's catalog (a metastore on a cluster), in a database whose location is
the store's root. All operations are set-at-a-time Spark writes:

* appends, and ``accumulate``: each micro-batch writes its sums under (day, stream, batch_id)
  with dynamic partition overwrite, so a replay replaces its own rows and streams never meet;
  reading sums them;
* rewrites of listed days: dynamic partition overwrite from checkpointed rows;
* rewrites of a whole table (upserts whose key does not hold the day, updates, deletes): one query
  into a new table, from which the old one is then overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.functions.json import json_field
from textpulse.operators.upsert import delete_first, delete_where, update_first, update_where, upsert_replace
from textpulse.session import materialize

BATCH = ["stream", "batch_id"]


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.database = f"store_{hashlib.sha256(root.encode()).hexdigest()[:12]}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{root}'")

    def name(self, table: str) -> str:
        return f"{self.database}.`{table}`"

    # ---- create / read ------------------------------------------------------------------
    def ensure_table(self, table: str, schema: str | T.StructType, accumulate: bool = False) -> None:
        """Create an empty table if none exists; ``accumulate``: for sums by stream and batch."""
        fields = self.spark.createDataFrame([], schema).schema.fields
        columns = [f for f in fields if f.name != "day"] + [T.StructField("day", T.StringType())]
        if accumulate:
            columns += [T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        parts = ", ".join(["day", *BATCH] if accumulate else ["day"])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({ddl}) USING parquet PARTITIONED BY ({parts})")

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def list_tables(self, pattern: str = "*") -> list[str]:
        """Names of the tables that match a pattern (``hot_word*``)."""
        return sorted(t.name for t in self.spark.catalog.listTables(self.database, pattern))

    def read(self, table: str) -> DataFrame:
        """The table's rows; filters on ``day`` (a ``yyyyMMdd`` string) prune partitions."""
        if not self.exists(table):
            raise ValueError(f"no table {table}")
        return self.spark.table(self.name(table))

    def scan(self, table: str, columns: Sequence[str] | None = None, where: Column | str | None = None,
             order_by: Sequence[Column | str] | None = None, limit: int | None = None) -> DataFrame:
        """Projection + predicate + order + limit; the predicate and projection reach the
        parquet scan (partition pruning on ``day``), order+limit plans as a top-k."""
        df = self.read(table)
        if where is not None:
            df = df.where(where)
        if columns:
            df = df.select(*columns)
        if order_by:
            df = df.orderBy(*order_by)
        if limit is not None:
            df = df.limit(limit)
        return df

    def find(self, table: str, field: str, value: object, doc_col: str = "data") -> DataFrame:
        """Documents whose JSON ``field`` equals ``value`` (document find by one equality)."""
        return self.read(table).where(json_field(doc_col, field) == F.lit(str(value)))

    def list_days(self, table: str) -> DataFrame:
        """The days of a table, from the catalog's partitions: no data is read."""
        parts = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}")
        return parts.select(F.regexp_extract("partition", "(?:^|/)day=([^/]*)", 1).alias("day")).distinct()

    # ---- writes -------------------------------------------------------------------------
    def _insert(self, df: DataFrame, table: str, overwrite: str | None = None) -> None:
        """Insert rows. ``overwrite``: ``dynamic`` replaces the partitions that the rows are in and no
        others, ``static`` the whole table."""
        mode = "spark.sql.sources.partitionOverwriteMode"
        conf = df.sparkSession.conf  # a micro-batch has a session of its own
        before = conf.get(mode)
        conf.set(mode, overwrite or before)
        try:
            df.select(*self.read(table).columns).write.insertInto(self.name(table), overwrite=overwrite is not None)
        finally:
            conf.set(mode, before)

    def append(self, df: DataFrame, table: str) -> None:
        """Append rows; equal rows are kept."""
        self.ensure_table(table, df.schema)
        self._insert(df, table)

    def accumulate(self, deltas: DataFrame, table: str, keys: Sequence[str], value: str, batch_id: int,
                   stream: str = "default") -> None:
        """Add ``deltas`` (summed per key here) as batch ``batch_id`` of ``stream``.

        Idempotent per stream and batch: a replay overwrites its own partitions. Streams (or
        restarts from a new checkpoint) with names of their own never overwrite each other. A
        replay must hold the days that the batch had, as a micro-batch's replay does."""
        keys = [k for k in keys if k != "day"]
        sums = deltas.groupBy("day", *keys).agg(F.sum(value).alias(value))
        self.ensure_table(table, sums.schema, accumulate=True)
        self._insert(sums.withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")), table, "dynamic")

    def accumulated(self, table: str, keys: Sequence[str], value: str) -> DataFrame:
        """The sums of an accumulate table: value added up over streams and batches per key."""
        keys = [k for k in keys if k != "day"]
        return self.read(table).groupBy("day", *keys).agg(F.sum(value).alias(value))

    def _rewrite_days(self, table: str, rows: DataFrame, days: Sequence[str]) -> None:
        """Replace the listed days by ``rows``; one that gets no rows goes."""
        rows = materialize(rows)
        self._insert(rows, table, "dynamic")
        left = {r.day for r in rows.select("day").distinct().collect()}  # at most one row per day
        for day in set(days) - left:
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION (day = '{day}')")

    def _rewrite(self, table: str, rows: DataFrame) -> None:
        """Write ``rows``, made from the table, to a new table and the table from that one; until the
        end the new table holds all rows, should the driver be lost."""
        new = f"{table}__new"
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(new)}")
        rows.select(*self.read(table).columns).write.partitionBy("day").saveAsTable(self.name(new), format="parquet")
        self._insert(self.read(new), table, "static")
        self.spark.sql(f"DROP TABLE {self.name(new)}")

    def replace(self, incoming: DataFrame, table: str, keys: Sequence[str], seq: str, keep: str = "last") -> None:
        """Upsert-replace: per key keep the last (or first) row by ``seq`` across stored and
        incoming rows. If the key holds ``day``, only the days of the incoming rows are read and
        rewritten, else the table."""
        self.ensure_table(table, incoming.schema)
        stored = self.read(table).select(*incoming.columns)
        if "day" not in keys:
            self._rewrite(table, upsert_replace(incoming, list(keys), seq, existing=stored, keep=keep))
            return
        days = [r.day for r in incoming.select("day").distinct().collect()]  # one row per day
        self._rewrite_days(table, upsert_replace(incoming, list(keys), seq, existing=stored.where(F.col("day").isin(days)), keep=keep), days)

    def _change(self, table: str, change: Callable[[DataFrame], DataFrame], days: Sequence[str] | None) -> None:
        rows = self.read(table)
        if set(BATCH) <= set(rows.columns):
            raise ValueError(f"{table} is an accumulate table: write its sums to a table of their own first")
        if days is None:
            self._rewrite(table, change(rows))
        else:
            self._rewrite_days(table, change(rows.where(F.col("day").isin(list(days)))), days)

    def update(self, table: str, predicate: Column, assignments: Mapping[str, Column | object],
               days: Sequence[str] | None = None) -> None:
        """Set columns on matching rows, rewriting only the listed days (or the table)."""
        self._change(table, lambda rows: update_where(rows, predicate, assignments), days)

    def update_one(self, table: str, predicate: Column, assignments: Mapping[str, Column | object], seq: str,
                   days: Sequence[str] | None = None) -> None:
        """Set columns on the matching row with the lowest ``seq`` only."""
        self._change(table, lambda rows: update_first(rows, predicate, assignments, seq), days)

    def delete(self, table: str, predicate: Column, days: Sequence[str] | None = None) -> None:
        """Delete matching rows, rewriting only the listed days (or the table)."""
        self._change(table, lambda rows: delete_where(rows, predicate), days)

    def delete_one(self, table: str, predicate: Column, seq: str, days: Sequence[str] | None = None) -> None:
        """Delete the matching row with the lowest ``seq`` only."""
        self._change(table, lambda rows: delete_first(rows, predicate, seq), days)
