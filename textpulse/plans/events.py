"""Snapshot, time-series and table-maintenance queries over ``events``.

Adapter: metric = event_type, arrival second = epoch seconds of ``ts``; upserts key on
``user_id`` with ``event_id`` as the sequence and ``props`` as the stored document.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import fixed
from textpulse.functions.json import set_json_field
from textpulse.functions.time import day_of_ms, tick_ms
from textpulse.operators.aggregate import totals
from textpulse.operators.timeseries import (
    day_changes,
    elapsed_resets,
    latest_ticks,
    lookback,
    metric_names,
    snapshot,
    snapshot_delta,
)
from textpulse.operators.upsert import delete_first, delete_where, update_where, upsert_accumulate, upsert_replace
from textpulse.session import materialize, scratch_path
from textpulse.sinks.store import TableStore
from textpulse.sources.adapters import event_seconds
from textpulse.sources.tables import read_table

# Existing-vs-incoming split for the upsert queries: rows before this instant are the table,
# later rows (and rows without an instant) the incoming stream; every row is in one of the two.
SPLIT_TS = "2024-01-15 00:00:00"
SPLIT_MS = int(datetime.strptime(SPLIT_TS, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp() * 1000)


def _events(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return event_seconds(read_table(spark, sf_dir, "events", columns))


def q_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM(value), SUM(value) per event type and COUNT(*), in one scan, as (metric, value) rows."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "value"]).withColumn(
        "v", F.col("value").cast("decimal(18,2)")
    )
    types = metric_names(ev, "event_type")
    wide = totals(ev, "v", "event_type", types, total_name="total", count_name="rows")
    metrics = ["total", *types, "rows"]
    wide = wide.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot([], metrics, "metric", "value")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(_events(spark, sf_dir, ["ts", "event_type"]), "sec", "event_type", None)


def q_snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per 5-minute tick, the day's running total of each metric."""
    return _snapshots(spark, sf_dir).select("tick_ms", "day", "metric", "total")


def q_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot minus the previous snapshot per metric (0 before the first)."""
    return snapshot_delta(_snapshots(spark, sf_dir)).select("tick_ms", "day", "metric", "total", "delta")


def q_latest_two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest snapshots within 30 minutes of the newest one.

    Only the days that the look-back reaches are read: the newest instant first, then one
    aggregate over the rows from the start of the day half an hour before it."""
    events = read_table(spark, sf_dir, "events", ["ts", "event_type"])
    types = metric_names(events, "event_type")
    newest = events.agg(F.max("ts")).first()[0]
    if newest is None:
        return snapshot(event_seconds(events), "sec", "event_type", None, types)
    since = (newest - timedelta(minutes=fixed.LOOKBACK_MINUTES, seconds=fixed.SNAPSHOT_PERIOD_SECONDS)).replace(hour=0, minute=0, second=0, microsecond=0)
    recent = snapshot(event_seconds(events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))), "sec", "event_type", None, types)
    return latest_ticks(lookback(recent, "tick_ms"), "tick_ms", k=2).select("tick_ms", "day", "metric", "total")


def q_day_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each UTC day, with the previous day's key."""
    ev = _events(spark, sf_dir, ["event_id", "ts"])
    return day_changes(ev, "sec", "event_id").select("day", "previous_day", "event_id", "sec")


def q_elapsed_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: first event, then every first event at least 24 h after the last reset."""
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id"])
    return elapsed_resets(ev, "user_id", "sec", "event_id", 86_400)


def q_elapsed_resets_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: first event, then every first event at least an hour after the last reset."""
    ev = _events(spark, sf_dir, ["event_id", "ts", "event_type"])
    return elapsed_resets(ev, "event_type", "sec", "event_id", 3_600)


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "props", "ts"])
    docs = ev.select(
        F.col("user_id").cast("string").alias("id"), F.col("props").alias("data"), F.col("event_id").alias("seq"),
        F.col("ts"),
    )
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    old, new = docs.where(F.col("ts") < split), docs.where((F.col("ts") >= split) | F.col("ts").isNull())
    return old.drop("ts"), new.drop("ts")


def _raw_upsert(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    old, new = _documents(spark, sf_dir)
    table = upsert_replace(old, ["id"], "seq", keep=keep)
    return upsert_replace(new, ["id"], "seq", existing=table, keep=keep).select("id", "data", "seq")


def q_raw_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents keyed by user id; a later document replaces the stored one."""
    return _raw_upsert(spark, sf_dir, "last")


def q_raw_upsert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents keyed by user id; the first stored document is kept."""
    return _raw_upsert(spark, sf_dir, "first")


def q_upsert_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hourly micro-batch count deltas per (day, event type), added onto a table built
    from the earlier batches."""
    ev = _events(spark, sf_dir, ["ts", "event_type"])
    deltas = (
        ev.withColumn("batch_ms", tick_ms("sec", 3600))
        .withColumn("day", day_of_ms("batch_ms"))
        .groupBy("batch_ms", "day", "event_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    split_ms = F.lit(SPLIT_MS)
    table = upsert_accumulate(deltas.where(F.col("batch_ms") < split_ms), ["day", "event_type"], "cnt")
    incoming = deltas.where(F.col("batch_ms") >= split_ms)
    return upsert_accumulate(incoming, ["day", "event_type"], "cnt", existing=table).select("day", "event_type", "cnt")


def _day(col: str = "ts") -> Column:
    return F.date_format(F.col(col), "yyyyMMdd")


def q_store_accumulate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per (day, event type) accumulated by two streams of three micro-batches each; every
    batch of one stream is replayed."""
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id", "event_type"]).where("ts is not null")
    store = TableStore(spark, scratch_path(spark, "store-accumulate"))
    parts = ev.select(_day().alias("day"), F.col("event_type"), F.pmod("user_id", F.lit(2)).alias("s"), F.pmod("event_id", F.lit(3)).alias("b"))
    deltas = materialize(parts.groupBy("s", "b", "day", "event_type").agg(F.count(F.lit(1)).alias("cnt")))
    for s, number, _ in [(s, b, k) for s in (0, 1) for b in range(3) for k in range(2 - s)]:
        rows = deltas.where((F.col("b") == number) & (F.coalesce("s", F.lit(0)) == s))
        store.accumulate(rows, "counts", ["event_type"], "cnt", number, stream=f"stream{s}")
    return store.accumulated("counts", ["event_type"], "cnt").select("day", "event_type", "cnt")


def q_store_upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents upserted by user id through the table store in three batches that arrive out
    of order; an id has documents on several days, and the newest one stays."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "props", "ts"])
    docs = ev.select(F.col("user_id").cast("string").alias("id"), F.col("props").alias("data"), F.col("event_id").alias("seq"), _day().alias("day"))
    store = TableStore(spark, scratch_path(spark, "store-upsert"))
    for number in (2, 0, 1):
        store.replace(docs.where(F.pmod("seq", F.lit(3)) == number), "raw", ["id"], "seq")
    return store.read("raw").select("id", "data", "seq", "day")


def q_store_scan_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a day table from its partitions, each with the rows appended to it and what is
    left of them after an update and a delete in place."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value", "ts"]).where("ts is not null")
    store = TableStore(spark, scratch_path(spark, "store-days"))
    rows = ev.select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), _day().alias("day"))
    for odd in (0, 1):
        store.append(rows.where(F.pmod("event_id", F.lit(2)) == odd), "days")
    store.update("days", F.col("event_type") == "error", {"value": 0})
    store.delete("days", F.col("event_type") == "view")
    left = store.scan("days", ["day", "value"]).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value"))
    return store.list_days("days").join(left, "day").select("day", "n", "value")


def q_store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document table in the store: insert, set a field of many and of one, delete many and one,
    then find the documents whose field is set."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props", "ts"])
    store = TableStore(spark, scratch_path(spark, "store-documents"))
    docs = ev.select("event_id", "event_type", F.col("props").alias("data"), F.coalesce(_day(), F.lit("none")).alias("day"))
    store.replace(docs, "docs", ["event_id"], "event_id")
    store.update("docs", F.col("event_type") == "error", {"data": set_json_field("data", "flag", True)})
    store.update_one("docs", F.col("event_type") == "purchase", {"data": set_json_field("data", "flag", True)}, "event_id")
    store.delete("docs", F.col("event_type") == "view")
    store.delete_one("docs", F.col("event_type") == "error", "event_id")
    found = store.find("docs", "flag", "true")
    return found.select("event_id", "event_type", F.get_json_object("data", "$.k").cast("bigint").alias("k"))


def q_table_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set value = 0 on error events."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    return update_where(ev, F.col("event_type") == "error", {"value": 0.0})


def q_table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete all view events, then delete the first purchase event (delete-one)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    rest = delete_where(ev, F.col("event_type") == "view")
    return delete_first(rest, F.col("event_type") == "purchase", "event_id")


QUERIES = {
    "metric_totals": q_metric_totals,
    "snapshot_totals": q_snapshot_totals,
    "snapshot_delta": q_snapshot_delta,
    "latest_two_snapshots": q_latest_two_snapshots,
    "day_changes": q_day_changes,
    "elapsed_resets": q_elapsed_resets,
    "raw_upsert_last": q_raw_upsert_last,
    "raw_upsert_first": q_raw_upsert_first,
    "upsert_accumulate": q_upsert_accumulate,
    "elapsed_resets_hourly": q_elapsed_resets_hourly,
    "store_accumulate_replay": q_store_accumulate_replay,
    "store_upsert_by_id": q_store_upsert_by_id,
    "store_scan_days": q_store_scan_days,
    "store_documents": q_store_documents,
    "table_update": q_table_update,
    "table_delete": q_table_delete,
}

# ---- DuckDB oracle SQL ------------------------------------------------------------------

_DAY = "strftime(DATE '1970-01-01' + CAST({ms} // 86400000 AS INTEGER), '%Y%m%d')"

SNAPSHOT_SQL = """
e AS (SELECT epoch_us(ts) // 1000000 AS sec, event_type FROM events WHERE ts IS NOT NULL),
n AS (SELECT (sec - sec % 300) * 1000 AS tick_ms, event_type AS metric, count(*) AS n FROM e GROUP BY 1, 2),
types AS (SELECT DISTINCT metric FROM n WHERE metric IS NOT NULL),
ticks AS (SELECT unnest(generate_series((SELECT min(tick_ms) FROM n), (SELECT max(tick_ms) FROM n), 300000)) AS tick_ms),
grid AS (SELECT tick_ms, metric, """ + _DAY.format(ms="tick_ms") + """ AS day FROM ticks, types),
snap AS (
  SELECT tick_ms, day, metric,
         CAST(sum(coalesce(n, 0)) OVER (PARTITION BY day, metric ORDER BY tick_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
  FROM grid LEFT JOIN n USING (tick_ms, metric)
)
"""

ORACLE = {
    "metric_totals": """
WITH v AS (SELECT event_type, CAST(value AS DECIMAL(18,2)) AS v FROM events)
SELECT 'total' AS metric, CAST(coalesce(sum(v), 0) AS DOUBLE) AS value FROM v
UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM v
UNION ALL SELECT event_type, CAST(coalesce(sum(v), 0) AS DOUBLE) FROM v WHERE event_type IS NOT NULL GROUP BY event_type""",
    "snapshot_totals": f"WITH {SNAPSHOT_SQL} SELECT tick_ms, day, metric, total FROM snap",
    "snapshot_delta": f"""WITH {SNAPSHOT_SQL}
SELECT tick_ms, day, metric, total,
       CAST(total - coalesce(lag(total) OVER (PARTITION BY metric ORDER BY tick_ms), 0) AS BIGINT) AS delta
FROM snap""",
    "latest_two_snapshots": f"""WITH {SNAPSHOT_SQL},
f AS (SELECT * FROM snap WHERE tick_ms >= (SELECT max(tick_ms) FROM snap) - 1800000),
top AS (SELECT DISTINCT tick_ms FROM f ORDER BY tick_ms DESC LIMIT 2)
SELECT tick_ms, day, metric, total FROM f WHERE tick_ms IN (SELECT tick_ms FROM top)""",
    "day_changes": """
WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS sec FROM events),
d AS (SELECT *, strftime(DATE '1970-01-01' + CAST(sec // 86400 AS INTEGER), '%Y%m%d') AS day FROM e)
SELECT day, strftime(strptime(day, '%Y%m%d') - INTERVAL 1 DAY, '%Y%m%d') AS previous_day,
       arg_min(event_id, (sec, event_id)) AS event_id, min(sec) AS sec
FROM d GROUP BY day""",
    "elapsed_resets": """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS sec FROM events),
r AS (
  SELECT user_id, arg_min(event_id, (sec, event_id)) AS event_id, min(sec) AS sec, CAST(0 AS BIGINT) AS reset_no
  FROM e GROUP BY user_id
  UNION ALL
  SELECT e.user_id, arg_min(e.event_id, (e.sec, e.event_id)), min(e.sec), any_value(r.reset_no) + 1
  FROM r JOIN e ON e.user_id = r.user_id AND e.sec >= r.sec + 86400
  GROUP BY e.user_id
)
SELECT user_id, event_id, sec, reset_no FROM r""",
    "elapsed_resets_hourly": """
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) // 1000000 AS sec FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT event_type, arg_min(event_id, (sec, event_id)) AS event_id, min(sec) AS sec, CAST(0 AS BIGINT) AS reset_no
  FROM e GROUP BY event_type
  UNION ALL
  SELECT e.event_type, arg_min(e.event_id, (e.sec, e.event_id)), min(e.sec), any_value(r.reset_no) + 1
  FROM r JOIN e ON e.event_type IS NOT DISTINCT FROM r.event_type AND e.sec >= r.sec + 3600
  GROUP BY e.event_type
)
SELECT event_type, event_id, sec, reset_no FROM r""",
    "store_accumulate_replay": """
SELECT strftime(ts, '%Y%m%d') AS day, event_type, count(*) AS cnt FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "store_upsert_by_id": """
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(props, event_id) AS data, max(event_id) AS seq,
       strftime(arg_max(ts, event_id), '%Y%m%d') AS day
FROM events GROUP BY user_id""",
    "store_scan_days": """
SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n,
       CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS value
FROM events WHERE ts IS NOT NULL AND event_type <> 'view' GROUP BY 1""",
    "store_documents": """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
WHERE (event_type = 'error' AND event_id > (SELECT min(event_id) FROM events WHERE event_type = 'error'))
   OR (event_type = 'purchase' AND event_id = (SELECT min(event_id) FROM events WHERE event_type = 'purchase'))""",
    "raw_upsert_last": """
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(props, event_id) AS data, max(event_id) AS seq
FROM events GROUP BY user_id""",
    "raw_upsert_first": """
SELECT CAST(user_id AS VARCHAR) AS id, arg_min(props, event_id) AS data, min(event_id) AS seq
FROM events GROUP BY user_id""",
    "upsert_accumulate": """
SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS day, event_type, count(*) AS cnt FROM events GROUP BY 1, 2""",
    "table_update": """
SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events""",
    "table_delete": """
SELECT event_id, user_id, event_type FROM events
WHERE event_type <> 'view'
  AND NOT (event_type = 'purchase' AND event_id = (SELECT min(event_id) FROM events WHERE event_type = 'purchase'))""",
}
