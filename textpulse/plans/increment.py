"""Snapshot-and-delta of the hot-word and sentiment results (the periodic increment job).

Two forms over the same semantics:

* :func:`q_hotword_sentiment_snapshots` — batch back-fill from ``conversations``: hot-word
  windows (count >= 10 per 5-minute arrival window) add their counts to metric ``hotword``,
  sentiment windows add theirs to ``positive``/``negative``/``unknown``, each on the day of its
  arrival window; every 5-minute tick snapshots the day's totals and the delta to the
  previous snapshot.
* :func:`increment_tick` — one tick against the day-partitioned result tables of a
  :class:`TableStore` (run it from ``streaming.snapshot_ticks`` or a scheduler).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import fixed
from textpulse.operators.aggregate import arrival_window_ms, totals
from textpulse.operators.lexicon import classify
from textpulse.operators.timeseries import snapshot, snapshot_delta
from textpulse.plans.messages import MESSAGES_SQL, POLARITY_SQL, _lexicon, tokens
from textpulse.sinks.store import TableStore


def _increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per arrival window: surviving hot-word counts (metric ``hotword``) and polarity counts.

    Both come from one count per (window, bucket, word) over all terms, so the text is
    tokenised once and the shared aggregate is reused by the two branches."""
    per_word = (
        tokens(spark, sf_dir, min_len=None)
        .withColumn("win_ms", arrival_window_ms("arrival_sec"))
        .groupBy("win_ms", "bucket_ms", "word")
        .agg(F.count(F.lit(1)).alias("v"))
    )
    hot = per_word.where(
        (F.length("word") >= fixed.MIN_TOKEN_LENGTH) & (F.col("v") >= fixed.HOT_WORD_THRESHOLD)
    ).select("win_ms", F.lit("hotword").alias("metric"), "v")
    senti = (
        classify(per_word, _lexicon(spark))
        .groupBy("win_ms", F.col("emotion").alias("metric"))
        .agg(F.sum("v").alias("v"))
    )
    return hot.unionByName(senti).withColumn("sec", (F.col("win_ms") / 1000).cast("bigint"))


def q_hotword_sentiment_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshot(_increments(spark, sf_dir), "sec", "metric", "v", fixed.SNAPSHOT_METRICS)
    return snapshot_delta(snaps).select("tick_ms", "day", "metric", "total", "delta")


def increment_tick(store: TableStore, tick_ms: int, hot_table: str = "hot_word", emo_table: str = "emotional_word",
                   count_table: str = "increment_count", delta_table: str = "increment") -> None:
    """Snapshot the four totals of the tick's day and write the delta to the previous snapshot.

    Totals: SUM(count) of the day's hot words; SUM(count) per emotion of the day's sentiment
    rows (one scan each). The previous snapshot is the newest earlier one in any day (0 if
    none). Re-running a tick replaces its rows (keyed by time_stamp and metric)."""
    day = datetime.fromtimestamp(tick_ms / 1000, tz=timezone.utc).strftime("%Y%m%d")
    metrics = fixed.SNAPSHOT_METRICS
    # one single-row aggregate per table (partition-pruned to the day), stacked into one row
    hot = totals(store.read(hot_table).where(F.col("day") == day), "count", count_name=None, total_name="hotword")
    emo = totals(store.read(emo_table).where(F.col("day") == day), "count", "emotional", metrics[1:],
                 count_name=None).drop("total")
    wide = hot.unionByName(emo, allowMissingColumns=True).agg(
        *[F.coalesce(F.max(m), F.lit(0)).cast("bigint").alias(m) for m in metrics]
    )
    snap = wide.unpivot([], metrics, "metric", "count").select(
        F.lit(tick_ms).cast("bigint").alias("time_stamp"), "metric", "count", F.lit(day).alias("day")
    )
    store.replace(snap, count_table, ["day", "time_stamp", "metric"], "time_stamp")

    history = store.read(count_table).where(F.col("time_stamp") < F.lit(tick_ms))
    prev_tick = history.agg(F.max("time_stamp")).scalar()
    prev = history.where(F.col("time_stamp") == prev_tick).select("metric", F.col("count").alias("_prev"))
    delta = (
        snap.join(F.broadcast(prev), "metric", "left")  # at most one row per metric
        .select("time_stamp", "metric", (F.col("count") - F.coalesce("_prev", F.lit(0))).alias("count"), "day")
    )
    store.replace(delta, delta_table, ["day", "time_stamp", "metric"], "time_stamp")


QUERIES = {"hotword_sentiment_snapshots": q_hotword_sentiment_snapshots}

ORACLE = {
    "hotword_sentiment_snapshots": f"""WITH {MESSAGES_SQL},
hot AS (
  SELECT arrival_sec - arrival_sec % 300 AS sec, 'hotword' AS metric, count(*) AS v
  FROM toks GROUP BY arrival_sec - arrival_sec % 300, bucket_ms, word HAVING count(*) >= 10
),
senti AS (
  SELECT arrival_sec - arrival_sec % 300 AS sec, {POLARITY_SQL} AS metric, count(*) AS v FROM terms GROUP BY 1, 2
),
inc AS (SELECT * FROM hot UNION ALL SELECT * FROM senti),
busy AS (
  SELECT (sec - sec % 300) * 1000 AS tick_ms,
         coalesce(sum(v) FILTER (WHERE metric = 'hotword'), 0) AS hotword,
         coalesce(sum(v) FILTER (WHERE metric = 'positive'), 0) AS positive,
         coalesce(sum(v) FILTER (WHERE metric = 'negative'), 0) AS negative,
         coalesce(sum(v) FILTER (WHERE metric = 'unknown'), 0) AS unknown
  FROM inc GROUP BY 1
),
per_tick AS (
  SELECT tick_ms, coalesce(hotword, 0) AS hotword, coalesce(positive, 0) AS positive,
         coalesce(negative, 0) AS negative, coalesce(unknown, 0) AS unknown
  FROM (SELECT unnest(generate_series((SELECT min(tick_ms) FROM busy), (SELECT max(tick_ms) FROM busy), 300000)) AS tick_ms)
  LEFT JOIN busy USING (tick_ms)
),
d AS (SELECT *, strftime(DATE '1970-01-01' + CAST(tick_ms // 86400000 AS INTEGER), '%Y%m%d') AS day FROM per_tick),
run AS (
  SELECT tick_ms, day, sum(hotword) OVER w AS hotword, sum(positive) OVER w AS positive,
         sum(negative) OVER w AS negative, sum(unknown) OVER w AS unknown
  FROM d WINDOW w AS (PARTITION BY day ORDER BY tick_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
snap AS (
  SELECT tick_ms, day, metric, CAST(total AS BIGINT) AS total
  FROM (UNPIVOT run ON hotword, positive, negative, unknown INTO NAME metric VALUE total)
)
SELECT tick_ms, day, metric, total,
       CAST(total - coalesce(lag(total) OVER (PARTITION BY metric ORDER BY tick_ms), 0) AS BIGINT) AS delta
FROM snap""",
}
