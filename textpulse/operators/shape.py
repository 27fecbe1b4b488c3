"""Record shaping: flatten nested records into messages, unpivot metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.text import clean, escaped_form, is_special


def explode_messages(records: DataFrame, keep: Sequence[str] = (), drop_special: str | None = "bullet",
                     escaped: bool = False, dedupe: bool = False, clean_ids: bool = False) -> DataFrame:
    """Nested video records -> one row per message: (keep..., av, origin, sender, sec, text).

    Bullets: pages[] -> sender map -> (second -> text) map; replies: one row per reply. Each
    record's bullets and replies are first gathered into one array with higher-order
    functions and exploded once, so the records are read in a single pass (no union of two
    scans). ``drop_special="bullet"`` drops bracketed special messages from bullets only,
    ``"all"`` from both, ``None`` keeps them. ``escaped=True`` yields the JSON-escaped text the
    original processed. ``dedupe=True`` keeps the last text of a (page, sender, second) key
    repeated inside one map, for raw JSON that repeats keys. ``clean_ids=True`` strips
    punctuation, symbols and separators from ``av`` too, as the original's key clean-up does.
    """
    keep = list(keep)

    def page_messages(page, page_no):
        def sender_messages(entry):
            return F.transform(
                F.map_entries(entry["value"]),
                lambda t, i: F.struct(
                    F.lit("bullet").alias("origin"),
                    entry["key"].alias("sender"),
                    t["key"].try_cast("bigint").alias("sec"),  # a non-numeric key gives null
                    t["value"].alias("text"),
                    page_no.alias("_page"),
                    i.alias("_pos"),
                ),
            )

        return F.flatten(F.transform(F.map_entries(page["bullet"]), sender_messages))

    bullets = F.flatten(F.transform(F.coalesce("bullet_screen", F.array()), page_messages))
    replies = F.transform(
        F.coalesce("replies", F.array()),
        lambda r, i: F.struct(
            F.lit("reply").alias("origin"),
            r["name"].alias("sender"),
            r["time"].cast("bigint").alias("sec"),
            r["message"].alias("text"),
            F.lit(-1).alias("_page"),
            i.alias("_pos"),
        ),
    )
    source = records.withColumn("_rec", F.monotonically_increasing_id()) if dedupe else records
    msgs = source.select(*keep, *(["_rec"] if dedupe else []), "av",
                         F.explode(F.concat(bullets, replies)).alias("_m")).select(
        *keep, *(["_rec"] if dedupe else []), "av", "_m.*"
    )
    if dedupe:
        # Repeated keys can only occur inside one map of one record. A reply keeps its own
        # index in the key, so only bullets sharing (record, page, sender, second) collapse.
        reply_idx = F.when(F.col("origin") == "reply", F.col("_pos")).otherwise(F.lit(-1)).alias("_ridx")
        msgs = msgs.groupBy(*keep, "_rec", "av", "origin", "_page", "sender", "sec", reply_idx).agg(
            F.max_by("text", "_pos").alias("text")
        ).drop("_rec", "_ridx")
    msgs = msgs.drop("_page", "_pos")
    if drop_special == "bullet":
        msgs = msgs.where(~((F.col("origin") == "bullet") & is_special("text")))
    elif drop_special == "all":
        msgs = msgs.where(~is_special("text"))
    if clean_ids:
        msgs = msgs.withColumn("av", clean("av"))
    if escaped:
        msgs = msgs.withColumn("text", escaped_form("text"))
    return msgs


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], metric_col: str = "metric",
                    value_col: str = "value") -> DataFrame:
    """Wide metric columns -> (ids..., metric, value) rows."""
    return df.unpivot(list(ids), list(metrics), metric_col, value_col)
