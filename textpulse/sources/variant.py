"""Records without a fixed schema: JSON parsed to VARIANT and walked, so unknown, changing and
differently typed fields are kept and never fail a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.text import is_special


def variant_records(df: DataFrame, value_col: str = "value", key_field: str = "av") -> tuple[DataFrame, DataFrame]:
    """Parse JSON text into ``rec`` (VARIANT) and its ``key_field``; return ``(good, quarantine)``.

    Text that is no JSON (or repeats a key) is malformed; a record that is no object or has no key
    is empty. Both go to the quarantine with a reason; nothing else can fail a record.
    """
    others = [c for c in df.columns if c != value_col]
    parsed = df.withColumn("rec", F.try_parse_json(F.col(value_col))).withColumn(key_field, F.try_variant_get("rec", f"$.{key_field}", "string"))
    malformed = F.col("rec").isNull()
    good = parsed.where(~malformed & F.col(key_field).isNotNull()).select(*[c for c in others if c != key_field], key_field, "rec")
    reason = F.when(malformed, F.lit("malformed")).otherwise(F.lit("empty")).alias("reason")
    return good, parsed.where(malformed | F.col(key_field).isNull()).select(*others, value_col, reason)


def _entries(df: DataFrame, value: Column, prefix: str, outer: bool = False) -> DataFrame:
    """One row per element or field of a variant: ``<prefix>_key``, ``<prefix>_pos``, ``<prefix>``."""
    tvf = df.sparkSession.tvf
    explode = tvf.variant_explode_outer if outer else tvf.variant_explode
    listed = explode(value.outer()).select(F.col("pos").alias(f"{prefix}_pos"), F.col("key").alias(f"{prefix}_key"), F.col("value").alias(prefix))
    return df.lateralJoin(listed)


def variant_messages(records: DataFrame, keep: Sequence[str] = (), key_field: str = "av", drop_special: bool = True) -> DataFrame:
    """Records -> one row per message (keep..., key, origin, sender, sec, text), like
    ``explode_messages`` of typed records.

    The record is walked level by level, all in one pass over it: its two message fields, their
    pages or replies, a page's senders, a sender's texts by second. A field of another type than
    expected gives null (or no messages), not an error.
    """
    rows = records.select(*keep, key_field, "rec")
    rows = _entries(rows, F.col("rec"), "part").where(F.col("part_key").isin("bullet_screen", "replies")).drop("rec")
    rows = _entries(rows, F.col("part"), "item").where("item_key is null").drop("part")
    rows = rows.withColumn("bullet", F.when(F.col("part_key") == "bullet_screen", F.try_variant_get("item", "$.bullet", "variant")))
    rows = _entries(rows, F.col("bullet"), "sender", outer=True).drop("bullet")
    rows = _entries(rows, F.col("sender"), "text", outer=True)
    is_reply = F.col("part_key") == "replies"
    field = lambda name, kind: F.try_variant_get("item", f"$.{name}", kind)
    out = rows.where(is_reply | F.col("text_key").isNotNull()).select(
        *keep,
        key_field,
        F.when(is_reply, F.lit("reply")).otherwise(F.lit("bullet")).alias("origin"),
        F.when(is_reply, field("name", "string")).otherwise(F.col("sender_key")).alias("sender"),
        F.when(is_reply, field("time", "bigint")).otherwise(F.col("text_key").try_cast("bigint")).alias("sec"),
        F.when(is_reply, field("message", "string")).otherwise(F.try_variant_get("text", "$", "string")).alias("text"),
    )
    return out.where(~((F.col("origin") == "bullet") & F.coalesce(is_special("text"), F.lit(False)))) if drop_special else out


def variant_fields(records: DataFrame, known: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., field, kind, json): every field of the records that is not in ``known``."""
    rows = _entries(records.select(*keep, "rec"), F.col("rec"), "field").where(F.col("field_key").isNotNull() & ~F.col("field_key").isin(list(known)))
    return rows.select(*keep, F.col("field_key").alias("field"), F.schema_of_variant("field").alias("kind"), F.to_json("field").alias("json"))
