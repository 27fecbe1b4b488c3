"""Publishing records as JSON to a message bus, a search index, or files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_payload(df: DataFrame, key_col: str | None = None) -> DataFrame:
    """(key, value): each row rendered as one JSON object; ``key`` is the id column as text."""
    body = [c for c in df.columns]
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*body)).alias("value"))


def publish_json(df: DataFrame, key_col: str | None, fmt: str, options: Mapping[str, str] | None = None,
                 path: str | None = None, mode: str = "append") -> None:
    """Write rows as JSON payloads with any batch writer: ``fmt="kafka"`` with
    ``kafka.bootstrap.servers`` and ``topic`` options, a search-index connector, or ``text``
    (one JSON line per row) under ``path``."""
    payload = json_payload(df, key_col)
    if fmt == "text":
        payload.select("value").write.mode(mode).text(path)
        return
    writer = payload.write.format(fmt).mode(mode).options(**(options or {}))
    writer.save(path) if path else writer.save()
