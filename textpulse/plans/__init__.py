"""Registered queries: each maps (spark, sf_dir) -> DataFrame, with DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from textpulse.plans import events, increment, messages, payloads, streams

    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in (messages, events, increment, payloads, streams):
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    from textpulse.plans import events, increment, messages, payloads, streams

    out: dict[str, str] = {}
    for mod in (messages, events, increment, payloads, streams):
        out.update(mod.ORACLE)
    return out
