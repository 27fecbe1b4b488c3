"""Keyed table maintenance as set-at-a-time DataFrame operations.

Upserts resolve each key with a declarative aggregate (``max_by`` / ``min_by`` / ``sum``),
which Spark combines map-side before the shuffle, so a key holding a large share of the rows
costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_replace(incoming: DataFrame, keys: Sequence[str], seq_col: str, existing: DataFrame | None = None,
                   keep: str = "last") -> DataFrame:
    """One row per key: the row with the highest (``keep="last"``) or lowest (``"first"``)
    sequence among existing and incoming rows. Last-wins is the replace intent; first-wins is
    the effective behaviour of an insert whose duplicate-key failures are swallowed."""
    if keep not in ("last", "first"):
        raise ValueError(f"keep must be 'last' or 'first', got {keep!r}")
    rows = incoming if existing is None else existing.unionByName(incoming)
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    packed = F.struct(*[F.col(c) for c in others])
    return rows.groupBy(*keys).agg(pick(packed, F.col(seq_col)).alias("_row")).select(*keys, "_row.*")


def upsert_accumulate(deltas: DataFrame, keys: Sequence[str], value_col: str, existing: DataFrame | None = None
                      ) -> DataFrame:
    """Insert-or-add: per key, existing value plus the sum of incoming deltas."""
    rows = deltas.select(*keys, value_col)
    if existing is not None:
        rows = existing.select(*keys, value_col).unionByName(rows)
    return rows.groupBy(*keys).agg(F.sum(value_col).alias(value_col))


def update_where(df: DataFrame, predicate: Column, assignments: Mapping[str, Column | object]) -> DataFrame:
    """Set columns on rows matching ``predicate`` (null predicate = no match)."""
    hit = F.coalesce(predicate, F.lit(False))
    cols = {
        c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType)
        for c, v in assignments.items()
    }
    return df.withColumns(cols)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop every row matching ``predicate``."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def delete_first(df: DataFrame, predicate: Column, seq_col: str) -> DataFrame:
    """Drop only the earliest (lowest ``seq``) row matching ``predicate`` (delete-one)."""
    hit = F.coalesce(predicate, F.lit(False))
    first = df.where(hit).agg(F.min(seq_col)).scalar()
    return df.where(~(hit & (F.col(seq_col) == first)) | first.isNull())


def update_first(df: DataFrame, predicate: Column, assignments: Mapping[str, Column | object], seq_col: str) -> DataFrame:
    """Set columns only on the earliest (lowest ``seq``) row matching ``predicate`` (update-one)."""
    hit = F.coalesce(predicate, F.lit(False))
    first = df.where(hit).agg(F.min(seq_col)).scalar()
    return update_where(df, hit & (F.col(seq_col) == first), assignments)
