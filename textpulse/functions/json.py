"""Column expressions over JSON documents stored as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_field(doc: Column | str, field: str) -> Column:
    """Top-level field of a JSON object as text (null when absent)."""
    return F.get_json_object(_c(doc), f"$.{field}")


def set_json_field(doc: Column | str, field: str, value: Column | object) -> Column:
    """The JSON object with ``field`` set to ``value`` (added when absent), with the value's own
    type; every other field keeps its type and value."""
    as_map = F.from_json(_c(doc), "map<string,variant>")
    v = value if isinstance(value, Column) else F.lit(value)
    kept = F.map_filter(as_map, lambda k, _: k != F.lit(field))
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(field), v.cast("variant"))))
