"""Column-level functions (scalar expressions), all built from Spark SQL built-ins."""

from textpulse.functions.json import json_field, set_json_field
from textpulse.functions.text import clean, crc32_of, escaped_form, is_special, token_length, words
from textpulse.functions.time import (
    bucket_ms,
    day_of_ms,
    epoch_seconds,
    previous_day,
    seconds_to_timestamp,
    tick_ms,
)

__all__ = [
    "bucket_ms",
    "clean",
    "crc32_of",
    "day_of_ms",
    "epoch_seconds",
    "escaped_form",
    "is_special",
    "json_field",
    "previous_day",
    "seconds_to_timestamp",
    "set_json_field",
    "tick_ms",
    "token_length",
    "words",
]
