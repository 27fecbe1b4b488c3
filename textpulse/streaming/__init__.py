"""Structured Streaming queries built from the same operators as the batch jobs."""

from textpulse.streaming.jobs import (
    Expiry,
    count_window_sink,
    elapsed_resets_stream,
    last_emitted,
    read_log,
    rocksdb_state,
    run_branches,
    running_counts_per_record,
    running_word_counts,
    snapshot_ticks,
    stored_table_stream,
    table_stream,
    tick_totals,
    two_level_hot_words,
    windowed_hot_words,
    write_updates,
)

__all__ = [
    "Expiry",
    "count_window_sink",
    "elapsed_resets_stream",
    "last_emitted",
    "read_log",
    "rocksdb_state",
    "run_branches",
    "running_counts_per_record",
    "running_word_counts",
    "snapshot_ticks",
    "stored_table_stream",
    "table_stream",
    "tick_totals",
    "two_level_hot_words",
    "windowed_hot_words",
    "write_updates",
]
