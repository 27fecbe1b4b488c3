"""Sources: driver tables, record envelopes (Kafka / files), word lists, JDBC."""

from textpulse.sources.adapters import event_seconds, messages_from_conversations
from textpulse.sources.records import (
    blacklist,
    file_source,
    jdbc_scan,
    kafka_options,
    kafka_source,
    parse_records,
    word_list,
    word_values,
)
from textpulse.sources.tables import read_table, table_path

__all__ = [
    "blacklist",
    "event_seconds",
    "file_source",
    "jdbc_scan",
    "kafka_options",
    "kafka_source",
    "messages_from_conversations",
    "parse_records",
    "read_table",
    "table_path",
    "word_list",
    "word_values",
]
