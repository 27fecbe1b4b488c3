"""Sinks: day-partitioned result tables and JSON publishing."""

from textpulse.sinks.publish import json_payload, publish_json
from textpulse.sinks.store import TableStore

__all__ = ["TableStore", "json_payload", "publish_json"]
