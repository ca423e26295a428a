"""Change feeds as streams: every micro-batch is logged once and maintained at once."""

from .feed import stream_changes, stream_debezium, stream_inserts

__all__ = ["stream_changes", "stream_debezium", "stream_inserts"]
