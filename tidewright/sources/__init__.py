"""Base tables, the change log, and the ways changes come in."""

from .catalog import Catalog, Table
from .changelog import Batch, ChangeLog
from .debezium import to_descriptor, to_descriptors
from .diff import Outbox, key_images

__all__ = ["Batch", "Catalog", "ChangeLog", "Outbox", "Table", "key_images", "to_descriptor", "to_descriptors"]
