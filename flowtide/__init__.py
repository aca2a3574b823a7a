"""flowtide: network-flow analytics as PySpark DataFrame operators."""

from flowtide.schema import ADDRESS_COLUMNS, FLOW_SCHEMA, conform

__all__ = ["ADDRESS_COLUMNS", "FLOW_SCHEMA", "conform"]
