"""Declared schemas and table bundles: the driver-data mapping, seed rows, stored (bucketed) tables, JDBC, and the sinks."""
