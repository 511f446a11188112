"""Trace, log and code analytics as plain Spark DataFrame operators."""
