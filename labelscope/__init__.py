"""Audited label analytics as Spark DataFrame operators."""
