"""Temporal ledger analytics on PySpark."""
