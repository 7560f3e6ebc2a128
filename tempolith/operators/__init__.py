"""Operators over ledgers and key/value change logs: DataFrame in, DataFrame out."""
