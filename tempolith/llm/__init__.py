"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; null texts count as empty unless a docstring says otherwise.
"""
