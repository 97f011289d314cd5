"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``symsift.llm.queries`` holds the thin registered queries.
"""
