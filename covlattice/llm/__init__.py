"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; :mod:`covlattice.llm.queries` registers the ready-made queries.
"""
