"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Each module holds one operator
with its own general interface; :mod:`threadloom.llm.queries` derives the registered
queries from them.
"""
