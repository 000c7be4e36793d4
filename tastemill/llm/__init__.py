"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface, a thin ``opN_...`` query over the standard tables,
and, where SQL can express the result, the DuckDB statement it is held against.
"""
