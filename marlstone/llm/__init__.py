"""Operators for large-scale training-data pipelines.

Nothing outside this sub-package imports it.  Each module holds one operator
with a general interface and a thin ``query`` that applies it to its table.
"""
