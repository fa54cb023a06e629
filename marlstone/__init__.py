"""Marlstone: a PySpark-native analytics library.

Sub-packages hold relational operators, sources and sinks, the function
catalogue, complete query plans and streaming helpers.  Everything is a
composition of public DataFrame, SQL and Structured Streaming primitives, so
Catalyst and adaptive execution pick the physical strategy.
"""

__version__ = "0.1.0"
