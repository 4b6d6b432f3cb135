"""Training-data operators.

Nothing else in the library imports this subpackage, so it can be removed whole. ``registry`` maps
query names to functions, DuckDB twins included.
"""
