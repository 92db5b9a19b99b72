"""Operators for large-scale training-data pipelines.

Each module holds one operator, its thin ``opN_*`` query and, where SQL can
say the same, its oracle.  Nothing outside this subpackage imports it.
"""
