"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage; it can be deleted without touching the rest.
"""
