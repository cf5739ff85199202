"""Operators of a large-scale training-data pipeline.

Nothing else in ``eventframe`` imports this subpackage.
"""
