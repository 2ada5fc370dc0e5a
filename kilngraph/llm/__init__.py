"""Operators of a large-scale training-data pipeline.  Nothing else in kilngraph imports this package."""
