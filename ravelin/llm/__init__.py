"""Operators for large-scale training-data pipelines; nothing else in ravelin imports this subpackage."""
