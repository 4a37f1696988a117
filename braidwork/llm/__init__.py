"""Operators of a training-data pipeline. Nothing else in braidwork imports this subpackage."""
