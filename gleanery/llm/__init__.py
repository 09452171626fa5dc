"""Operators of a training-data pipeline. Nothing else in gleanery imports this subpackage."""
