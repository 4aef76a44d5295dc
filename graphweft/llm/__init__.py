"""Operators of a training-data pipeline; nothing else in graphweft imports this subpackage."""
