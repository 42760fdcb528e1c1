"""Operators of a training-data pipeline; nothing else in vecmesh imports this subpackage."""
