"""Operators of a training-data pipeline: de-duplication, filtering, packing, formatting, search."""
