"""Pipelines composed from the operators (T1-T6) and the query registry."""
