"""Scalar functions as column expressions."""

from recall_engine.functions import text, values

__all__ = ["text", "values"]
