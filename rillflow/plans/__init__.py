"""Job definitions and the catalogue of checked queries."""

from .pipeline import Pipeline

__all__ = ["Pipeline"]
