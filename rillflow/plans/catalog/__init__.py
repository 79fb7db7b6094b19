"""Every query with the SQL it is checked against."""

from . import aggregation, composition, decoding, functions, joining, projection, sinking, sourcing, streams
from .base import CATALOG

__all__ = ["CATALOG"]
