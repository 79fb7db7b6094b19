"""Column functions and user-defined functions."""

from .json_path import json_get, json_read
from .registry import Accumulator, aggregate_by, register
from .time import epoch_ms, to_epoch_ms

__all__ = ["Accumulator", "aggregate_by", "epoch_ms", "json_get", "json_read", "register", "to_epoch_ms"]
