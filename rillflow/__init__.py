"""Streaming and batch SQL jobs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .plans.pipeline import Pipeline
from .schema import Col, ContractError, SchemaError, TableDef, Watermark
from .session import build_session

__all__ = ["Col", "ContractError", "Pipeline", "SchemaError", "TableDef", "Watermark", "build_session"]

# Functions of this package travel to executors by value, so it only has to be installed on the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
