"""User-defined sources, looked up by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..options import Option, read_options
from .envelope import kafka_source
from .lines import socket_lines

Reader = Callable[[SparkSession, dict, T.StructType], DataFrame]

_connectors: dict[str, Reader | type[DataSource]] = {}
_envelopes: set[str] = set()
_options: dict[str, tuple[Option, ...]] = {}


def connector(name: str, envelopes: bool = False, options: Sequence[Option] | None = None):
    """Register a source: a callable ``(spark, options, schema)`` or a ``DataSource`` class.

    ``envelopes`` says that it gives message envelopes, which are decoded.
    With declared ``options`` the source gets all of them, typed and with
    their defaults, and others are refused; without, it gets what is given.
    """

    def keep(source):
        _connectors[name] = source
        _options.pop(name, None)
        if options is not None:
            _options[name] = tuple(options)
        (_envelopes.add if envelopes else _envelopes.discard)(name)
        return source

    return keep


def gives_envelopes(name: str) -> bool:
    return name in _envelopes


def connect(spark: SparkSession, name: str, options: dict, schema: T.StructType, stream: bool = True) -> DataFrame:
    """Rows of the source called ``name``.

    Names that were never registered are taken as Spark formats, so built-in
    and jar-provided connectors need no registration.
    """
    source = _connectors.get(name)
    if name in _options:
        options = read_options(f"source {name}", _options[name], options)
    if source is not None and not isinstance(source, type):
        return source(spark, options, schema)
    if source is not None:
        spark.dataSource.register(source)
        name = source.name()
    reader = spark.readStream if stream else spark.read
    options = {key: str(value) for key, value in options.items() if value is not None}
    return reader.format(name).schema(schema).options(**options).load()


@connector("kafka", envelopes=True)
def _kafka(spark: SparkSession, options: dict, schema: T.StructType) -> DataFrame:
    return kafka_source(spark, options)


@connector("socket", options=[Option("socket_hosts", str, description="host:port, several with commas")])
def _socket(spark: SparkSession, options: dict, schema: T.StructType) -> DataFrame:
    return socket_lines(spark, options)
