"""Several line sources read as one stream that knows where each row came from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_hosts(text: str) -> list[tuple[str, int]]:
    """``h1:p1,h2:p2`` as pairs; parts without a port are skipped, repeats dropped."""
    parts = (part.strip() for part in text.split(","))
    pairs = (part.rsplit(":", 1) for part in parts if ":" in part)
    hosts = list(dict.fromkeys((host.strip(), int(port)) for host, port in pairs))
    if not hosts:
        raise ValueError(f"no host:port in {text!r}")
    return hosts


def tagged_union(origins: Iterable[tuple[str, int]], read: Callable[[str, int], DataFrame]) -> DataFrame:
    """Union of ``read(host, port)`` with the origin as leading columns."""
    frames = [
        read(host, port).select(F.lit(host).alias("host"), F.lit(port).cast("int").alias("port"), "*")
        for host, port in origins
    ]
    return reduce(DataFrame.unionByName, frames)


def socket_lines(spark: SparkSession, options: dict) -> DataFrame:
    """Lines of all hosts in ``socket_hosts`` as ``host, port, value``."""

    def read(host: str, port: int) -> DataFrame:
        return spark.readStream.format("socket").option("host", host).option("port", port).load()

    return tagged_union(split_hosts(options.get("socket_hosts") or ""), read)
