"""Where rows come from."""

from .custom import connect, connector
from .envelope import ENVELOPE, kafka_options, kafka_source, keep_from
from .lines import socket_lines, split_hosts, tagged_union
from .tables import read_table, replay

__all__ = [
    "ENVELOPE", "connect", "connector", "kafka_options", "kafka_source", "keep_from",
    "read_table", "replay", "socket_lines", "split_hosts", "tagged_union",
]
