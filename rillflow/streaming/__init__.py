"""Structured Streaming: event time, windows, sinks and query start."""

from .asof import asof_stream
from .changes import join_changes, merged_ranking, set_changes, topk_changes
from .distinct import distinct_counts, distinct_sketches, united
from .eventtime import event_time, hop, interval, proctime, session, tumble, with_lateness
from .late import LateSplit
from .process import KeyedProcess, State, Variable, keyed_process
from .runtime import drain, fan_out, micro_batch_sql, start
from .sinks import (
    ChangelogSink, CompleteSink, ConsoleSink, JdbcSink, KeyedSink, LinesSink, MergeSink, ParquetSink, RowSink, RowWriter, Sink,
    StatementWriter, bind_columns, bind_parameters, named_sink, sink_connector,
)
from .state import dedup, running_state

__all__ = [
    "ChangelogSink", "CompleteSink", "ConsoleSink", "JdbcSink", "KeyedProcess", "KeyedSink", "LateSplit",
    "LinesSink", "MergeSink", "ParquetSink", "RowSink", "RowWriter", "Sink", "State", "StatementWriter", "Variable",
    "asof_stream", "bind_columns", "bind_parameters", "dedup", "distinct_counts", "distinct_sketches", "drain",
    "event_time", "fan_out", "hop", "interval", "join_changes", "keyed_process", "merged_ranking",
    "micro_batch_sql", "named_sink", "proctime", "running_state", "session", "set_changes", "sink_connector",
    "start", "topk_changes", "tumble", "united", "with_lateness",
]
