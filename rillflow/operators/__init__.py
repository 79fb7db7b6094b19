"""Operators over DataFrames."""

from .aggregates import distinct_set, except_rows, grouped_sets, intersect_rows, net_changes
from .decode import decode, quarantine
from .inequality import inequality_join, range_join
from .joins import asof_join, hot_keys, interval_join, spread_join
from .mutate import accumulate, delete, insert_new, latest_by_key, merge_into, update, upsert
from .ordered import neighbours, ranked, sliding_range, sliding_rows, top_per_group
from .sessions import hop_totals, session_totals

__all__ = [
    "accumulate", "asof_join", "decode", "delete", "distinct_set", "except_rows", "grouped_sets", "hop_totals", "hot_keys", "inequality_join",
    "insert_new", "intersect_rows", "interval_join", "latest_by_key", "merge_into", "neighbours", "net_changes", "quarantine", "range_join",
    "ranked", "session_totals", "sliding_range", "sliding_rows", "spread_join", "top_per_group", "update", "upsert",
]
