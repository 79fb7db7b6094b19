"""Operators of a training-data pipeline, and their queries."""

from . import (
    arc, bloom_lookup, debruijn, decontaminate, divergence, langid, masked_lm, packing, prefix_tree, prefix_trie,
    simhash_grid, toxicity_chain, weak_rules,
)
from .common import CATALOG

__all__ = ["CATALOG"]
