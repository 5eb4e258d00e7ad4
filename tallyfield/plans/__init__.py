"""Named queries over the given tables, grouped by subject."""

from . import differential, ecology, sequences, stratified, summaries, tidy
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "differential", "ecology", "sequences", "stratified", "summaries", "tidy"]
