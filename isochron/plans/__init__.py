"""Registered queries and their SQL."""

from . import beats, metrics, signal
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "beats", "metrics", "signal"]
