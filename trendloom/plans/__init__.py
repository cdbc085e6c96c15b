"""Queries over the test tables, and their SQL."""

from . import desk, intake, lab, market, relational, scalars, series, streams, texts, upkeep  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
