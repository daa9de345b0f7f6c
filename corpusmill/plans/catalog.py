"""All queries of the engine."""

from __future__ import annotations

from . import documents, evaluation, events, extra, fields, landing, lifecycle, records, search, segments  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
