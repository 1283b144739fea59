"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import assessment, evaluation, published, reads, relations
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assessment", "evaluation", "published", "reads", "relations"]
