"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from .oracle import ORACLE
from .queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
