"""Connected components of a distributed list of links, shared with the rest of the library."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
